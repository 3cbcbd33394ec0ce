"""URL filter: allow and block rules, and a Bloom filter cascade for a list of domains.

The cascade gives exact membership.  Level 0 is a Bloom filter of the listed keys; level 1 one of those
keys of the corpus that level 0 passes though they aren't listed; level 2 one of the listed keys
that level 1 passes; and so on, until a level passes nothing wrongly.  A key's first level
that does not pass it decides: an odd level means listed, an even one not listed.  Since every key of the
corpus took part in the building, the answer is right for each of them, and no join is needed to ask.

Everything is DataFrame functions.  The filters reach the plan as one scalar subquery of bit words,
whose size is known before: beyond ``max_bytes`` the keys are joined with the list instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyroute.llm.tables import staged

#: Domains of the query's list: each label under each of the three domains.
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_PARENTS = ("example.com", "example.net", "example.org")

#: (verdict, host, path): a rule fits the host and its subdomains where the path starts with the rule's.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Filter bits for each key of a level, and hash functions of a level.
BITS_PER_KEY, HASHES = 8, 4
#: Most bytes of all levels that are broadcast.
MAX_BYTES = 64 << 20
#: Bit words that are put together at a time.
_STRETCH = 4096

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: str) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.locate("://", F.col(url))
    return F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: str) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path(url: str) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def suffixes(name: Column, most: int) -> Column:
    """The host and every parent domain of it, of at most ``most`` labels."""
    labels = F.slice(F.reverse(F.split(name, r"\.")), 1, most)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.reverse(F.slice(labels, 1, n)), "."))


def _bit(key: Column, level: int, i: int, bits: int) -> Column:
    """Place of the i-th bit of a key in a level."""
    return F.pmod(F.xxhash64(key, F.lit(level * HASHES + i)), F.lit(bits).cast("long"))


class Cascade:
    """Built by ``build_cascade``; ``bits`` are those of each level, ``words`` one row with the levels' bit words on end."""

    def __init__(self, words: DataFrame | None, bits: list[int]):
        self.words, self.bits = words, bits

    def contains(self, df: DataFrame, keys: Column, name: str) -> DataFrame:
        """``df`` with a column: whether any key of an array of keys of the corpus is listed."""
        if not self.bits:
            return df.withColumn(name, F.lit(False))

        def listed(key: Column) -> Column:
            verdict, base = F.lit(len(self.bits) % 2 == 1), sum(self.bits) // 64
            for level in reversed(range(len(self.bits))):
                base -= self.bits[level] // 64
                verdict = F.when(_has(F.col("_words"), key, level, self.bits[level], base), verdict).otherwise(F.lit(level % 2 == 1))
            return verdict

        return df.withColumn("_words", self.words.scalar()).withColumn(name, F.exists(keys, listed)).drop("_words")


def _has(words: Column, key: Column, level: int, bits: int, base: int = 0) -> Column:
    """Whether all bits of a key are set in a level whose words begin at ``base``."""
    passed = F.lit(True)
    for i in range(HASHES):
        at = _bit(key, level, i, bits)
        word = F.element_at(words, (F.shiftright(at, 6) + F.lit(base + 1)).cast("int"))
        passed = passed & (F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return passed


def _level_words(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """(level, word, value): the nonzero bit words of a level's filter."""
    at = keys.select(F.explode(F.array(*(_bit(F.col("key"), level, i, bits) for i in range(HASHES)))).alias("at"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
    return at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("value")).select(F.lit(level).alias("level"), "word", "value")


def _dense(words: DataFrame, bits: list[int]) -> DataFrame:
    """One row: the words of all levels on end, zeros filled in.  Words are first put together in stretches of ``_STRETCH``."""
    base = F.element_at(F.array(*(F.lit(sum(bits[:k]) // 64) for k in range(len(bits)))), F.col("level") + 1)
    zeros = words.sparkSession.range(sum(bits) // 64).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("value"))
    every = words.select((base + F.col("word")).alias("at"), "value").union(zeros).groupBy("at").agg(F.bit_or("value").alias("value"))
    in_order = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])
    stretches = every.groupBy(F.floor(F.col("at") / _STRETCH).alias("stretch")).agg(in_order("at", "value").alias("part"))
    return stretches.groupBy().agg(F.flatten(in_order("stretch", "part")).alias("words"))


def build_cascade(universe: DataFrame, listed: DataFrame, max_bytes: int = MAX_BYTES) -> Cascade | None:
    """The cascade of ``listed`` over ``universe`` (both have ``key``); None if it would exceed ``max_bytes``.

    The universe must hold every key that will be asked.  Null keys and repeats are ignored.
    """
    universe = universe.where("key is not null").select("key").distinct()
    listed = listed.where("key is not null").select("key").distinct()
    ins = staged(universe.join(listed, "key", "left_semi"), "listed-keys")
    outs = staged(universe.join(listed, "key", "left_anti"), "other-keys")
    encode, others = ins, outs
    levels, bits = None, []
    while n := encode.count():
        size = max(64, -(-n * BITS_PER_KEY // 64) * 64)
        if (sum(bits) + size) // 8 > max_bytes:
            return None
        words = staged(_level_words(encode, len(bits), size), "filter-level")
        bits.append(size)
        levels = words if levels is None else levels.union(words)
        row = _dense(words.withColumn("level", F.lit(0)), [size])
        wrong = others.withColumn("_words", row.scalar()).where(_has(F.col("_words"), F.col("key"), len(bits) - 1, size)).select("key")
        encode, others = staged(wrong, "wrongly-passed"), encode
    return Cascade(staged(_dense(levels, bits), "cascade") if bits else None, bits)


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits columns ``host`` and ``path``; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # longer ones overrule
        fits = ((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def listed_domains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"{a}.{b}",) for a in LISTED_LABELS for b in LISTED_PARENTS], "key string")


def url_filter(pages: DataFrame, listed: DataFrame | None = None, rules=RULES, *, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    The verdict is the rule's; without a rule, ``block`` if the host or a parent domain is in ``listed``
    (a table with ``key``), else ``allow``.  A null url, or one without ``://``, has an empty host and path
    and is allowed.  Hosts may be of any length and number of labels.  Repeated rows are judged each; an empty table gives an empty one; other
    columns are ignored, whatever their names.
    """
    listed = listed if listed is not None else listed_domains(pages.sparkSession)
    rule, verdict = rule_columns(rules)
    judged = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host("url").alias("host"), path("url").alias("path"))
    judged = judged.withColumns({"rule": rule, "by_rule": verdict})
    # longer parents than the longest key are not listed, so that a host of very many labels has few
    most = max(1, listed.agg(F.max(F.size(F.split("key", r"\.")))).first()[0] or 1)
    names = suffixes(F.col("host"), most)
    keys = judged.select("host").distinct().select(F.explode(names).alias("key"))
    cascade = build_cascade(keys, listed, max_bytes)
    if cascade is not None:
        judged = cascade.contains(judged, names, "listed")
    else:  # a list too large to be sent to every task
        found = (
            judged.select("host").distinct().select("host", F.explode(names).alias("key")).join(listed.distinct(), "key", "left_semi").select("host").distinct()
        )
        judged = judged.join(found.withColumn("listed", F.lit(True)), "host", "left")
    by_list = F.when(F.coalesce("listed", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_list).alias("verdict"))


def url_filter_sql() -> str:
    """The same over the table pages, for DuckDB."""
    listed = ", ".join(f"'{a}.{b}'" for a in LISTED_LABELS for b in LISTED_PARENTS)
    fits = lambda name, start: f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{start}')"
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"WHEN {fits(n, p)} THEN '{n}{p}'" for _, n, p in order)
    verdict = " ".join(f"WHEN {fits(n, p)} THEN '{v}'" for v, n, p in order)
    return f"""
WITH r AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
)
SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule,
       CASE {verdict}
            WHEN len(list_filter(generate_series(1, len(string_split(host, '.'))),
                 lambda i: array_to_string(string_split(host, '.')[i:], '.') IN ({listed}))) > 0 THEN 'block'
            ELSE 'allow' END AS verdict
FROM h"""
