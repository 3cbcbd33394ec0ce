"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in columns alone.

A key's jumps are a sequence of growing shard numbers that depends on the key only; with ``n`` shards the key
lies in the last number below ``n``.  No ring or table is kept, and where shards are appended, a key either stays or
goes to one of the new ones.

Slots number the rows of each shard without a gap.  They come from one range-partitioned sort of narrow rows (ids, sizes,
checksums): a row's slot is its place in its partition plus the rows of its shard in the partitions before, so that no task
holds a shard, whatever its size.  Texts are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyroute.llm.tables import staged

SHARDS = 24
#: Bytes that each row adds to its text.
ROW_BYTES = 8
FILE_BYTES = 128 << 20
#: The multiplier of the generator, 2862933555777941757, as two words of 32 bits.
_HIGH, _LOW = 2862933555777941757 >> 32, 2862933555777941757 & 0xFFFFFFFF
_WORD = 0xFFFFFFFF


def _word_times(x: Column, factor: int) -> Column:
    """``x * factor`` for two words of 32 bits; only its lowest 32 bits are meant, and it stays below 2**50."""
    upper = F.shiftleft((F.shiftright(x, 16) * F.lit(factor)).bitwiseAND(F.lit(0xFFFF)), 16)
    return upper + x.bitwiseAND(F.lit(0xFFFF)) * F.lit(factor)


def _jumped(state: Column, shards: int) -> Column:
    """The next jump, unless the state's next number is past the shards.

    The generator multiplies by a constant modulo 2**64; products of words are cut in halves since bigint must not overflow.
    """
    high, low, at = state["high"], state["low"], state["next"]
    middle = F.shiftright(low, 16) * F.lit(_LOW)
    lowest = F.shiftleft(middle.bitwiseAND(F.lit(0xFFFF)), 16) + low.bitwiseAND(F.lit(0xFFFF)) * F.lit(_LOW) + F.lit(1)
    carry = F.shiftright(middle, 16) + F.shiftright(lowest, 32)
    new_high = (carry + _word_times(high, _LOW) + _word_times(low, _HIGH)).bitwiseAND(F.lit(_WORD))
    moved = F.struct(new_high.alias("high"), lowest.bitwiseAND(F.lit(_WORD)).alias("low"), at.alias("at"))
    draw = (at + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(moved["high"], 1) + 1).cast("double"))
    return F.when(at < shards, moved.withField("next", F.floor(draw))).otherwise(state)


def jumps(shards: int, *keys: Column) -> Column:
    """``struct<high, low, at, next>``: ``at`` is the key's shard among ``shards``, ``next`` (at least ``shards``) where it would go as more are appended.

    The generator starts from the MD5 of the keys' text forms, each with its length in front, so that any stable keys do; a null is a key of its own.
    A key makes about ln(shards) jumps; those with more than the usual number go on, as often as it takes.
    """
    if shards < 1:
        raise ValueError("there must be at least one shard")
    parts = [F.coalesce(F.concat(F.octet_length(k.cast("string")).cast("string"), F.lit(":"), k.cast("string")), F.lit("-")) for k in keys]
    digest = F.md5(F.concat(*parts).cast("binary"))
    word = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    start = F.struct(word(1).alias("high"), word(9).alias("low"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))
    usual = min(shards, 12 + 2 * shards.bit_length())
    walk = lambda state, n: F.aggregate(F.sequence(F.lit(1), F.lit(n)), state, lambda s, _: _jumped(s, shards))
    state = walk(start, usual)
    if usual == shards:  # every jump passes a shard at least, so these are all
        return state
    on = lambda s: F.when(s["next"] < shards, walk(s, shards - usual)).otherwise(s)
    return F.transform(F.array(state), on)[0]


def jump_shard(shards: int, *keys: Column) -> Column:
    """The shard of the keys, from 0."""
    return jumps(shards, *keys)["at"].cast("int")


def in_order(rows: DataFrame, shard_col: str, order: list[str], slot_col: str, name: str) -> DataFrame:
    """``rows`` with a gapless number from 0 in each value of ``shard_col``, by ``order``; rows equal in all of it are split as well.

    ``rows`` should be a written table: its plan is run twice, for the ranges and for the rows.
    """
    keys = [F.asc_nulls_first(c) for c in (shard_col, *order)]
    laid = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    laid = staged(laid, name).withColumn("_part", F.shiftright("_place", 33))
    before = Window.partitionBy(shard_col).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = laid.groupBy(shard_col, "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    first = staged(first.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows"), f"{name}-parts")
    # a row for each partition, and one for each shard that ends inside one: tens of bytes for each task of the step above
    joined = laid.join(F.broadcast(first.withColumnRenamed(shard_col, "_shard")), (F.col(shard_col) == F.col("_shard")) & (laid["_part"] == first["_part"]))
    return joined.select(*rows.columns, (F.col("_before") + F.col("_place") - F.col("_first")).alias(slot_col))


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``shard`` depends on the id and on ``shards`` alone (``law`` is ``key``), so rows that share an id, null included, share a shard, and rows with
    equal texts need not.  ``slot`` is the row's place, from 0, among its shard's rows by id (null first), size and checksum; repeated rows have a slot each.
    ``grown_shard`` is the shard with one more of them: the same, or the new one.  ``size`` is the text's bytes in UTF-8 plus ``ROW_BYTES``; a null text has no bytes
    and the checksum 0, as an empty one.  Any length of text will do.  An empty table gives no rows.  Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    keyed = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        jumps(shards, F.col(id_col)).alias("jumps"), F.monotonically_increasing_id().alias("_row"),
    )
    grown = F.when(F.col("jumps.next") == shards, F.lit(shards)).otherwise(F.col("jumps.at"))
    keyed = keyed.select("doc_id", "size", "text_crc32", F.col("jumps.at").cast("int").alias("shard"), grown.cast("int").alias("grown_shard"), "_row")
    placed = in_order(staged(keyed, "shard-keys"), "shard", ["doc_id", "size", "text_crc32", "_row"], "slot", "shard-order")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def moved(docs: DataFrame, before: int, after: int, id_col: str = "doc_id") -> DataFrame:
    """Rows whose shard changes as shards are appended, with ``shard_before`` and ``shard``; all of these lie in the new shards.

    Columns of these two names that the rows have already are replaced.  Nulls and repeated rows: see ``sharded``.
    """
    if after < before:
        raise ValueError("shards can only be appended")
    marked = docs.withColumn("shard_before", jump_shard(before, F.col(id_col))).withColumn("shard", jump_shard(after, F.col(id_col)))
    return marked.where("shard <> shard_before")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """The rows with all their columns as Parquet, a folder ``shard=...`` for each shard, in files of about ``file_bytes`` of text (less as compressed).

    A shard's rows are dealt over its files by a hash of id and place, so that one id with many rows fills several files.
    A column ``shard`` that the rows have already is replaced.
    """
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0
    files = max(1, -(-total // (shards * file_bytes)))
    marked = docs.withColumn("shard", jump_shard(shards, F.col(id_col)))
    file = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.monotonically_increasing_id()), F.lit(files))
    dealt = marked.withColumn("_file", file).repartition(max(1, min(shards * files, 20_000)), "shard", "_file").drop("_file")
    dealt.write.partitionBy("shard").parquet(path)


def sharding_sql(shards: int = SHARDS) -> str:
    """Equivalent SQL: the generator in 128-bit numbers, the checksum a byte at a time."""
    return f"""
WITH tab AS MATERIALIZED (
  SELECT list(r ORDER BY i) t FROM (
    SELECT i, list_reduce([CAST(i AS UINTEGER), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS UINTEGER)) ELSE a >> 1 END) r
    FROM range(256) x(i))),
raw AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + {ROW_BYTES} AS BIGINT) size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda k: CAST('0x' || k AS UINTEGER)) z,
    CAST('0x' || substr(md5(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-')), 1, 16) AS HUGEINT) k
  FROM documents),
sums AS (
  SELECT doc_id, size, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UINTEGER), z), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), CAST(4294967295 AS UINTEGER)) AS BIGINT) text_crc32,
    list_reduce(list_prepend({{'k': k, 'at': CAST(-1 AS BIGINT), 'next': CAST(0 AS BIGINT)}}, list_transform(range({shards}), lambda i: {{'k': CAST(0 AS HUGEINT), 'at': CAST(0 AS BIGINT), 'next': CAST(0 AS BIGINT)}})),
      lambda a, x: CASE WHEN a.next >= {shards} THEN a ELSE {{
        'k': ((a.k >> 32) * 2862933555777941757 % 4294967296 * 4294967296 + (a.k & 4294967295) * 2862933555777941757 + 1) % 18446744073709551616, 'at': a.next,
        'next': CAST(floor((a.next + 1) * (2147483648.0::DOUBLE / CAST(((((a.k >> 32) * 2862933555777941757 % 4294967296 * 4294967296 + (a.k & 4294967295) * 2862933555777941757 + 1) % 18446744073709551616) >> 33) + 1 AS DOUBLE))) AS BIGINT)}} END) j
  FROM raw, tab)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(j.at AS INTEGER) AS shard, row_number() OVER (PARTITION BY j.at ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
  CAST(CASE WHEN j.next = {shards} THEN {shards} ELSE j.at END AS INTEGER) AS grown_shard
FROM sums"""
