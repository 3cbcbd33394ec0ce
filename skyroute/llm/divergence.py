"""Audit of how the sources of a language differ in their words, by integer dictionaries.

Documents are reduced to counts of (lang, source, term) in the tasks that read them, and these meet by term.  A language's terms
are dealt into *chunks*; a chunk's kept terms form a sorted array, ``searchsorted`` gives each term its id there, and ``bincount``
a dense vector of counts for each group.  Since ids follow the bytes of the terms, ties need no look at the terms themselves.
A chunk's vectors give its share of every pair's divergence and its ten strongest terms of each group; sums and ranks of these are Spark's.

A task holds one chunk: ``CHUNK_CELLS`` cells at most, since the number of chunks follows the number of rows and sources.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyroute.llm import words as W
from skyroute.llm.tables import staged
from skyroute.llm.terms import NOT_LETTERS, term_counts

#: Documents of a language that must hold a term.
LEAST_DOCS = 10
TOP_TERMS = 10
#: Counts in the dense vectors of one chunk, at most (but for a single term of very many sources).
CHUNK_CELLS = 1 << 20
#: Rows of counts that a task gathers before it adds up those of the same term.
HELD_ROWS = 300_000
#: Groups up to which their totals are broadcast; beyond it they are joined.
BROADCAST_GROUPS = 200_000
_SALTS = 64

_COUNTS = "lang string, source string, term string, n long, docs long"
_CHUNK = "lang string, chunk long, terms array<string>, sources array<string>, sums array<long>, counts array<long>"
_FOUND = "lang string, source string, part string, item string, value long"


def _added(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return out.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(["lang", "source", "term", "n", "docs"])


def group_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term in each group, of rows ``lang, source, text`` without nulls."""

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            for chunk in W.chunks(batch, "text"):
                found = term_counts(chunk.column(2), NOT_LETTERS)
                lang, source = chunk.column(0).dictionary_encode(), chunk.column(1).dictionary_encode()
                group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
                cells, at = np.unique(group[found.text] * max(1, len(found.terms)) + found.term, return_inverse=True)
                if not len(cells):
                    continue
                group, term = np.divmod(cells, len(found.terms))
                held.append(
                    pa.table(
                        {
                            "lang": lang.dictionary.take(pa.array(group // len(source.dictionary))), "source": source.dictionary.take(pa.array(group % len(source.dictionary))),
                            "term": found.terms.take(pa.array(term)).cast(pa.large_string()).cast(pa.string()), "n": np.bincount(at, weights=found.count).astype(np.int64), "docs": np.bincount(at),
                        }
                    )
                )
                rows += len(cells)
                if rows > HELD_ROWS:
                    held = [_added(held)]
                    rows = held[0].num_rows
                    if 2 * rows > HELD_ROWS:
                        yield from held[0].to_batches(max_chunksize=50_000)
                        held, rows = [], 0
        if held:
            yield from _added(held).to_batches(max_chunksize=50_000)

    return docs.mapInArrow(run, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def encoded(counts: DataFrame, chunks: int, least_docs: int = LEAST_DOCS) -> DataFrame:
    """A row for each chunk with kept terms: these in the order of their bytes, its sources, their sums, and a dense vector of counts for each source, joined."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        term = group["term"].cast(pa.binary()).to_numpy()
        names = np.unique(term)
        docs = np.bincount(np.searchsorted(names, term), weights=group["docs"].to_numpy(), minlength=len(names))
        names = names[docs >= least_docs]
        out = {"lang": group["lang"][:1], "chunk": group["chunk"][:1]}
        if not len(names):
            return pa.table({**{k: v[:0] for k, v in out.items()}, "terms": pa.array([], pa.list_(pa.string())), "sources": pa.array([], pa.list_(pa.string())), "sums": pa.array([], pa.list_(pa.int64())), "counts": pa.array([], pa.list_(pa.int64()))})
        ids = np.minimum(np.searchsorted(names, term), len(names) - 1)
        kept = names[ids] == term
        source = group["source"].cast(pa.binary()).to_numpy()[kept]
        sources = np.unique(source)
        cells = np.searchsorted(sources, source) * len(names) + ids[kept]
        dense = np.bincount(cells, weights=group["n"].to_numpy()[kept], minlength=len(sources) * len(names)).astype(np.int64)
        texts = lambda x: pa.array([[v.decode() for v in x]], pa.list_(pa.string()))
        sums = dense.reshape(len(sources), -1).sum(axis=1)
        return pa.table(out | {"terms": texts(names), "sources": texts(sources), "sums": pa.array([sums], pa.list_(pa.int64())), "counts": pa.array([dense], pa.list_(pa.int64()))})

    chunk = F.pmod(F.xxhash64("term"), F.lit(chunks))
    return counts.withColumn("chunk", chunk).groupBy("lang", "chunk").applyInArrow(run, _CHUNK)


def billionths(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 2) / total) without rounding, by long division; for totals below 9 * 10**15."""
    rest, out = counts + 2, np.zeros_like(counts)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _scored(chunks: DataFrame, top: int) -> DataFrame:
    """Each chunk's share of the pairs' divergences, and its strongest terms of each group."""

    def score(row: dict):
        terms, groups, kept = row["terms"], row["groups"], row["kept"]
        counts = np.zeros((len(groups), len(terms)), dtype=np.int64)
        place = {g["source"]: k for k, g in enumerate(groups)}
        counts[[place[s] for s in row["sources"]]] = np.array(row["counts"], dtype=np.int64).reshape(-1, len(terms))
        totals = [g["total"] for g in groups]
        p = np.stack([billionths(c, n + 2 * kept) for c, n in zip(counts, totals, strict=True)])
        q = billionths(counts.sum(axis=0), sum(totals) + 2 * kept)
        names = [g["source"] for g in groups]
        for k, name in enumerate(names):
            sums = divergence(p[k], p[k + 1 :]).sum(axis=1).tolist()
            others = names[k + 1 :]
            yield [name] * len(others) + others, ["pair"] * (2 * len(others)), others + [name] * len(others), sums + sums
            strong = np.flatnonzero((counts[k] > 0) & (p[k] > q))
            value = divergence(p[k][strong], q[strong])
            best = np.lexsort((strong, -value))[:top]
            yield [name] * len(best), ["term"] * len(best), [terms[i] for i in strong[best]], value[best].tolist()

    def run(batches):
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                held: list[list] = [[], [], [], []]
                for found in score(row):
                    for column, values in zip(held, found, strict=True):
                        column.extend(values)
                    if len(held[0]) >= 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(held[0])), *map(pa.array, held)], names=["lang", "source", "part", "item", "value"])
                        held = [[], [], [], []]
                if held[0]:
                    yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(held[0])), *map(pa.array, held)], names=["lang", "source", "part", "item", "value"])

    return chunks.mapInArrow(run, _FOUND)


def source_divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", *, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, chunk_cells: int = CHUNK_CELLS
) -> DataFrame:
    """``lang, source, part, item, value, rank``: how each source differs from the others of its language, and its terms that stand out most.

    Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; a language keeps those in at least ``least_docs`` of its documents.
    Part ``pair`` has every other source with the divergence summed over all kept terms (0 where none is kept), part ``term`` the ``top`` kept terms that the source uses more
    than its language does.  Ranks go by value, the highest first, then by the item's bytes.

    A null text, lang or source counts as an empty one; each row is a document, repeated rows too; ids are not looked at.  A text without terms still makes its group known.
    A language with one source has no pairs.  An empty table gives no rows.  Other columns are ignored, whatever their names.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    plain = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    groups = staged(plain.select("lang", "source").distinct(), "divergence-groups")
    counts = staged(group_counts(plain), "divergence-counts")
    sources = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    size = counts.groupBy("lang").count().join(sources, "lang").agg(F.max(F.col("count") * F.col("sources"))).first()[0] or 0
    chunks = staged(encoded(counts, max(1, -(-size // chunk_cells)), least_docs), "divergence-chunks")

    kept = chunks.groupBy("lang").agg(F.sum(F.size("terms")).alias("kept"))
    sums = chunks.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.sums").alias("total"))
    known = groups.join(sums, ["lang", "source"], "left").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("groups"))
    known = staged(known.join(kept, "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0))), "divergence-totals")

    rows = chunks.drop("sums")
    if groups.count() <= BROADCAST_GROUPS:
        rows = rows.join(F.broadcast(known), "lang")
    else:  # a language's chunks are dealt over salts, each with the totals once
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod("chunk", F.lit(_SALTS)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")
    found = staged(_scored(rows, top), "divergence-found")

    nothing = known.where("kept = 0").select("lang", "groups", F.explode("groups.source").alias("source")).select("lang", "source", F.explode("groups.source").alias("item"))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(nothing.where("source <> item").withColumns({"part": F.lit("pair"), "value": F.lit(0).cast("long")}))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () r, coalesce(lang, '') lang, coalesce(source, '') source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w
  FROM documents),
c AS (SELECT lang, source, term, count(*) n, count(DISTINCT r) docs FROM (SELECT r, lang, source, unnest(w) term FROM d) GROUP BY ALL),
k AS (SELECT lang, term FROM c GROUP BY ALL HAVING sum(docs) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) v FROM k GROUP BY ALL),
a AS (SELECT g.lang, g.source, k.term, CAST(coalesce(c.n, 0) AS HUGEINT) n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) p FROM a JOIN v USING (lang)),
l AS (SELECT lang, term, sum(n) n FROM a GROUP BY ALL),
q AS (SELECT lang, term, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v) q FROM l JOIN v USING (lang)),
pairs AS (SELECT x.lang, x.source, y.source item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
rows_ AS (
  SELECT g.lang, g.source, 'pair' part, h.source item, coalesce(value, 0) value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN pairs ON pairs.lang = g.lang AND pairs.source = g.source AND pairs.item = h.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) r FROM rows_)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= 10"""
