"""Ranked lexical search by TPUT (three-phase uniform threshold) over term-partitioned postings.

Texts are split once.  A task turns a *block* of documents into a posting list piece for each term of the queries, so that a list is always in
pieces of at most a block, whatever its length; pieces are laid out by term, with their impacts (a score without its term's weight).

1. *List heads.*  The ``head`` highest impacts of every list, added up by document, give each query a lower bound of its k-th best score.
2. *Uniform threshold.*  Every list sends its impacts of at least bound / lists.  A document that no list sends can't reach the bound.  Sums by block give
   partial scores, and what the lists held back gives upper bounds; documents whose upper bound is below the k-th best partial score go.
3. *Lookup.*  The lists are asked for the exact impacts of the documents that are left and not yet known exactly.

Queries are taken in shards of ``SHARD_PAIRS`` (query, term) pairs; a shard is what the driver and each task hold of them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyroute.llm import words as W
from skyroute.llm.tables import staged
from skyroute.llm.terms import NOT_LETTERS_OR_DIGITS, term_counts

TOP = 10
#: Entries of a list's head.  Longer heads give higher bounds, so that lists send less and more documents have to be looked up.
HEAD = 10
BLOCK_BYTES = 8 << 20
#: Pieces of a list that a task of the layout by term takes together.
SEGMENT = 64
#: (query, term) pairs of a shard.
SHARD_PAIRS = 500_000
#: Bytes of query terms up to which they are broadcast to the tasks that split texts; beyond it, postings of all terms are made and joined.
BROADCAST_BYTES = 32 << 20
#: Scores that a task holds at once.
CELLS = 1 << 21

_PIECES = "block long, term string, at array<int>, times array<int>, lengths array<int>, docs long, total long, ids array<long>"
_LISTS = "block long, term string, at array<int>, impact array<int>, best int"
_HEADS = "term string, block long, at int, impact int"
_CANDIDATES = "item string, block long, at int, doc_id long, partial long, upper long"


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and where each row's begin and end."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def query_terms(items: DataFrame) -> DataFrame:
    """``item, term, times`` of rows ``item, text``."""

    def run(batches):
        for batch in batches:
            for chunk in W.chunks(batch, "text"):
                found = term_counts(chunk.column(1), NOT_LETTERS_OR_DIGITS)
                yield pa.RecordBatch.from_arrays(
                    [chunk.column(0).take(pa.array(found.text)), found.terms.take(pa.array(found.term)).cast(pa.large_string()).cast(pa.string()), pa.array(found.count, pa.int64())],
                    names=["item", "term", "times"],
                )

    return items.mapInArrow(run, "item string, term string, times long").groupBy("item", "term").agg(F.sum("times").alias("times"))


def posting_pieces(docs: DataFrame, wanted: list[bytes] | None) -> DataFrame:
    """Pieces of the lists of the wanted terms (None: of all), and for each block a row of the term '' with its documents, of rows ``doc_id, text``.

    ``at`` are places of documents in the block, ``times`` the term's occurrences there, ``lengths`` the documents' terms with repeats.
    """
    known = docs.sparkSession.sparkContext.broadcast(None if wanted is None else pa.array(sorted(wanted), pa.large_binary()))

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        for batch in batches:
            for chunk in W.chunks(batch, "text", BLOCK_BYTES):
                found = term_counts(chunk.column(1), NOT_LETTERS_OR_DIGITS)
                total = found.totals(len(chunk))
                at = np.flatnonzero(total)
                if not len(at):
                    continue
                text, term, count, terms = found.text, found.term, found.count, found.terms
                if known.value is not None:
                    place = pc.index_in(terms, known.value)
                    of = place.fill_null(-1).to_numpy()
                    kept = of[term] >= 0
                    text, term, count, terms = text[kept], of[term[kept]], count[kept], known.value
                order = np.argsort(term, kind="stable")
                text, term, count = text[order], term[order], count[order]
                first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
                size = np.diff(np.r_[first, len(term)])
                offsets = np.r_[0, np.cumsum(np.r_[len(at), size])]  # the row of the block's documents, then the pieces
                names = pa.concat_arrays([pa.array([b""], pa.large_binary()), terms.take(pa.array(term[first]))])
                rows = len(names)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(rows, block)), names.cast(pa.large_string()).cast(pa.string()), _lists(np.r_[at, text], offsets, pa.int32()), _lists(np.r_[at * 0, count], offsets, pa.int32()),
                        _lists(np.r_[total[at], total[text]], offsets, pa.int32()), pa.array(np.r_[len(at), size]), pa.array(np.r_[total.sum(), size * 0]),
                        _lists(chunk.column(0).to_numpy()[at], np.minimum(np.arange(rows + 1), 1) * len(at), pa.int64()),
                    ],
                    names=["block", "term", "at", "times", "lengths", "docs", "total", "ids"],
                )
                block += 1

    return docs.mapInArrow(run, _PIECES)


def impacts(times: np.ndarray, lengths: np.ndarray, docs: int, total: int) -> np.ndarray:
    """(10**9 * times) div (1000 * times + 8 * m), m = 25 + (75 * length * docs) div total; in Python's numbers where a product needs more than 64 bits."""
    if len(lengths) and int(lengths.max()) * 75 * docs >= 1 << 63:
        scaled = np.array([75 * int(n) * docs // total for n in lengths], dtype=np.int64)
    else:
        scaled = 75 * lengths * docs // total
    return 1_000_000_000 * times // (1000 * times + 8 * (25 + scaled))


def posting_lists(pieces: DataFrame, docs: int, total: int) -> DataFrame:
    """The pieces with impacts, laid out by term: a list's pieces lie together, a long list's in several segments."""

    def run(batches):
        for batch in batches:
            times, offsets = _flat(batch.column(2))
            impact = impacts(times.astype(np.int64), _flat(batch.column(3))[0].astype(np.int64), docs, total)
            best = np.maximum.reduceat(impact, offsets[:-1]) if len(impact) else impact
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(4), _lists(impact, offsets, pa.int32()), pa.array(best, pa.int32())], names=["block", "term", "at", "impact", "best"]
            )

    made = pieces.select("block", "term", "times", "lengths", "at").mapInArrow(run, _LISTS)
    return made.withColumn("segment", F.expr(f"block div {SEGMENT}")).repartition("term", "segment").drop("segment").sortWithinPartitions("term", "block")


def list_heads(lists: DataFrame, head: int) -> DataFrame:
    """``term, block, at, impact``: the ``head`` highest entries of each list; each task keeps as many of its part of a list."""

    def run(batches):
        for batch in batches:
            term = batch.column(1).dictionary_encode().indices.to_numpy()
            at, offsets = _flat(batch.column(2))
            impact, block = _flat(batch.column(3))[0], batch.column(0).to_numpy()
            first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
            bounds = offsets[np.r_[first, len(batch)]]
            chosen = []
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = impact[low:high]
                chosen.append(low + (np.argpartition(-own, head - 1)[:head] if high - low > head else np.arange(high - low)))
            chosen = np.concatenate(chosen)
            row = np.searchsorted(offsets, chosen, side="right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(row)), pa.array(block[row]), pa.array(at[chosen]), pa.array(impact[chosen])], names=["term", "block", "at", "impact"])

    order = Window.partitionBy("term").orderBy(F.desc("impact"), "block", "at")
    found = lists.select("block", "term", "at", "impact").mapInArrow(run, _HEADS)
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= head).drop("place")


class QueryShard:
    """Some queries: their (item, term, weight) pairs by item, bounds, and how far each list is held back."""

    def __init__(self, rows: list, top: int):
        """``rows``: (item, term, weight, best impact of the list, lower bound of the item's score at rank ``top``), sorted by item."""
        self.top = top
        self.items = list(dict.fromkeys(r[0] for r in rows))
        self.terms = {t: k for k, t in enumerate(dict.fromkeys(r[1] for r in rows))}
        place = {x: k for k, x in enumerate(self.items)}
        self.item, self.term = np.array([place[r[0]] for r in rows]), np.array([self.terms[r[1]] for r in rows])
        self.weight = np.array([r[2] for r in rows], dtype=np.int64)
        self.bound = np.zeros(len(self.items), dtype=np.int64)
        self.bound[self.item] = [r[4] for r in rows]
        lists = np.bincount(self.item)
        own = -(-self.bound[self.item] // (lists[self.item] * self.weight))  # least impact that the uniform threshold lets through
        self.least = np.full(len(self.terms), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.term, own)
        best = np.zeros(len(self.terms), dtype=np.int64)
        best[self.term] = [r[3] for r in rows]
        self.held = np.maximum(np.minimum(self.least - 1, best), 0)  # most that an entry not sent may have

    def candidates(self, sent: dict[int, tuple[np.ndarray, np.ndarray]], docs: int):
        """(item, place of the document, partial score, upper bound) of the documents of a block that may be among an item's best."""
        step = max(1, CELLS // max(1, docs))
        for low in range(0, len(self.items), step):
            a, b = np.searchsorted(self.item, (low, low + step))
            item, term, weight = self.item[a:b] - low, self.term[a:b], self.weight[a:b]
            n = min(step, len(self.items) - low)
            partial, upper = np.zeros((n, docs), np.int64), np.zeros((n, docs), np.int64)
            upper += np.bincount(item, weights=weight * self.held[term], minlength=n).astype(np.int64)[:, None]
            order = np.argsort(term, kind="stable")
            first = np.flatnonzero(np.r_[True, term[order][1:] != term[order][:-1]])
            for own in np.split(order, first[1:]):
                t = int(term[own[0]])
                if t in sent:
                    at, impact = sent[t]
                    cells = np.ix_(item[own], at)
                    partial[cells] += weight[own][:, None] * impact
                    upper[cells] += weight[own][:, None] * (impact - self.held[t])
            bound = self.bound[low : low + n]
            if docs >= self.top:  # so many documents of this block alone reach this partial score
                bound = np.maximum(bound, np.partition(partial, docs - self.top, axis=1)[:, docs - self.top])
            who, where = np.nonzero((upper >= bound[:, None]) & (upper > 0))
            yield low + who, where, partial[who, where], upper[who, where]


def _fetched(lists: DataFrame, shard) -> DataFrame:
    """What the lists send: ``block, term, at, impact`` with impacts of at least the shard's threshold for the term."""

    def run(batches):
        own = shard.value
        for batch in batches:
            number = np.array([own.terms.get(t, -1) for t in batch.column(1).to_pylist()])
            least = np.where(number >= 0, own.least[number], np.iinfo(np.int64).max)
            rows = np.flatnonzero(batch.column(4).to_numpy() >= least)
            if not len(rows):
                continue
            batch = batch.take(pa.array(rows))
            at, offsets = _flat(batch.column(2))
            impact = _flat(batch.column(3))[0]
            sent = impact >= np.repeat(least[rows], np.diff(offsets))
            offsets = np.r_[0, np.cumsum(sent)][offsets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _lists(at[sent], offsets, pa.int32()), _lists(impact[sent], offsets, pa.int32())], names=["block", "term", "at", "impact"]
            )

    return lists.select("block", "term", "at", "impact", "best").mapInArrow(run, "block long, term string, at array<int>, impact array<int>")


def _candidates(fetched: DataFrame, blocks: DataFrame, shard) -> DataFrame:
    """Documents that may be among an item's best, with partial scores and upper bounds, from the lists' entries and the documents of each block."""

    def run(group: pa.Table) -> pa.Table:
        own, group = shard.value, group.combine_chunks()
        terms = group["term"].to_pylist()
        head = terms.index("")
        ids, places = group["ids"][head].values.to_numpy(), group["at"][head].values.to_numpy()
        sent = {
            own.terms[t]: (np.searchsorted(places, group["at"][k].values.to_numpy()), group["impact"][k].values.to_numpy().astype(np.int64)) for k, t in enumerate(terms) if k != head
        }
        found = list(own.candidates(sent, len(ids)))
        item, where, partial, upper = (np.concatenate([x[k] for x in found]) for k in range(4))
        names = pa.array(own.items, pa.string()).take(pa.array(item))
        return pa.table({"item": names, "block": np.full(len(item), group["block"][0].as_py()), "at": places[where], "doc_id": ids[where], "partial": partial, "upper": upper})

    rows = fetched.withColumn("ids", F.lit(None).cast("array<long>")).unionByName(blocks.select("block", "term", "at", F.lit(None).cast("array<int>").alias("impact"), "ids"))
    return rows.groupBy("block").applyInArrow(run, _CANDIDATES)


def _looked_up(lists: DataFrame, asked: DataFrame) -> DataFrame:
    """``term, block, at, impact`` of the entries asked for (``term, block, at``), where there are such."""

    def run(batches):
        for batch in batches:
            (at, ends), impact, (want, want_ends) = _flat(batch.column(2)), _flat(batch.column(3))[0], _flat(batch.column(4))
            row = np.repeat(np.arange(len(batch)), np.diff(ends))
            asked_of = np.repeat(np.arange(len(batch)), np.diff(want_ends))
            found = np.flatnonzero(np.isin((row << 32) + at, (asked_of << 32) + want))
            places = pa.array(row[found])
            yield pa.RecordBatch.from_arrays([batch.column(1).take(places), batch.column(0).take(places), pa.array(at[found]), pa.array(impact[found])], names=["term", "block", "at", "impact"])

    wanted = asked.groupBy("term", "block").agg(F.collect_set("at").alias("wanted"))
    return lists.drop("best").join(wanted, ["term", "block"]).select("block", "term", "at", "impact", "wanted").mapInArrow(run, _HEADS)


def _searched(lists: DataFrame, heads: DataFrame, blocks: DataFrame, pairs: DataFrame, top: int) -> DataFrame:
    """``item, doc_id, score`` of documents among which each item's best are, for a shard's pairs ``item, term, weight, best``."""
    spark = lists.sparkSession
    sums = heads.join(pairs, "term").groupBy("item", "block", "at").agg(F.sum(F.col("weight") * F.col("impact")).alias("partial"))
    by_item = lambda value: Window.partitionBy("item").orderBy(F.desc(value), "block", "at")
    bounds = sums.withColumn("place", F.row_number().over(by_item("partial"))).where(F.col("place") == top).select("item", F.col("partial").alias("bound"))
    rows = pairs.join(bounds, "item", "left").select("item", "term", "weight", "best", F.coalesce("bound", F.lit(0)).alias("bound"))
    rows = sorted(tuple(r) for r in rows.toLocalIterator())  # SHARD_PAIRS, or one item's
    if not rows:
        return spark.createDataFrame([], "item string, doc_id long, score long")
    shard = spark.sparkContext.broadcast(QueryShard(rows, top))
    found = staged(_candidates(_fetched(lists, shard), blocks, shard), "search-candidates")

    least = found.withColumn("place", F.row_number().over(by_item("partial"))).where(F.col("place") == top).select("item", F.col("partial").alias("least"))
    left = found.join(least, "item", "left").where("upper >= coalesce(least, 0)").drop("least")
    known = left.where("partial = upper").select("item", "doc_id", F.col("partial").alias("score"))
    open_ = staged(left.where("partial < upper").select("item", "block", "at", "doc_id"), "search-open")
    entries = open_.join(pairs, "item").select("item", "block", "at", "doc_id", "term", "weight")
    exact = entries.join(_looked_up(lists, entries.select("term", "block", "at")), ["term", "block", "at"])
    exact = exact.groupBy("item", "block", "at", "doc_id").agg(F.sum(F.col("weight") * F.col("impact")).alias("score")).select("item", "doc_id", "score")
    return staged(known.unionByName(exact), "search-scores")


def ranked_search(
    docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, top: int = TOP, head: int = HEAD,
    shard_pairs: int = SHARD_PAIRS, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: each query's ``top`` documents with a score above 0, equal scores by ascending id.

    Terms are ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  With N documents that hold a term, L terms with repeats in all of them, n in one,
    df documents that hold the term and tf its occurrences in one, a term weighs w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))), and a document's score sums
    w * ((10**9 * tf) div (1000 * tf + 8 * m)), m = 25 + (75 * n * N) div L, over the query's terms, repeats included.

    A null or wordless text, of a document or a query, has no terms.  Rows with a null id, of either table, take no part.  Each row of a document is one of its own, so rows that
    share an id may take several ranks; rows of queries that share an id are one query, of the terms of their different texts.  Empty tables give no rows.
    Other columns are ignored, whatever their names.
    """
    kind = queries.schema[item_col].dataType
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    items = queries.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("item is not null").distinct()
    asked = staged(query_terms(items), "search-queries")
    names = asked.select("term").distinct()
    size = names.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    if size <= broadcast_bytes:
        pieces = posting_pieces(docs, [r.term.encode() for r in names.toLocalIterator()])
    else:
        pieces = posting_pieces(docs, None)
        pieces = pieces.join(names.union(asked.sparkSession.createDataFrame([("",)], "term string")), "term", "left_semi").select(*pieces.columns)
    pieces = staged(pieces, "search-pieces")
    blocks, pieces = pieces.where("term = ''"), pieces.where("term <> ''")
    count, total = blocks.agg(F.sum("docs"), F.sum("total")).first()
    lists = staged(posting_lists(pieces, count or 0, total or 1), "search-lists")

    weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * (count or 0) + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    frequency = pieces.groupBy("term").agg(F.sum("docs").alias("df"))
    best = lists.groupBy("term").agg(F.max("best").cast("long").alias("best"))
    pairs = asked.join(frequency, "term").join(best, "term").select("item", "term", (F.col("times") * weight).alias("weight"), "best").where("weight > 0")
    pairs = staged(pairs, "search-pairs")
    heads = staged(list_heads(lists, head), "search-heads")
    shards = max(1, -(-pairs.count() // shard_pairs))
    shard = F.pmod(F.xxhash64("item"), F.lit(shards))
    found = reduce(DataFrame.unionByName, [_searched(lists, heads, blocks, pairs.where(shard == k), top) for k in range(shards)])
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = found.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(F.col("item").cast(kind).alias("item_id"), "rank", "doc_id", "score")


RANKED_SQL = r"""
WITH d AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w FROM documents WHERE doc_id IS NOT NULL),
c AS (SELECT CAST(count(*) AS BIGINT) all_docs, CAST(sum(len(w)) AS BIGINT) all_terms FROM d WHERE len(w) > 0),
t AS (SELECT r, doc_id, n, term, CAST(count(*) AS BIGINT) tf FROM (SELECT r, doc_id, CAST(len(w) AS BIGINT) n, unnest(w) term FROM d) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) w FROM t, c GROUP BY term, all_docs),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term FROM (SELECT DISTINCT item_id, text FROM benchmark) WHERE item_id IS NOT NULL),
s AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * all_docs) // all_terms)))) score FROM q JOIN f USING (term) JOIN t USING (term), c GROUP BY ALL),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM k WHERE rank <= 10"""
