"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the ``window``-word runs of the benchmark items (a shorter item is one pattern).
For each pattern length a table gives, for a block of words, how far a search position can skip
because no pattern holds that block further right; where the skip is 0 the block ends some pattern, a
bucket keyed by the block's hash selects those patterns, and their words are compared directly.

The search is a map over the documents: nothing is shuffled.  Many positions advance at the same
time: each document is cut into lanes of ``LANE`` window starts, and one numpy step moves all lanes.
The tables are broadcast, as files, in shards of about ``shard_words`` words; a task takes some texts (about ``BATCH_BYTES``)
and searches them with one shard after the other, so that it holds one shard at a time and the documents are scanned once.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyroute.llm import words as W

WINDOW = 10
#: Words of one search block.
BLOCK = 2
#: Window starts that one lane covers.
LANE = 64
SHARD_WORDS = 2_000_000
#: Bytes of text that a task searches with each shard before it takes more.
BATCH_BYTES = 32 << 20
_SHIFT_BITS = 18

SCHEMA = "doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>"


class PatternTable:
    """Patterns of one length in words."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[str]]):
        self.length, self.block = length, min(BLOCK, length)
        self.words, self.items = list(patterns), list(patterns.values())
        text = pa.array([b" ".join(x) for x in self.words], pa.large_binary())
        hashes = W.split(text, W.NOT_ALPHANUMERIC).hashes.reshape(-1, length)
        self.hashes = hashes
        blocks = np.stack([W.windows(h, self.block) for h in hashes])  # at each place of each pattern
        most = length - self.block + 1
        self.shift = np.full(1 << _SHIFT_BITS, most, dtype=np.int32)
        for place in range(blocks.shape[1]):
            np.minimum.at(self.shift, self._slot(blocks[:, place]), most - 1 - place)
        order = np.argsort(blocks[:, -1], kind="stable")
        self.suffixes, self.order = blocks[order, -1], order

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - _SHIFT_BITS)).astype(np.int64)

    def search(self, words: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every occurrence inside one document."""
        m = self.length
        n = np.maximum(words.counts - m + 1, 0)  # window starts of each document
        lanes = -(-n // LANE)
        total = int(lanes.sum())
        none = np.zeros(0, dtype=np.int64)
        if not total:
            return none, none
        doc = np.repeat(np.arange(len(n)), lanes)
        nth = np.arange(total) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = words.first[doc] + nth * LANE
        stop = np.minimum(at + LANE, words.first[doc] + n[doc])
        blocks = W.windows(words.hashes, self.block)
        tail = m - self.block
        found = []
        while len(at):
            skip = self.shift[self._slot(blocks[at + tail])]
            found.append(at[skip == 0])
            at = at + np.maximum(skip, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        at = np.concatenate(found)
        suffix = blocks[at + tail]
        low, high = np.searchsorted(self.suffixes, suffix, "left"), np.searchsorted(self.suffixes, suffix, "right")
        size = high - low
        at = np.repeat(at, size)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        pattern = self.order[np.repeat(low, size) + nth]
        for k in range(m):  # hashes first; the words themselves decide
            same = words.hashes[at + k] == self.hashes[pattern, k]
            at, pattern = at[same], pattern[same]
        sure = [
            all(
                words.data[words.starts[i + k] : words.ends[i + k]].tobytes() == word
                for k, word in enumerate(self.words[p])
            )
            for i, p in zip(at.tolist(), pattern.tolist(), strict=True)
        ]
        return at[sure], pattern[sure]


def pattern_tables(items: list[tuple[str, str | None]], window: int = WINDOW) -> list[PatternTable]:
    """Tables for (item id, text) pairs, one for each pattern length that occurs."""
    patterns: dict[int, dict[tuple[bytes, ...], list[str]]] = defaultdict(lambda: defaultdict(list))
    for item, text in items:
        found = W.split(pa.array([text], pa.large_string()), W.NOT_ALPHANUMERIC, lower=True)
        words = [found.data[a:b].tobytes() for a, b in zip(found.starts, found.ends, strict=True)]
        if not words:
            continue
        k = min(window, len(words))
        for i in range(len(words) - k + 1):
            own = patterns[k][tuple(words[i : i + k])]
            if not own or own[-1] != item:
                own.append(item)
    return [PatternTable(k, dict(x)) for k, x in sorted(patterns.items())]


def _spans(at: np.ndarray, length: np.ndarray) -> tuple[list[int], list[int]]:
    """Occurrences merged to disjoint spans."""
    order = np.argsort(at, kind="stable")
    starts, ends = at[order], np.maximum.accumulate((at + length)[order])
    new = np.r_[True, starts[1:] > ends[:-1]]
    return starts[new].tolist(), ends[np.r_[new[1:], True]].tolist()


def _searched(docs: DataFrame, shards: list) -> DataFrame:
    """Hits of all shards, each a broadcast variable, for each row of (doc_id, text)."""

    def found(chunks: list[pa.RecordBatch]):
        hits = [defaultdict(list) for _ in chunks]
        counts = [None] * len(chunks)
        for shard in shards:
            tables = shard.value
            if len(shards) > 1:
                vars(shard).pop("_value")  # read from the local file again next time, instead of holding every shard
            for c, chunk in enumerate(chunks):
                words = W.split(chunk.column(1), W.NOT_ALPHANUMERIC, lower=True)
                counts[c] = words.counts.astype(np.int64)
                for table in tables:
                    at, pattern = table.search(words)
                    doc = np.searchsorted(words.first, at, side="right") - 1
                    for d, a, p in zip(doc.tolist(), at.tolist(), pattern.tolist(), strict=True):
                        hits[c][d].append((a - int(words.first[d]), table.length, table.items[p]))
        for c, chunk in enumerate(chunks):
            starts, ends, items = [], [], []
            for d in range(len(chunk)):
                own = hits[c].get(d)
                if own:
                    s, e = _spans(np.array([x[0] for x in own]), np.array([x[1] for x in own]))
                starts.append(s if own else [])
                ends.append(e if own else [])
                items.append(sorted({i for x in own for i in x[2]}) if own else [])
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.column(0), pa.array(counts[c]), pa.array(starts, pa.list_(pa.int32())),
                    pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())),
                ],
                names=["doc_id", "n_words", "starts", "ends", "items"],
            )

    def run(batches):
        chunks, size = [], 0
        for batch in batches:
            for chunk in W.chunks(batch, "text"):
                chunks.append(chunk)
                size += chunk.nbytes
                if size >= BATCH_BYTES:
                    yield from found(chunks)
                    chunks, size = [], 0
        if chunks:
            yield from found(chunks)

    return docs.mapInArrow(run, SCHEMA)


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    *,
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """One row per document: ``doc_id, n_words, starts, ends, items``.

    ``starts`` and ``ends`` are the disjoint spans of words inside any occurrence of a window, and
    ``items`` the ids, as sorted strings, of the items with occurring windows.  Words are
    ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  A null or wordless text has no
    hit; a null or wordless item has no window; items with a null id are ignored.  Repeated rows are
    judged each.  Empty tables give no rows or no hits.  Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).where(
        "item is not null and text is not null"
    )
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-size // (4 * shard_words)))  # a word and its gap take four characters or more, mostly
    shard = F.pmod(F.xxhash64("item", "text"), F.lit(shards))
    tables = []
    for k in range(shards):
        own = [(r.item, r.text) for r in items.where(shard == k).toLocalIterator()]
        tables.append(spark.sparkContext.broadcast(pattern_tables(own, window)))
    return _searched(docs, tables)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``benchmark_hits`` as counts: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = benchmark_hits(docs, benchmark, **options)
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0), lambda a, x: a + x).cast("long")
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
