"""Substring dedup: words inside a run of ``window`` words that an earlier document has too are removed.

The references are the documents themselves, so their automata can't all be sent to every task: they grow
with the corpus.  Each document that is the first to hold a passage is a reference shard instead, and
its automaton meets just the passages that may match it:

1. *Anchors.*  Of each window the word group with the least hash is its anchor (a minimizer): equal
   windows have equal anchors, and neighbouring windows mostly share one, so a fifth of the words stand for all.
   A semi-join of the anchors with themselves keeps those of two or more documents.
2. *Shards.*  An anchor belongs to the first document that has it.  Runs of windows of one shard are cut out
   of the texts and sent to that shard.  A shard of very many anchors is split by a hash of the anchor, and one that very many
   documents need is dealt in several parts by a hash of the document.
3. *Matching.*  Each task reads a shard's own passages first, builds their suffix automaton, and then streams the
   passages of other documents through it.  Where the matching statistic reaches the window length,
   the window stands in the shard's document, which is the smallest that could hold it.
4. *The rest.*  A window that its shard doesn't hold (the anchor is shared, the window isn't) can still
   repeat in later documents.  Hashes of these windows name the smallest document of each; its leftover passages are a shard
   again, whose automaton the later ones stream through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyroute.llm import words as W
from skyroute.llm.suffix_automaton import SuffixAutomaton
from skyroute.llm.tables import packed, staged

WINDOW = 13
#: Words of an anchor.
ANCHOR = 5
#: Anchors of one automaton, about a fifth of its words.
MOST_ANCHORS = 20_000
#: Anchors of other documents in one part of a shard, and how many of its own each of them has to make up for: every part has these again.
PART_ANCHORS, PER_OWN = 4_000, 4


def window_anchors(hashes: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """Anchor (int64) of the window that begins at each word; windows across documents are the caller's to drop."""
    groups = W.windows(hashes, anchor)
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    least = groups[:n].copy()
    for i in range(1, window - anchor + 1):
        np.minimum(least, groups[i : i + n], out=least)
    return least.view(np.int64)


def _windows_of(words: W.Words, d: int, window: int) -> tuple[int, int]:
    start = int(words.first[d])
    return start, max(start, int(words.first[d + 1]) - window + 1)


def _anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for chunk in W.chunks(batch, "text"):
                words = W.split(chunk.column(1))
                least = window_anchors(words.hashes, window, anchor)
                ids, parts = chunk.column(0).to_numpy(), []
                for d in range(len(ids)):
                    a, b = _windows_of(words, d, window)
                    parts.append(np.unique(least[a:b]))
                if any(map(len, parts)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(parts)), pa.array(np.repeat(ids, [len(p) for p in parts]))], names=["anchor", "id"]
                    )

    return docs.mapInArrow(run, "anchor long, id long")


PASSAGE = "shard long, part int, is_other boolean, id long, start int, text binary"
_PASSAGE_TYPES = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.binary()]


def _batch(rows: list[tuple], schema: str, types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in schema.split(", ")]
    )


def _parts_of(shard: int, split: int, parts: int, doc: int) -> list[int]:
    """The parts of a shard that a passage of one of its splits goes to: all for the shard's own, one for others."""
    if shard == doc:
        return list(range(split * parts, (split + 1) * parts))
    return [split * parts + int(W.mix(np.array([doc], dtype=np.int64).view(np.uint64))[0] % np.uint64(parts))]


def _passages(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """Rows of PASSAGE for packed texts with ``own``, their shared anchors (anchor, shard, parts, splits)."""

    def run(batches):
        for batch in batches:
            for chunk in W.unpacked(batch, "text"):
                words = W.split(chunk.column(1))
                least = window_anchors(words.hashes, window, anchor)
                whole = W.windows(words.hashes, window)
                rows = []
                for d, (doc, own) in enumerate(zip(chunk.column(0).to_pylist(), chunk.column(2), strict=True)):
                    own = own.values
                    known, shards, parts, splits = (own.field(x).to_numpy() for x in ("anchor", "shard", "parts", "splits"))
                    order = np.argsort(known)
                    known, shards, parts, splits = known[order], shards[order], parts[order], splits[order]
                    a, b = _windows_of(words, d, window)
                    if b == a:
                        continue
                    at = np.minimum(np.searchsorted(known, least[a:b]), len(known) - 1)
                    hit = known[at] == least[a:b]
                    mine = hit & (shards[at] == doc)
                    if mine.any():  # of a document's own windows each goes to its automaton once
                        places = np.flatnonzero(mine)
                        again = np.ones(len(places), dtype=bool)
                        again[np.unique(whole[a:b][places], return_index=True)[1]] = False
                        hit[places[again]] = False
                    split = (W.mix(least[a:b].view(np.uint64)) % splits[at].astype(np.uint64)).astype(np.int64)
                    same = (shards[at[1:]] == shards[at[:-1]]) & (split[1:] == split[:-1])
                    new = np.flatnonzero(np.r_[True, (hit[1:] != hit[:-1]) | ~same & hit[1:]])
                    for s, e in zip(new, [*new[1:], b - a], strict=True):
                        if not hit[s]:
                            continue
                        shard = int(shards[at[s]])
                        text = words.data[words.starts[a + s] : words.ends[a + e + window - 2]].tobytes()
                        rows += [(shard, k, shard != doc, doc, int(s), text) for k in _parts_of(shard, int(split[s]), int(parts[at[s]]), doc)]
                if rows:
                    yield _batch(rows, PASSAGE, _PASSAGE_TYPES)

    return docs.mapInArrow(run, PASSAGE)


def _leftover_passages(rest: DataFrame, window: int) -> DataFrame:
    """Rows of PASSAGE for leftover passages (id, start, text, own): ``own`` has the windows (k, shard, parts) that repeat."""

    def run(batches):
        for piece in (batch.slice(k, 500) for batch in batches for k in range(0, len(batch), 500)):
            rows = []
            for doc, start, text, own in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                words = text.split()
                own = sorted((x["k"], x["shard"], x["parts"]) for x in own)
                first = 0
                for i in range(1, len(own) + 1):
                    if i == len(own) or own[i][0] != own[i - 1][0] + 1 or own[i][1] != own[first][1]:
                        k, shard, parts = own[first]
                        passage = b" ".join(words[k : own[i - 1][0] + window])
                        rows += [(shard, part, shard != doc, doc, start + k, passage) for part in _parts_of(shard, 0, parts, doc)]
                        first = i
            if rows:
                yield _batch(rows, PASSAGE, _PASSAGE_TYPES)

    return rest.select("id", "start", "text", "own").mapInArrow(run, PASSAGE)


MATCH = "id long, start int, end int, windows array<long>, text binary"
_MATCH_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()]


class _Shard:
    """Passages of one reference, and what is found of others in them.

    The automaton is built when the first passage comes that is not, as a whole, one of the reference's; of passages that are equal, as in
    groups of copies, one is looked up (the last ``_REMEMBERED`` bytes of passages are remembered).
    """

    _REMEMBERED = 1 << 20

    def __init__(self, window: int):
        self.window, self.passages, self.whole, self.automaton = window, [], set(), None
        self.known: dict[bytes, list[tuple]] = {}
        self.size = 0

    def add(self, text: bytes) -> None:
        self.passages.append(text)
        self.whole.add(text)

    def _found(self, text: bytes) -> list[tuple]:
        """(first word, end, None, None) of spans that the reference holds, and (first word, None, window hashes, text) of the rest."""
        words, w = text.split(), self.window
        if self.automaton is None:
            if text in self.whole:
                return [(0, len(words), None, None)]
            self.automaton = SuffixAutomaton()
            for passage in self.passages:
                self.automaton.add(passage.split())
        inside = np.array(self.automaton.matching_statistics(words))[w - 1 :] >= w  # for each window
        edges = np.flatnonzero(np.r_[True, inside[1:] != inside[:-1]]).tolist()
        out = []
        for a, b in zip(edges, [*edges[1:], len(inside)], strict=True):
            if inside[a]:
                out.append((a, b + w - 1, None, None))
            else:
                left = b" ".join(words[a : b + w - 1])
                out.append((a, None, W.windows(W.split(pa.array([left], pa.large_binary())).hashes, w).view(np.int64), left))
        return out

    def compared(self, doc: int, start: int, text: bytes, with_rest: bool) -> Iterator[tuple]:
        """Rows of MATCH for a passage of another document."""
        found = self.known.get(text)
        if found is None:
            found = self._found(text)
            if self.size + len(text) > self._REMEMBERED:
                self.known, self.size = {}, 0
            self.known[text] = found
            self.size += len(text)
        for a, end, hashes, left in found:
            if end is not None:
                yield doc, start + a, start + end, None, None
            elif with_rest:
                yield doc, start + a, None, hashes, left


def _matches(passages: DataFrame, window: int, with_rest: bool) -> DataFrame:
    """Rows of MATCH: spans of words to remove and, ``with_rest``, those (end null) that are not in their shard's document."""

    def run(batches):
        key, reference, rows = None, _Shard(window), []
        # some hundred passages at a time become Python objects
        for piece in (batch.slice(k, 500) for batch in batches for k in range(0, len(batch), 500)):
            for shard, part, is_other, doc, start, text in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                if key != (shard, part):
                    key, reference = (shard, part), _Shard(window)
                if is_other:
                    rows += reference.compared(doc, start, text, with_rest)
                else:
                    reference.add(text)
                if len(rows) >= 500:
                    yield _batch(rows, MATCH, _MATCH_TYPES)
                    rows = []
        if rows:
            yield _batch(rows, MATCH, _MATCH_TYPES)

    parts = int(passages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = passages.repartition(parts, "shard", "part").sortWithinPartitions("shard", "part", "is_other", "id", "start")
    return dealt.mapInArrow(run, MATCH)


def repeated_spans(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR, most_anchors: int = MOST_ANCHORS, part_anchors: int = PART_ANCHORS) -> DataFrame:
    """(id, spans): for each document with words to remove, their spans (start, end), which may overlap.

    ``docs`` has ``id`` (long, not null) and ``text``; rows with the same id must have the same text.
    """
    rows = _anchors(docs, window, anchor)
    shared = staged(
        rows.alias("l")
        .join(rows.alias("r"), (F.col("l.anchor") == F.col("r.anchor")) & (F.col("l.id") != F.col("r.id")), "left_semi")
        .select("anchor", "id"),
        "anchors",
    )
    first = shared.groupBy("anchor").agg(F.min("id").alias("shard"))
    owned = staged(shared.join(first, "anchor"), "owned-anchors")
    # shards of very many anchors, or that very many documents need; a table of few rows, whose size decides how it is joined
    mine = F.col("id") == F.col("shard")
    sizes = owned.groupBy("shard").agg(F.count(F.when(mine, 1)).alias("mine"), F.count(F.when(~mine, 1)).alias("others"))
    sizes = sizes.withColumn("splits", F.ceil(F.col("mine") / most_anchors).cast("int"))
    sizes = sizes.withColumn("parts", F.ceil(F.col("others") / F.greatest(PER_OWN * F.col("mine"), F.col("splits") * part_anchors)).cast("int"))
    hot = staged(sizes.where("parts > 1 or splits > 1").select("shard", "parts", "splits"), "hot-shards")
    one = lambda c: F.coalesce(c, F.lit(1)).alias(c)
    own = owned.join(hot, "shard", "left").groupBy("id").agg(F.collect_set(F.struct("anchor", "shard", one("parts"), one("splits"))).alias("own"))
    passages = _passages(packed(docs).join(own, "id").select("id", "text", "own"), window, anchor)
    matches = staged(_matches(passages, window, True), "matches")

    rest = matches.where("end is null").select("id", "start", "windows", "text")
    each = rest.select("id", "start", F.posexplode("windows").alias("k", "hash"))
    least = each.groupBy("hash").agg(F.min("id").alias("shard"), F.max("id").alias("most")).where("shard < most").select("hash", "shard")
    again = staged(each.join(least, "hash").select("id", "start", "k", "shard").distinct(), "leftover-windows")
    sizes = again.groupBy("shard").agg(F.count(F.when(mine, 1)).alias("mine"), F.count(F.when(~mine, 1)).alias("others"))
    sizes = sizes.withColumn("parts", F.ceil(F.col("others") / F.greatest(PER_OWN * F.col("mine"), F.lit(5 * part_anchors))).cast("int"))
    hot = staged(sizes.where("parts > 1").select("shard", "parts"), "hot-leftovers")
    own = again.join(hot, "shard", "left").groupBy("id", "start").agg(F.collect_list(F.struct("k", "shard", one("parts"))).alias("own"))
    left = _leftover_passages(rest.join(own, ["id", "start"]), window)
    second = _matches(left, window, False)

    spans = matches.where("end is not null").select("id", "start", "end").union(second.select("id", "start", "end"))
    return spans.groupBy("id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def _removed(n: int, spans) -> np.ndarray:
    """Mask of the words inside any span."""
    edges = np.zeros(n + 1, dtype=np.int64)
    if spans is not None:
        np.add.at(edges, spans.field("start").to_numpy(), 1)
        np.add.at(edges, spans.field("end").to_numpy(), -1)
    return np.cumsum(edges)[:n] > 0


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = WINDOW, most_anchors: int = MOST_ANCHORS, part_anchors: int = PART_ANCHORS,
    with_text: bool = True, carried: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 and, unless ``with_text`` is False, ``kept_text``; then the ``carried`` columns.

    Words are ``[^\\x20\\x09-\\x0D]+``.  A word goes if a run of ``window`` words around it also starts in a document
    with a smaller id; runs are judged on the input.  ``kept_sha256`` is of the kept words joined by one space;
    ``kept_text`` keeps the white space between kept words as it was (null where the text is null).  A null text has
    no words.  Rows with a null id are dropped; rows that share an id must share the text and each give a row.
    An empty table gives an empty one; columns that are not carried are ignored, whatever their names.
    """
    rest = [f"carried_{k}" for k in range(len(carried))]
    docs = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(r) for c, r in zip(carried, rest, strict=True))
    ).where("id is not null")
    spans = repeated_spans(docs.select("id", "text"), window=window, most_anchors=most_anchors, part_anchors=part_anchors)
    kinds = ["id long", "n_words long", "n_removed long", "kept_sha256 string", *["kept_text string"] * with_text, *(f"{r} {docs.schema[r].dataType.simpleString()}" for r in rest)]
    names = [k.split()[0] for k in kinds]

    def run(batches):
        for batch in batches:
            for chunk in W.unpacked(batch, "text"):
                words = W.split(chunk.column(1))
                texts = chunk.column(1)
                rows = []
                for d, (doc, own) in enumerate(zip(chunk.column(0).to_pylist(), chunk.column(2), strict=True)):
                    a, b = int(words.first[d]), int(words.first[d + 1])
                    gone = _removed(b - a, own.values)
                    starts, ends = words.starts[a:b][~gone].tolist(), words.ends[a:b][~gone].tolist()
                    kept = b" ".join([words.data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]) if gone.any() else b" ".join((texts[d].as_py() or b"").split())
                    row = (doc, b - a, int(gone.sum()), hashlib.sha256(kept).hexdigest())
                    if with_text:
                        row += (_cut(words, a, gone) if gone.any() else texts[d].as_py(),)
                    rows.append(row)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 4 + with_text]
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                if with_text:
                    arrays[4] = arrays[4].cast(pa.string())
                yield pa.RecordBatch.from_arrays([*arrays, *chunk.columns[3:]], names=names)

    joined = packed(docs).join(spans, "id", "left").select("id", "text", "spans", *rest)
    return joined.mapInArrow(run, ", ".join(kinds)).withColumnsRenamed({"id": id_col, **dict(zip(rest, carried, strict=True))})


def _cut(words: W.Words, a: int, gone: np.ndarray) -> bytes:
    """The text of a document without the marked words and the white space after them."""
    edges = np.flatnonzero(np.r_[True, gone[1:] != gone[:-1]]).tolist()
    out = []
    for s, e in zip(edges, [*edges[1:], len(gone)], strict=True):
        if not gone[s]:
            stop = words.starts[a + e] if e < len(gone) else words.ends[a + e - 1]
            out.append(words.data[words.starts[a + s] : stop].tobytes())
    return b"".join(out)

