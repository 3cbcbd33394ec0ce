"""N-gram Jaccard join with token-combination prefixes.

Documents are sets of word shingles; two link when their Jaccard similarity reaches a threshold.
Each step drops only documents or pairs that cannot reach the threshold.  Shingles are compared by
64-bit hashes, so two different shingles may count as one with a chance of about 2**-62; a set of a single
shingle is compared by a 128-bit digest of its words.

1. *Sets.*  Each text becomes a set of 64-bit shingle hashes.  Texts with the same set are merged
   into one representative before anything is compared, so exact copies never meet each other.
2. *Extended prefixes.*  A document of n shingles keeps the first ``tau + ell`` of them in hash
   order, where ``tau`` is the most that a partner may lack.  A linked pair then shares at least
   ``ell`` of these, so a document of whose prefix fewer than ``ell`` shingles occur anywhere else has no partner.
3. *Effective sizes.*  The full sets of what is left are counted.  Shingles that occur in one
   document only can't be shared, so a document with more than ``tau`` of them is dropped.
4. *Signatures.*  Shingles are ordered from rare to frequent.  Rare ones are indexed singly.
   Shingles of the frequent class are dealt to small groups by their hash, and pairs within
   a group are indexed.  Since the loss of one shingle breaks at most all pairs of a group that
   hold it, a group of g shingles needs g - 1 losses; prefixes are extended until
   more than ``tau`` losses would be needed.  The number of groups follows the size band
   of the documents, so that two documents that may link deal alike.
5. *Stars, then the rest.*  Each signature's members are compared with one of them; the links give
   first components.  Then the members of one signature and size band whose components still differ are
   paired, if position, size and sketch leave them a chance; each pair is verified once.  In a group only the members outside its
   largest component look for partners, so groups of copies make no squares of rows.  A sketch is ``SKETCH`` bits: the parity of the
   number of shingles of each bucket.  Bits in which two sketches differ are at most the shingles that only one of the sets has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyroute.llm import words as W
from skyroute.llm.components import connected_components
from skyroute.llm.tables import packed, staged

SHINGLE = 5
#: Similarity from which two sets link, in hundredths.
PERCENT = 80
#: Document frequency from which a shingle belongs to the frequent class.
FREQUENT = 32
#: Expected shingles of a whole document in one group of the frequent class.
GROUP = 8
#: Bits of a sketch, in longs.
SKETCH = 256
_SKETCH_COLS = [f"k{i}" for i in range(SKETCH // 64)]


def shingle_sets(words: W.Words, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes (int64) of each document of a chunk."""
    runs = W.windows(words.hashes, k)
    for start, end in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        n = end - start
        if n >= k:
            found = np.unique(runs[start : end - k + 1].view(np.int64))
        elif n:
            found = W.windows(words.hashes[start:end], n).view(np.int64)
        else:
            found = np.zeros(0, dtype=np.int64)
        yield found


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _need(n: np.ndarray | int, percent: int):
    """Least overlap of a set of n with any partner: at least percent of n."""
    return -(-n * percent // 100)


def _sets(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, whole: bool, is_packed: bool = False) -> DataFrame:
    """(id, n, d1, d2, tokens): set size, a 128-bit digest of the set, and its tokens or the extended prefix."""
    import hashlib

    def run(batches):
        for batch in batches:
            for chunk in W.unpacked(batch, "text") if is_packed else W.chunks(batch, "text"):
                words = W.split(chunk.column(1), lower=True)
                sizes, digests, kept = [], [], []
                for d, found in enumerate(shingle_sets(words, k)):
                    n = len(found)
                    sizes.append(n)
                    same = found.tobytes()
                    if n == 1:
                        own = slice(words.first[d], min(words.first[d] + k, words.first[d + 1]))
                        same = b" ".join(words.data[x:y].tobytes() for x, y in zip(words.starts[own], words.ends[own], strict=True))
                    digests.append(hashlib.blake2b(same, digest_size=16).digest())
                    kept.append(found if whole else found[: n - _need(n, percent) + max(1, n // 20)])
                pair = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [chunk.column(0), pa.array(sizes, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), _lists(kept)],
                    names=["id", "n", "d1", "d2", "tokens"],
                )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, n long, d1 long, d2 long, tokens array<long>"
    )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of which the sets reach the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("s_a"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("s_b"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .withColumn("both", both)
        .where(F.col("both") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("both")) * percent)
        .select("a", "b")
    )


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether sizes and effective sizes allow a link: |A & B| <= min(e), and (100 + p) |A & B| >= p (|A| + |B|)."""
    return (F.least(f"{a}.e", f"{b}.e") * (100 + percent) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * percent) & (
        F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * percent
    )


def _sketches_may_link(a: str, b: str, percent: int) -> Column:
    """Whether the sketches allow a link: |A & B| <= (e + e - differing bits) / 2."""
    differing = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in _SKETCH_COLS), F.lit(0))
    return (F.col(f"{a}.e") + F.col(f"{b}.e") - differing) * (100 + percent) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (2 * percent)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity of the number of tokens (uint64) in each of ``SKETCH`` buckets, packed in int64."""
    odd = np.bincount((W.mix(tokens) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signature_arrays(percent: int, frequent: int, group: int):
    """For batches of (id, n, tokens in order, frequencies): the ordered signatures and what may follow each."""

    def run(batches):
        ratio = 100 / percent
        for batch in batches:
            names = batch.schema.names
            ids, ns = batch.column(names.index("id")).to_numpy(), batch.column(names.index("n")).to_numpy()
            at = batch.column(names.index("ordered"))
            offsets, flat = at.offsets.to_numpy(), at.values
            # flat also holds what lies before a slice's first offset
            dfs, toks = flat.field("df").to_numpy(), flat.field("token").to_numpy()
            sigs, rems, sketches = [], [], []
            for i, n in enumerate(ns.tolist()):
                df, tok = dfs[offsets[i] : offsets[i + 1]], toks[offsets[i] : offsets[i + 1]]
                lost = n - len(tok)  # tokens of this document only; they come first in the order
                tau = n - _need(n, percent)
                rare = int(np.searchsorted(df, frequent))
                singles = min(rare, tau + 1 - lost)
                own = [tok[:singles].view(np.uint64)]
                rem = [np.arange(n - lost, n - lost - singles, -1)]
                short = tau + 1 - lost - singles
                if short > 0:
                    hot = tok[rare:].view(np.uint64)
                    band = int(np.log(n) / np.log(ratio) + 1e-9)
                    combos = []
                    for key in (band, band + 1):  # a partner's band is this one or next to it
                        groups = max(1, int(ratio ** key / group))
                        cell = (hot % np.uint64(groups)).astype(np.int64)
                        # a token costs its losing one pair-breaking removal, unless it is the first of its group
                        _, firsts = np.unique(cell, return_index=True)
                        costs = np.ones(len(hot), dtype=np.int64)
                        costs[firsts] = 0
                        reach = int(np.searchsorted(np.cumsum(costs), short)) + 1
                        cell, head = cell[:reach], hot[:reach]
                        order = np.argsort(cell, kind="stable")
                        cell, head = cell[order], head[order]
                        bounds = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
                        for s, t in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                            if t - s > 1:
                                x, y = np.triu_indices(t - s, 1)
                                p, q = head[s:t][x], head[s:t][y]
                                combos.append(W.mix(W.mix(np.minimum(p, q) + np.uint64(key)) + np.maximum(p, q)))
                    if combos:
                        combos = np.unique(np.concatenate(combos))
                        own.append(combos)
                        rem.append(np.full(len(combos), len(hot)))
                sketches.append(sketch(tok.view(np.uint64)))
                sigs.append(np.concatenate(own).view(np.int64))
                rems.append(np.concatenate(rem).astype(np.int64))
            bits = np.array(sketches, dtype=np.int64).reshape(-1, len(_SKETCH_COLS))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(ns), batch.column(names.index("e")), _lists(sigs), _lists(rems), *map(pa.array, bits.T.copy())],
                names=["id", "n", "e", "sigs", "rems", *_SKETCH_COLS],
            )

    return run


def jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    k: int = SHINGLE,
    percent: int = PERCENT,
    frequent: int = FREQUENT,
    group: int = GROUP,
) -> DataFrame:
    """One row per document: its id, ``n_shingles`` and ``component_id``.

    ``component_id`` is the smallest id that links reach, the document included.  Words are
    ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document of fewer than ``k`` words has
    one shingle, its whole sequence.  A null or blank text has no shingle and links with nothing.
    Ids must be distinct and not null; rows with a null id are dropped.  Other columns are ignored,
    whatever their names.  An empty table gives an empty one.  ``percent`` must be over 50.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    prefixes = staged(_sets(docs, "id", "text", k, percent, whole=False), "prefixes")
    key = ["d1", "d2", "n"]
    merged = prefixes.where("n > 0").groupBy(*key).agg(F.min("id").alias("id"))

    # 2. documents with enough shingles that occur elsewhere; both sides of the join read one shuffle
    rows = (
        prefixes.where("n > 1")  # sets of one shingle only link with equal ones
        .groupBy(*key)
        .agg(F.min(F.struct("id", "tokens")).alias("r"))
        .select("r.id", F.explode("r.tokens").alias("token"))
    )
    need = (
        rows.alias("l")
        .join(rows.alias("r"), (F.col("l.token") == F.col("r.token")) & (F.col("l.id") != F.col("r.id")), "left_semi")
        .groupBy("id")
        .count()
        .join(prefixes.select("id", "n"), "id")
        .where(F.col("count") >= F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / 20)))  # ell of the smallest partner
        .select("id")
    )
    kept = packed(docs).join(need, "id", "left_semi")
    full = staged(_sets(kept, "id", "text", k, percent, whole=True, is_packed=True).select("id", "n", "tokens"), "sets")

    # 3. frequencies and effective sizes
    rows = full.select("id", "n", F.explode("tokens").alias("token"))
    df = rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ordered = (
        rows.join(df, "token")
        .groupBy("id", "n")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("df"), F.col("token")))).alias("ordered"))
        .withColumn("e", F.size("ordered").cast("long"))
        .where(F.col("e") * 100 >= F.col("n") * percent)
    )
    sets = staged(ordered, "ordered")

    # 4. signatures
    signed = staged(
        sets.select("id", "n", "e", "ordered").mapInArrow(
            _signature_arrays(percent, frequent, group), "id long, n long, e long, sigs array<long>, rems array<long>, " + ", ".join(f"{c} long" for c in _SKETCH_COLS)
        ),
        "signatures",
    )
    sets = sets.select("id", "n", F.col("ordered.token").alias("shared"))
    member = signed.select("id", "n", "e", F.posexplode(F.arrays_zip("sigs", "rems")).alias("pos", "s")).select(
        F.col("s.sigs").alias("sig"), "id", "n", "e", F.col("s.rems").alias("rem"), "pos"
    )

    # 5. stars
    hub = F.min(F.struct("id", "n", "e"))
    hubs = member.groupBy("sig").agg(hub.alias("h"), F.count("*").alias("c")).where("c > 1").select("sig", "h")
    stars = (
        member.alias("m")
        .join(hubs.alias("g"), "sig")
        .select(F.col("m.id").alias("b"), F.col("h.id").alias("a"), F.struct("m.n", "m.e").alias("x"), F.struct("h.n", "h.e").alias("y"))
        .where("a < b")
        .where(_may_link("x", "y", percent))
        .select("a", "b")
        .distinct()
    )
    links = staged(_verified(stars, sets, percent), "star-links")
    first = connected_components(links)

    # the rest: pairs of one signature in different components; the smaller set of a pair is in the band of the larger or the one before
    band = F.floor(F.log("n") / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    member = (
        member.where(F.col("rem") * 100 >= F.col("n") * percent)
        .join(first.select(F.col("node").alias("id"), "component"), "id", "left")
        .select("sig", "id", "n", "e", "rem", F.coalesce("component", "id").alias("component"), band.alias("band"))
    )
    apart = (F.min("component").alias("lo"), F.max("component").alias("hi"))
    open_sigs = member.groupBy("sig").agg(*apart).where("lo < hi").select("sig")
    dealt = member.join(open_sigs, "sig", "left_semi").withColumn("key", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    dealt = staged(dealt, "open")
    sizes = dealt.groupBy("sig", "key", "component").agg(F.count("*").alias("c"))
    open_keys = sizes.groupBy("sig", "key").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("c")).where("c > 1")
    left = dealt.join(open_keys.select("sig", "key", "main"), ["sig", "key"]).join(signed.select("id", *_SKETCH_COLS), "id")
    left = staged(left.withColumn("apart", F.col("component") != F.col("main")).drop("main"), "open-keys")

    def pairs(small: DataFrame, large: DataFrame) -> DataFrame:
        a, b = small.alias("a"), large.where("key = band").alias("b")
        return (
            a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.key") == F.col("b.key")))
            .where(F.struct("a.n", "a.id") < F.struct("b.n", "b.id"))
            .where(F.col("a.component") != F.col("b.component"))
            .where(_may_link("a", "b", percent))
            .where(F.least("a.rem", "b.rem") * (100 + percent) >= (F.col("a.n") + F.col("b.n")) * percent)
            .where(_sketches_may_link("a", "b", percent))
            .select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
        )

    rest = pairs(left.where("apart"), left).union(pairs(left.where("not apart"), left.where("apart"))).distinct()
    links = links.union(_verified(rest, sets, percent))
    components = connected_components(links)

    found = (
        merged.select("id", *key)
        .join(components, F.col("id") == F.col("node"), "left")
        .select(*key, F.coalesce("component", "id").alias("component"))
    )
    return (
        prefixes.select("id", *key)
        .join(found, key, "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
