"""Approximate nearest neighbours by a hash-prefix forest.

A tree is a sorted array of long hash strings, one for each vector: bit k tells the side of the k-th random
hyperplane.  A query descends each tree by binary search to the entries with which it shares the longest
prefix, and then ascends all trees at the same time, one bit of prefix less each step, until the entries reached
suffice; they are scored exactly.  The prefix length so follows the density around the query.

The index is cut into blocks of about ``BLOCK_ROWS`` vectors, each with a forest of its own, and the stated
query set visits every block in groups of about ``QUERY_ROWS``; a task holds one block and one group.
Of each block's candidates the best are kept, and then the best of all blocks.  Equal vectors are one
entry that carries its smallest ids, as many as a result can hold, so a vector that very
many rows share costs no more than any other.

Largest inner products of vectors of any length become nearest directions by one more coordinate:
x -> (x / M, sqrt(1 - |x / M|^2)) with M the largest length, and q -> (q / |q|, 0).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyroute.llm.tables import staged

TREES = 24
#: Bits of a hash string.
BITS = 24
#: Entries reached over all trees, as a multiple of the block's rows, at which the ascent ends.
REACH = 1.2
#: Distinct entries scored in each block, as a multiple of those kept; where the ascent reaches fewer, the whole block is scored.
DISTINCT = 4
BLOCK_ROWS, QUERY_ROWS = 8192, 4096
NEIGHBOURS = 20
SEED = 20240229


def planes(dimension: int, trees: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((trees, dimension + 1, bits))


def hash_strings(x: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """Hash string of each row in each tree, the first hyperplane in the highest bit."""
    bits = normals.shape[2]
    weights = (1 << np.arange(bits - 1, -1, -1, dtype=np.int64)).astype(np.int64)
    return np.stack([((x @ h) > 0).astype(np.int64) @ weights for h in normals])


def candidates(index: np.ndarray, queries: np.ndarray, bits: int, wanted: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, low, high): entries order[t, low[t, q]:high[t, q]] are what query q reaches in tree t.

    ``index`` and ``queries`` are hash strings by tree.  Every query ascends all trees together.
    """
    order = np.argsort(index, axis=1, kind="stable")
    arrays = np.take_along_axis(index, order, axis=1)
    low, high = np.zeros(queries.shape, dtype=np.int64), np.zeros(queries.shape, dtype=np.int64)
    climbing = np.arange(queries.shape[1])
    for dropped in range(bits + 1):  # bits of prefix given up
        mask = (1 << dropped) - 1
        for t in range(len(index)):
            own = queries[t, climbing]
            low[t, climbing] = np.searchsorted(arrays[t], own & ~mask, side="left")
            high[t, climbing] = np.searchsorted(arrays[t], own | mask, side="right")
        climbing = climbing[(high[:, climbing] - low[:, climbing]).sum(axis=0) < wanted]
        if not len(climbing):
            break
    return order, low, high


def _search(ids, x, query_ids, q, longest, *, trees, bits, reach, keep, seed):
    """(query, id, score) of the best candidates of one block for each query of a group."""
    normals = planes(x.shape[1], trees, bits, seed)
    scaled = x / longest
    lifted = np.c_[scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1)))]
    asked = np.c_[q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros(len(q))]
    order, low, high = candidates(hash_strings(lifted, normals), hash_strings(asked, normals), bits, max(reach * len(x), 2 * keep))
    out_q, out_i, out_s = [], [], []
    reached = np.zeros(len(x), dtype=bool)
    for k in range(len(q)):
        reached[:] = False
        for t in range(trees):
            reached[order[t, low[t, k] : high[t, k]]] = True
        at = np.flatnonzero(reached)
        if len(at) < min(len(x), DISTINCT * keep):  # trees repeat each other's entries; only a block of few rows can fall short
            at = np.arange(len(x))
        score = x[at] @ q[k]
        if len(at) > keep:
            # all that tie with the last one kept stay for now
            least = np.partition(score, len(at) - keep)[len(at) - keep]
            at, score = at[score >= least], score[score >= least]
        best = np.lexsort((ids[at], -score))[:keep]
        out_q.append(np.full(len(best), query_ids[k]))
        out_i.append(ids[at[best]])
        out_s.append(score[best])
    none = np.zeros(0)
    return np.concatenate(out_q or [none]), np.concatenate(out_i or [none]), np.concatenate(out_s or [none])


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector array<double>, length): rows that take part; the dimension is that of the most rows, the larger if tied."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
        .where("id is not null and vector is not null")
        .where(~F.exists("vector", bad) & F.exists("vector", lambda v: v != 0))
        .dropDuplicates(["id", "vector"])
    )
    sizes = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("vector") == (sizes.d if sizes else 0))


def nearest(
    vectors: DataFrame,
    is_query,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    k: int = NEIGHBOURS,
    trees: int = TREES,
    bits: int = BITS,
    reach: float = REACH,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the ``k`` rows found with the largest inner products.

    ``is_query`` is a condition on ``id``.  Candidates are all rows but the query's own id; ties go to the smaller
    id.  Vectors that are null, zero, of another dimension than most, or hold null, NaN or infinite components take no
    part.  Repeated rows count once.  An empty table, or one row, gives no rows.
    Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    rows = staged(valid_vectors(vectors, id_col, vector_col), "vectors")
    stats = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v)).alias("m")).first()
    longest = float(np.sqrt(stats.m)) * (1 + 1e-12) if stats.n else 1.0

    # equal vectors are one class, named by its smallest id
    same = Window.partitionBy("vector").orderBy("id")
    ranked = rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1)
    classes = staged(ranked.groupBy("vector").agg(F.min("id").alias("class"), F.sort_array(F.collect_list("id")).alias("ids")), "classes")
    asked = staged(
        rows.where(is_query).select("id", "vector").join(classes.select("vector", "class"), "vector").select(F.col("id").alias("query_id"), "class", "vector"), "queries"
    )
    groups = asked.dropDuplicates(["class"]).select("class", "vector")

    blocks = max(1, -(-classes.count() // block_rows))
    parts = max(1, -(-groups.count() // query_rows))
    block = F.pmod(F.xxhash64("class", F.lit(1)), F.lit(blocks)).cast("int")
    part = F.pmod(F.xxhash64("class", F.lit(2)), F.lit(parts)).cast("int")
    index = classes.select("class", "vector", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    query = groups.select("class", "vector", part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        def matrix(t):
            values = t.column("vector").combine_chunks()
            return values.flatten().to_numpy().reshape(len(t), -1)

        if len(left) and len(right):
            q, i, s = _search(
                left.column("class").to_numpy(), matrix(left), right.column("class").to_numpy(), matrix(right), longest,
                trees=trees, bits=bits, reach=reach, keep=k + 1, seed=seed,
            )
        else:
            q = i = s = np.zeros(0)
        return pa.table({"asked": pa.array(q.astype(np.int64)), "class": pa.array(i.astype(np.int64)), "score": pa.array(s.astype(np.float64))})

    found = index.groupBy("block", "part").cogroup(query.groupBy("block", "part")).applyInArrow(search, "asked long, class long, score double")
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "class")
    found = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).select("asked", "class", "score")

    members = classes.select("class", "ids")
    found = found.join(members, "class").select("asked", "score", F.explode("ids").alias("vec_id"))
    first = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asked.select("query_id", F.col("class").alias("asked"))
        .join(found, "asked")
        .where("query_id != vec_id")
        .withColumn("rank", F.row_number().over(last))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def recall(found: pd.DataFrame, ids: np.ndarray, x: np.ndarray, k: int = NEIGHBOURS) -> float:
    """Share of the true k nearest that were found, by brute force over the queries."""
    at = {i: n for n, i in enumerate(ids.tolist())}
    hits = total = 0
    for query, own in found.groupby("query_id"):
        score = x @ x[at[query]]
        score[at[query]] = -np.inf
        true = np.lexsort((ids, -score))[: min(k, len(ids) - 1)]
        hits += len(set(own.vec_id) & set(ids[true].tolist()))
        total += len(true)
    return hits / max(total, 1)
