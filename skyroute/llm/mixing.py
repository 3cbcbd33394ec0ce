"""Mixing sources to target weights by temperature.

A source with share s of the tokens gets the weight s^a / sum(s^a).  The exponent a is found by bisection: the
largest one whose weights reach the target entropy, raised as far as needed so that no source is repeated more
often than the limit.  Each round tries a grid of exponents at once in one grouped sum over the sources, so
the table of sources stays distributed.

The weights are realised as budgeted block permutations.  A source is cut into blocks by a hash of the ids;
a block gives as many whole permutations of its documents as its budget holds, and then a part of one more: documents in a
new random order until the rest of the budget is used up.  Blocks are of bounded expected size, so a hot source is many small windows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyroute.llm import words as W
from skyroute.llm.tables import staged

#: Entropy of the weights as a share of that of equal weights.
TARGET_ENTROPY = 0.97
#: Most passes over a source.
MAX_REPEATS = 4.0
#: Expected documents of one block.
BLOCK_DOCS = 500
SEED = 7
_GRID, _ROUNDS = 17, 6


def token_counts(docs: DataFrame) -> DataFrame:
    """(id, hash, source, tokens) of documents (id, text, source): white-space separated words, 0 for a null text."""

    def run(batches):
        for batch in batches:
            for chunk in W.chunks(batch, "text"):
                tokens = pa.array(W.split(chunk.column(1)).counts.astype("int64"))
                yield pa.RecordBatch.from_arrays([chunk.column(0), chunk.column(2), chunk.column(3), tokens], names=["id", "hash", "source", "tokens"])

    rows = docs.select("id", "text", F.xxhash64("text").alias("hash"), "source")
    return rows.mapInArrow(run, "id long, hash long, source string, tokens long")


def _tried(sources: DataFrame, low: float, high: float, total: float, budget: float) -> list:
    """(a, entropy share, most repeats) for a grid of exponents."""
    step = (high - low) / (_GRID - 1)
    rows = sources.select("share", "tokens", F.explode(F.array(*(F.lit(low + k * step) for k in range(_GRID)))).alias("a")).withColumn("x", F.pow("share", "a"))
    sums = rows.groupBy("a").agg(
        F.sum("x").alias("z"), F.sum(F.col("x") * F.log("x")).alias("xl"), F.max(F.col("x") / F.col("tokens")).alias("most"), F.count("*").alias("n")
    )
    entropy = F.log("z") - F.col("xl") / F.col("z")
    return (
        sums.select("a", F.when(F.col("n") > 1, entropy / F.log("n")).otherwise(1.0).alias("entropy"), (F.col("most") / F.col("z") * budget).alias("repeats"))
        .orderBy("a")
        .collect()
    )


def temperature(sources: DataFrame, total: float, budget: float, target_entropy: float, max_repeats: float) -> float:
    """The exponent: entropy falls and repeats fall as it grows from 0 (equal weights) to 1 (natural shares)."""

    def bisect(good) -> float:
        """The end of the good part: least exponent with few enough repeats, or largest with entropy enough."""
        low, high = 0.0, 1.0
        for _ in range(_ROUNDS):
            tried = _tried(sources, low, high, total, budget)
            at = next((k for k, r in enumerate(tried) if good(r)), None)
            if at is None:
                return high
            if at == 0:
                return low
            low, high = tried[at - 1].a, tried[at].a
        return high

    flat = bisect(lambda r: r.entropy < target_entropy)  # beyond it the entropy is too small
    return max(flat, bisect(lambda r: r.repeats <= max_repeats))


def source_weights(
    docs: DataFrame, source: str, tokens: str, *, budget: float | None = None, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS
) -> tuple[DataFrame, float]:
    """(table of source, documents, tokens, weight and repeats; the exponent).  Sources without tokens have no weight.

    Raises ValueError if there are tokens and the budget is more than ``max_repeats`` passes over all sources give.
    """
    sums = staged(docs.where(F.col(tokens) > 0).groupBy(F.col(source).alias("source")).agg(F.count("*").alias("docs"), F.sum(tokens).alias("tokens")), "sources")
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    budget = float(budget if budget is not None else total)
    if total and budget > max_repeats * total:
        raise ValueError("the budget exceeds max_repeats times the tokens, so no weights meet both")
    sums = sums.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    a = temperature(sums, total, budget, target_entropy, max_repeats) if total else 1.0
    z = sums.agg(F.sum(F.pow("share", F.lit(a)))).first()[0] or 1.0
    weight = F.pow("share", F.lit(a)) / z
    return sums.select("source", "docs", "tokens", weight.alias("weight"), (weight * budget / F.col("tokens")).alias("repeats")), a


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    budget: float | None = None,
    target_entropy: float = TARGET_ENTROPY,
    max_repeats: float = MAX_REPEATS,
    block_docs: int = BLOCK_DOCS,
    seed: int = SEED,
) -> DataFrame:
    """(id, text hash, pass, block, order, source weight) of each document in the mixture, one row for each time it occurs.

    ``budget`` is the tokens of the mixture, those of the table unless given.  A null source is a source.  Documents without
    words are in no mixture.  In the last, partial pass a document is taken if the middle of its tokens lies within the rest of
    the block's budget.  ``pass`` counts from 0 and ``order`` is a random number by which a pass is shuffled.
    Repeated rows take part each.  An empty table gives an empty one; a ``budget`` above ``max_repeats`` times the tokens raises ValueError.
    Same input and seed, same result.  Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"))
    rows = staged(token_counts(rows).where("tokens > 0"), "token-counts")
    weights, _ = source_weights(rows, "source", "tokens", budget=budget, target_entropy=target_entropy, max_repeats=max_repeats)
    weights = weights.select(F.col("source").alias("s2"), "weight", "repeats", F.ceil(F.col("docs") / block_docs).alias("blocks"))
    joined = rows.join(weights, F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    joined = joined.withColumn("block", F.pmod(F.xxhash64("id", "hash", F.lit(seed)), F.col("blocks")).cast("int"))
    whole = F.floor("repeats").cast("int")
    shuffled = F.xxhash64("id", "hash", F.lit(seed + 1), whole)
    block = Window.partitionBy("source", "block")
    before = F.sum("tokens").over(block.orderBy(shuffled, "id", "hash").rowsBetween(Window.unboundedPreceding, -1))
    rest = (F.col("repeats") - F.floor("repeats")) * F.sum("tokens").over(block)
    partly = F.coalesce(before, F.lit(0)) + F.col("tokens") / 2 <= rest
    times = whole + F.when(partly, 1).otherwise(0)
    return (
        joined.withColumn("times", times)
        .where("times > 0")
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
        .select("id", "hash", "source", "tokens", "weight", "block", "pass", F.xxhash64("id", "hash", F.lit(seed + 1), F.col("pass")).alias("order"))
    )
