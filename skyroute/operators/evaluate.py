"""Scores of predictions and of training runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def argmax_class(scores: str) -> Column:
    """Index of the first largest score."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def confusion(pixels: DataFrame, truth: str, predicted: str, weight: Column | None = None) -> DataFrame:
    """(truth, predicted, weight): summed weights, counted where no weight is given."""
    w = weight if weight is not None else F.lit(1.0)
    return pixels.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.sum(w).alias("weight"))


def _ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0.0)))


def precision_recall_f1(pixels: DataFrame, scores: str, truth: str, weight: Column, threshold: float = 0.5) -> DataFrame:
    """One row, over the cells of all classes: a cell is predicted where its score exceeds the threshold."""
    cells = pixels.select(weight.alias("w"), F.col(truth).alias("t"), F.posexplode(scores).alias("c", "s"))
    hit, real = F.col("s") > threshold, F.col("c") == F.col("t")
    total = lambda on: F.coalesce(F.sum(F.when(on, F.col("w"))), F.lit(0.0))
    sums = cells.agg(total(hit & real).alias("tp"), total(hit & ~real).alias("fp"), total(~hit & real).alias("fn"))
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = _ratio(F.lit(2.0), _ratio(F.lit(1.0), F.col("recall")) + _ratio(F.lit(1.0), F.col("precision")))
    return sums.select(p.alias("precision"), r.alias("recall")).withColumn("f1", f1)


def class_iou(matrix: DataFrame) -> DataFrame:
    """(class, iou) of a confusion table: diagonal over union, for classes that occur."""
    sides = matrix.select(
        F.explode(F.array(F.struct(F.col("truth").alias("class"), F.lit(1).alias("side")), F.struct(F.col("predicted").alias("class"), F.lit(2).alias("side")))).alias("s"),
        (F.col("truth") == F.col("predicted")).alias("on"), "weight",
    )
    sums = sides.groupBy("s.class").agg(F.sum("weight").alias("both"), F.sum(F.when(F.col("on") & (F.col("s.side") == 1), F.col("weight")).otherwise(0.0)).alias("tp"))
    return sums.select("class", _ratio(F.col("tp"), F.col("both") - F.col("tp")).alias("iou"))


def accuracy_iou(matrix: DataFrame) -> DataFrame:
    """One row: share of weight on the diagonal, and the mean of the classes' IoU."""
    on = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("weight")).otherwise(0.0))
    accuracy = matrix.agg(_ratio(on, F.sum("weight")).alias("accuracy"))
    return accuracy.withColumn("mean_iou", class_iou(matrix).agg(F.avg("iou")).scalar())


def best_epoch(history: DataFrame) -> DataFrame:
    """(run, best_epoch, best): of runs (run, epoch, value) the first epoch with the least value."""
    return history.groupBy("run").agg(F.min_by("epoch", F.struct("value", "epoch")).alias("best_epoch"), F.min("value").alias("best"))


def early_stop(values: str, min_delta: float = 0.001, patience: int = 5) -> Column:
    """Epoch (from 1) after which training stops for want of an improvement by ``min_delta`` in ``patience`` epochs; null if it doesn't."""
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("wait"), F.lit(0).alias("epoch"), F.lit(None).cast("int").alias("stop"))

    def step(state, value):
        better = value < state["best"] - min_delta
        wait = F.when(better, 0).otherwise(state["wait"] + 1)
        epoch = state["epoch"] + 1
        return F.struct(
            F.when(better, value).otherwise(state["best"]).alias("best"), wait.alias("wait"), epoch.alias("epoch"),
            F.coalesce(state["stop"], F.when(wait >= patience, epoch)).alias("stop"),
        )

    return F.aggregate(values, start, step, lambda s: s["stop"])


#: Milliseconds that each way of building a graph of n vertices is predicted to take.
GROWTH = {"naive": lambda n: F.pow(n / 41, F.lit(3)), "sweep": lambda n: F.pow(n / 24, F.lit(2)) * F.log(n / 24), "optimized": lambda n: F.pow(n / 30, F.lit(2)) * F.log(n / 30)}


def timing_summary(runs: DataFrame) -> DataFrame:
    """(mode, vertices, runs, mean_s, std_s, predicted_s, residual_s) of runs (mode, vertices, ms); std is of the population."""
    sums = runs.groupBy("mode", "vertices").agg(F.count("*").alias("runs"), (F.avg("ms") / 1000).alias("mean_s"), (F.stddev_pop("ms") / 1000).alias("std_s"))
    n = F.col("vertices").cast("double")
    predicted = F.coalesce(*(F.when(F.col("mode") == k, f(n) / 1000) for k, f in GROWTH.items()))
    return sums.withColumn("predicted_s", predicted).withColumn("residual_s", F.col("mean_s") - F.col("predicted_s"))
