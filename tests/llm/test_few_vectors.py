"""Tables of few distinct vectors, searched with the production reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyroute.llm import hash_forest


@pytest.mark.parametrize("rows", [15, 25, 40])
def test_all_neighbours_of_small_tables(spark, rows):
    x = np.random.default_rng(rows).standard_normal((rows, 64))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = hash_forest.nearest(df, F.lit(True)).toPandas()
    assert (found.groupby("query_id").size() == min(20, rows - 1)).all() and found.query_id.nunique() == rows
    assert hash_forest.recall(found, np.arange(rows), x) >= 0.9
