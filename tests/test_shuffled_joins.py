"""Joins of rows that explodes make are never broadcast, however small the files are that they come from."""

from pyspark.sql import functions as F

from skyroute.jobs import queries
from skyroute.operators import overlay, spatial
from skyroute.sources import staging, writers

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_same_location_pairs_are_shuffled(spark):
    found = queries.queries()["same_location_pairs"](spark, SF)
    assert "Broadcast" not in plan(found) and "SortMergeJoin" in plan(found)


def test_containment_is_shuffled(spark):
    for name in ("points_in_polygons", "points_in_polygons__anti"):
        found = queries.queries()[name](spark, SF)
        assert "Broadcast" not in plan(found) and "SortMergeJoin" in plan(found)


def test_graph_features_are_shuffled(spark):
    nodes = spark.range(5).selectExpr("id node_id", "double(id) x", "double(id) y")
    edges = spark.range(4).selectExpr("id src", "id + 1 dst", "1D length")
    assert "Broadcast" not in plan(writers.graph_features(nodes, edges))


def test_ways_are_shuffled(spark):
    edges = spark.range(3).selectExpr("int(0) area", "double(id) x1", "0D y1", "double(id) x2", "1D y2")
    ends = ", ".join(f"int(0) {s}_area, id + {k} {s}_node_id, false {s}_is_obstacle, double(id + {k}) {s}_x, 0.5D {s}_y" for k, s in enumerate("ab"))
    corners = ", ".join(f"0D {s}_{c}" for s in "ab" for c in ("left_x", "left_y", "right_x", "right_y"))
    assert "Broadcast" not in plan(spatial.seen(spark.range(3).selectExpr(*f"{ends}, {corners}".split(", ")), edges))


def test_staged_steps_broadcast_only_what_is_hinted(spark, monkeypatch):
    seen = {}
    a, b = spark.range(10), spark.range(10)
    joined = a.join(b, "id").select("id", F.expr("uuid()").alias("u"))
    written = type(joined.write).parquet

    def parquet(self, path, **options):
        seen["plan"] = plan(self._df.sparkSession.range(10).join(b, "id"))
        return written(self, path, **options)

    monkeypatch.setattr(type(joined.write), "parquet", parquet)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    assert staging.cut(joined, "joined").count() == 10
    assert "Broadcast" not in seen["plan"]
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


def test_dissolved_rings_are_shuffled(spark):
    ring = F.array(*(F.struct((F.col("id") + x).cast("double").alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))))
    found = overlay.dissolve(spark.range(2).select(F.lit(0).alias("area"), F.col("id").alias("polygon_id"), F.array(ring).alias("rings")))
    assert "Broadcast" not in plan(found)
    assert [r.size for r in found.select("size").collect()] == [6.0]
