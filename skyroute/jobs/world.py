"""A world of towns derived from the given tables by integer arithmetic.

An area is an independent town of 1,000 x 1,000 units.  Parts are buildings, suppliers are lakes, customers are requests
and orders are probe points, paths and pixels.  The SQL in ``oracles`` repeats the recipes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ring(points: list[tuple[str, str]]) -> str:
    return "array(" + ", ".join(f"named_struct('x', double(x0 + {x}), 'y', double(y0 + {y}))" for x, y in points + points[:1]) + ")"


_SQUARE = [("0", "0"), ("s", "0"), ("s", "s"), ("0", "s")]
_ELL = [("0", "0"), ("s", "0"), ("s", "s div 2"), ("s div 2", "s div 2"), ("s div 2", "s"), ("0", "s")]
_HOLE = [("s div 4", "s div 4"), ("s - s div 4", "s div 4"), ("s - s div 4", "s - s div 4"), ("s div 4", "s - s div 4")]


def obstacles(spark: SparkSession, sf_dir: str, raw: bool = False) -> DataFrame:
    """(area, polygon_id, rings); raw ones have some holes and, for odd keys, rings stored clockwise."""
    base = table(spark, sf_dir, "part").selectExpr("p_partkey k", "p_size").selectExpr(
        "k", "int(k div 100) area", "k % 100 % 10 * 100 + k * 37 % 30 x0", "k % 100 div 10 * 100 + k * 53 % 30 y0", "2 * (5 + p_size div 2) s"
    )
    outer = f"IF(k % 4 = 0, {_ring(_ELL)}, {_ring(_SQUARE)})"
    if not raw:
        return base.selectExpr("area", "k polygon_id", f"array({outer}) rings")
    rings = f"IF(k % 7 = 0 AND k % 4 <> 0, array({outer}, {_ring(_HOLE)}), array({outer}))"
    return base.selectExpr("area", "k polygon_id", f"IF(k % 2 = 1, transform({rings}, r -> reverse(r)), {rings}) rings")


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(area, polygon_id, rings): a slanted triangle beside and over each building."""
    base = table(spark, sf_dir, "part").selectExpr("p_partkey k", "p_size").selectExpr(
        "k", "int(k div 100) area", "k % 100 % 10 * 100 + k * 37 % 30 + 15 x0", "k % 100 div 10 * 100 + k * 53 % 30 + 10 y0", "2 * (5 + p_size div 2) s"
    )
    return base.selectExpr("area", "k polygon_id", f"array({_ring([('0', '0'), ('s', 's div 3'), ('s div 4', 's')])}) rings")


def waters(spark: SparkSession, sf_dir: str) -> DataFrame:
    square = [("0", "0"), ("6", "0"), ("6", "6"), ("0", "6")]
    base = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey t", "int(s_suppkey div 5) area", "(s_suppkey % 5 * 3 + 1) % 10 * 100 + 92 x0", "(s_suppkey % 5 * 7 + 2) % 10 * 100 + 92 y0"
    )
    return base.selectExpr("area", "t polygon_id", f"array({_ring(square)}) rings")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey request_id", "int(c_custkey div 75) area",
        "double(c_custkey % 10 * 100 + 95) start_x", "double(c_custkey div 10 % 10 * 100 + 91) start_y",
        "double((c_custkey * 3 + 7) % 10 * 100 + 91) end_x", "double((c_custkey * 7 + 3) % 10 * 100 + 96) end_y",
        "double(200 + c_custkey % 5 * 100) max_initial", "double(400 + c_custkey % 3 * 100) max_after",
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points at halves of units, never on a boundary."""
    return table(spark, sf_dir, "orders").selectExpr(
        "int(o_orderkey % 20) area", "o_orderkey point_id", "o_orderkey % 1000 + 0.5D x", "o_orderkey div 1000 % 1000 + 0.5D y"
    )


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_custkey path_id", "o_orderkey seq", "double(o_orderkey % 1000) x", "double(o_orderkey * 7 % 1000) y")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).selectExpr(
        "n_nationkey zone_id", "n_name name", "n_nationkey * 10 + 0.7D lower", "n_nationkey * 10 + 50.2D upper",
        "IF(n_nationkey % 2 = 0, upper(r_name), lower(r_name)) category",
        "double(n_nationkey % 5 * 400) min_x", "double(n_nationkey div 5 * 400) min_y",
        "double(n_nationkey % 5 * 400 + 300) max_x", "double(n_nationkey div 5 * 400 + 300) max_y",
    )


#: Corners of a zone that is no box, of its hole, and of the second part that every third zone has.
ZONE_OUTER, ZONE_HOLE, ZONE_PART = ((0, 0), (300, 60), (180, 300), (40, 200)), ((100, 90), (100, 180), (190, 120)), ((310, 310), (380, 320), (320, 390))


def shaped_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The zones with polygons in place of boxes, as the GeoJSON reader gives them."""
    ring = lambda corners: F.array(*(F.array(F.col("min_x") + x, F.col("min_y") + y) for x, y in (*corners, corners[0])))
    first = F.array(ring(ZONE_OUTER), ring(ZONE_HOLE))
    polygons = F.when(F.col("zone_id") % 3 == 0, F.array(first, F.array(ring(ZONE_PART)))).otherwise(F.array(first))
    return zones(spark, sf_dir).select("zone_id", "name", F.col("lower").cast("int").alias("lower"), F.ceil("upper").cast("int").alias("upper"), "category", polygons.alias("polygons"))


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").where("r_regionkey <> 4").selectExpr("r_name category", "explode(array(concat('ask the ', r_name), concat('avoid ', r_name))) condition")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, px, py, b, g, r): one pixel per order, 100 x 100 to an image."""
    colour = """CASE WHEN o_orderkey % 4999 = 0 THEN array(255, 0, 255) WHEN o_orderpriority = '1-URGENT' THEN array(75, 25, 230)
        WHEN o_orderpriority = '2-HIGH' THEN array(48, 130, 245) WHEN o_orderpriority = '3-MEDIUM' THEN array(75, 180, 60) ELSE array(255, 255, 255) END c"""
    return (
        table(spark, sf_dir, "orders")
        .selectExpr("o_orderkey div 10000 image_id", "int(o_orderkey % 100) px", "int(o_orderkey div 100 % 100) py", colour)
        .selectExpr("image_id", "px", "py", "c[0] b", "c[1] g", "c[2] r")
    )


def chip_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, stem, labels): label pixel counts of each chip as a map, which may be empty."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = d.select("doc_id", "lang", "source", "n_chars").join(lab, "doc_id", "left")
    counts = """map_filter(map('building', IF(quality = 1, n_chars * 13 % 40000, 0), 'water', IF(toxic = 1, n_chars * 7 % 40000, 0)), (k, v) -> v > 0) labels"""
    return joined.selectExpr("lang dataset", "format_string('%s-%06d', source, doc_id) stem", counts)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pixel_id, truth, weight, scores): the first ten dimensions of the embeddings as class scores."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id pixel_id", "label truth", "1 + label / 10D weight", "transform(slice(embedding, 1, 10), x -> double(x)) scores"
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, metric map): per run the values of its events in time order."""
    e = table(spark, sf_dir, "events").where("user_id is not null and value is not null")
    return e.groupBy("user_id").agg(F.expr("transform(array_sort(collect_list(struct(ts, event_id, value))), x -> x.value) val_loss")).selectExpr("user_id run", "val_loss")
