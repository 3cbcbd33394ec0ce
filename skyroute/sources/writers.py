"""GeoJSON as lines of features, one for each row; a collection is a file of such lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyroute.functions.projections import to_external
from skyroute.sources.staging import shuffled


def _points(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.array(p["x"], p["y"]))


def _degrees(point: Column) -> Column:
    lng, lat = to_external(point["x"], point["y"])
    return F.struct(lng.alias("x"), lat.alias("y"))


def rings_in_degrees(polygons: DataFrame) -> DataFrame:
    """Polygons with rings in EPSG 3035 metres as longitudes and latitudes."""
    return polygons.withColumn("rings", F.transform("rings", lambda ring: F.transform(ring, _degrees)))


def points_in_degrees(rows: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Rows with a point in EPSG 3035 metres as longitude and latitude."""
    lng, lat = to_external(F.col(x), F.col(y))
    return rows.withColumns({x: lng, y: lat})


def legs_in_degrees(legs: DataFrame) -> DataFrame:
    """Legs with target and line in EPSG 3035 metres as longitudes and latitudes."""
    return points_in_degrees(legs, "target_x", "target_y").withColumn("line", F.transform("line", _degrees))


def feature(kind: str, coordinates: Column, properties: Column) -> Column:
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry")))


def class_features(polygons: DataFrame, class_col: str) -> DataFrame:
    """(value): a Polygon feature of each row with its class as the property ``type``."""
    return polygons.select(feature("Polygon", F.transform("rings", _points), F.struct(F.col(class_col).alias("type"))).alias("value"))


def path_features(points: DataFrame) -> DataFrame:
    """(value): a LineString feature of each path (request_id, place, x, y, cumulated) with its length as ``distance``."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("place", "x", "y"))), lambda p: F.array(p["x"], p["y"]))
    paths = points.groupBy("request_id").agg(line.alias("line"), F.max("cumulated").alias("distance"))
    return paths.select(feature("LineString", F.col("line"), F.struct("request_id", "distance")).alias("value"))


def graph_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(value): a Point feature of each node and a LineString feature of each edge."""
    place = nodes.select("node_id", "x", "y")
    points = nodes.select(feature("Point", F.array("x", "y"), F.struct("node_id")).alias("value"))
    ends = edges.join(shuffled(place.toDF("src", "ax", "ay")), "src").join(shuffled(place.toDF("dst", "bx", "by")), "dst")
    lines = ends.select(feature("LineString", F.array(F.array("ax", "ay"), F.array("bx", "by")), F.struct("src", "dst", "length")).alias("value"))
    return points.union(lines)


def leg_features(legs: DataFrame) -> DataFrame:
    """(value): of each leg (request_id, leg_no, status, target_x, target_y, line, length) the Point it ends at and the LineString it follows.

    A leg without a target has no Point, one without a line of two points has no LineString.
    """
    properties = F.struct("request_id", "leg_no", "status", "length")
    point = F.when(F.col("target_x").isNotNull() & F.col("target_y").isNotNull(), feature("Point", F.array("target_x", "target_y"), properties))
    line = F.when(F.size("line") > 1, feature("LineString", _points(F.col("line")), properties))
    return legs.select(F.explode(F.array_compact(F.array(point, line))).alias("value"))


def write_features(features: DataFrame, path: str) -> None:
    features.write.text(path)


def write_examples(examples: DataFrame, path: str) -> None:
    """Example pairs (stem, image, label_mask, split) as Parquet, a folder for each split."""
    examples.write.partitionBy("split").parquet(path)


def write_chip_metadata(counts: DataFrame, path: str, size: tuple[int, int], stride: tuple[int, int]) -> None:
    """Chip metadata of (stem, label, pixels) as ``readers.read_chip_metadata`` takes it, a line for each chip; a chip whose only row has no label has none."""
    labels = F.map_from_entries(F.array_compact(F.sort_array(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "pixels"))))))
    pair = lambda p: F.array(*map(F.lit, p))
    chips = counts.groupBy("stem").agg(labels.alias("labels"))
    line = F.struct(pair(size).alias("size"), pair(stride).alias("stride"), F.create_map("stem", "labels").alias("nbroLabelPixels"))
    chips.select(F.to_json(line).alias("value")).write.text(path)
