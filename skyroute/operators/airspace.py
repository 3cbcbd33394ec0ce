"""Airspace zones, their conditions, and paths that meet them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyroute.functions import geometry as G
from skyroute.operators.spatial import points_in_polygons
from skyroute.operators.vertices import explode_vertices, ring_edges


def geozones_with_conditions(zones: DataFrame, conditions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(zones with ``conditions``, zones without any): categories match whatever their case; the list is empty without conditions."""
    lists = conditions.groupBy(F.lower("category").alias("c")).agg(F.sort_array(F.collect_list("condition")).alias("conditions"))
    both = zones.join(lists, F.lower("category") == F.col("c"), "left").drop("c")
    return both.withColumn("conditions", F.coalesce("conditions", F.array().cast("array<string>"))), both.where("conditions is null").drop("conditions")


def path_zone_conflicts(paths: DataFrame, zones: DataFrame, altitude: float, *, cell: float = 100.0) -> DataFrame:
    """(path_id, zone_id): paths (path_id, seq, x, y) that enter a box-shaped zone whose limits hold the altitude.

    A segment meets a box if it has an end in it or crosses one of its diagonals; both are listed by grid cell.
    """
    order = Window.partitionBy("path_id").orderBy("seq")
    steps = paths.select("path_id", "x", "y", F.lead("x").over(order).alias("nx"), F.lead("y").over(order).alias("ny")).where("nx is not null")
    steps = steps.withColumn("cell", F.explode(G.crossed_cells("x", "y", "nx", "ny", cell)))
    on = zones.where((F.col("lower") <= altitude) & (F.col("upper") >= altitude))
    on = on.select("zone_id", "min_x", "min_y", "max_x", "max_y", F.explode(G.box_cells("min_x", "min_y", "max_x", "max_y", cell)).alias("cell"))
    inside = lambda x, y: F.col(x).between(F.col("min_x"), F.col("max_x")) & F.col(y).between(F.col("min_y"), F.col("max_y"))
    crosses = G.properly_cross("x", "y", "nx", "ny", "min_x", "min_y", "max_x", "max_y") | G.properly_cross("x", "y", "nx", "ny", "min_x", "max_y", "max_x", "min_y")
    return steps.join(on, "cell").where(inside("x", "y") | inside("nx", "ny") | crosses).select("path_id", "zone_id").distinct()


#: Ways shorter than this are points: they are in no zone by themselves.
SHORTEST = 1e-9


def zone_passages(paths: DataFrame, zones: DataFrame, conditions: DataFrame, altitude: float, *, cell: float = 100.0) -> DataFrame:
    """(path_id, zone_id, enters, leaves, conditions): the stretches of paths (path_id, seq, x, y) strictly inside zones whose limits hold the altitude.

    Zones (zone_id, lower, upper, category, polygons) are as ``read_geozones`` gives them, of any shape and with holes; ``enters`` and ``leaves``
    are lengths along the path.  The edges of all zones cut a path's steps where they meet them (by grid cell); between two cuts a way is inside a zone or outside as a
    whole, so that its middle tells.  Ways along a border are outside.  A path of one point, or of none, has no stretch.
    """
    both, _ = geozones_with_conditions(zones.where((F.col("lower") <= altitude) & (F.col("upper") >= altitude)), conditions)
    parts = both.select("zone_id", F.posexplode("polygons").alias("part", "p"))
    rings = F.transform("p", lambda ring: F.transform(ring, lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))))
    polygons = parts.select(F.lit(0).alias("area"), F.struct("zone_id", "part").alias("polygon_id"), rings.alias("rings"))
    edges = ring_edges(explode_vertices(polygons)).select("x1", "y1", "x2", "y2").distinct()
    order = Window.partitionBy("path_id").orderBy("seq")
    steps = paths.select("path_id", "seq", "x", "y", F.lead("x").over(order).alias("nx"), F.lead("y").over(order).alias("ny")).where("nx is not null")
    steps = steps.withColumn("length", G.distance("x", "y", "nx", "ny"))
    steps = steps.withColumn("before", F.sum("length").over(order) - F.col("length"))
    rx, ry, sx, sy = (F.col(a) - F.col(b) for a, b in (("nx", "x"), ("ny", "y"), ("x2", "x1"), ("y2", "y1")))
    qx, qy, d = F.col("x1") - F.col("x"), F.col("y1") - F.col("y"), F.nullif(rx * sy - ry * sx, F.lit(0.0))
    crossed = lambda df, *ends: df.withColumn("cell", F.explode(G.crossed_cells(*ends, cell)))
    met = crossed(steps, "x", "y", "nx", "ny").join(crossed(edges, "x1", "y1", "x2", "y2"), "cell")
    met = met.withColumns({"t": (qx * sy - qy * sx) / d, "u": (qx * ry - qy * rx) / d})
    # a corner that rounding moves off both its edges is still a cut; one too many does no harm
    cuts = met.where("t > 0 and t < 1").where(F.col("u").between(-SHORTEST, 1 + SHORTEST)).select("path_id", "seq", "t").distinct()
    ways = steps.select("path_id", "seq", F.lit(0.0).alias("t")).union(cuts).join(steps, ["path_id", "seq"])
    until = F.coalesce(F.lead("t").over(Window.partitionBy("path_id", "seq").orderBy("t")), F.lit(1.0))
    ways = ways.withColumn("until", until).where((F.col("until") - F.col("t")) * F.col("length") > SHORTEST)
    middle = lambda a, b: F.col(a) + (F.col("t") + F.col("until")) / 2 * (F.col(b) - F.col(a))
    ways = ways.select(
        "path_id", F.row_number().over(Window.partitionBy("path_id").orderBy("seq", "t")).alias("n"), middle("x", "nx").alias("x"), middle("y", "ny").alias("y"),
        (F.col("before") + F.col("t") * F.col("length")).alias("enters"), (F.col("before") + F.col("until") * F.col("length")).alias("leaves"),
    )
    # what is asked about a way travels with its middle, so that nothing has to be joined back
    points = ways.select(F.lit(0).alias("area"), F.struct("path_id", "n", "enters", "leaves").alias("point_id"), "x", "y")
    inside = points_in_polygons(points, polygons).select("point_id.*", "polygon_id.zone_id").distinct()
    row = F.row_number().over(Window.partitionBy("path_id", "zone_id").orderBy("n"))
    stretches = inside.withColumn("run", F.col("n") - row).groupBy("path_id", "zone_id", "run").agg(F.min("enters").alias("enters"), F.max("leaves").alias("leaves"))
    return stretches.join(both.select("zone_id", "conditions"), "zone_id").select("path_id", "zone_id", "enters", "leaves", "conditions")
