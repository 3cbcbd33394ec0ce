"""Spatial joins by grid cells and bands: equi-joins, so that each can be shuffled and split where it is skewed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyroute.functions import geometry as G
from skyroute.operators.sight import open_pairs, seen_whole
from skyroute.operators.vertices import boxes, explode_vertices, ring_edges
from skyroute.sources.staging import cut, shuffled

#: Side of a grid cell and height of a band, in coordinate units.
CELL = 100.0


def _cells(x1: str, y1: str, x2: str, y2: str, side) -> Column:
    """Cells of a grid with the given side that a box meets."""
    rows = F.sequence(F.floor(F.col(y1) / side), F.floor(F.col(y2) / side))
    columns = F.sequence(F.floor(F.col(x1) / side), F.floor(F.col(x2) / side))
    return F.flatten(F.transform(columns, lambda cx: F.transform(rows, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def points_in_polygons(points: DataFrame, polygons: DataFrame, how: str = "inner", *, band: float = CELL) -> DataFrame:
    """Points (area, point_id, x, y) strictly inside a polygon.

    ``how``: inner gives (point_id, polygon_id) pairs; semi and anti give the points inside any, or none.
    Each polygon lies in at most four cells of a grid as coarse as itself, and a point asks one cell of each such grid for the polygons whose box it is in.  It then
    meets their edges only: these lie in the bands of y that they span and a point in one band, so that an edge right of a point is
    counted once; an odd count is inside.  Points on a boundary are not inside: corners and level edges exactly, others as far as doubles tell.
    """
    b = boxes(polygons)
    size = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    b = b.where(size > 0).withColumn("level", F.ceil(F.log2(size)).cast("int"))
    # a level is the exponent of a double, so there are few, however many polygons there are
    levels = sorted(r.level for r in b.select("level").distinct().collect())
    side = F.pow(F.lit(2.0), F.col("level"))
    b = b.withColumn("cell", F.explode(_cells("min_x", "min_y", "max_x", "max_y", side)))
    probes = points.select("area", "point_id", "x", "y").withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    probes = probes.withColumn("cell", F.struct(F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy")))
    boxed = (F.col("x") > F.col("min_x")) & (F.col("x") < F.col("max_x")) & (F.col("y") > F.col("min_y")) & (F.col("y") < F.col("max_y"))
    probes = probes.join(shuffled(b), ["area", "level", "cell"]).where(boxed).select("area", "point_id", "polygon_id", "x", "y", F.floor(F.col("y") / band).alias("band"))
    edges = ring_edges(explode_vertices(polygons))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    edges = edges.withColumn("band", F.explode(F.sequence(F.floor(low / band), F.floor(high / band))))
    e = edges.drop("ring_idx", "vertex_idx")
    flat = F.col("y1") == F.col("y2")
    at = F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))
    crossing = ~flat & (low <= F.col("y")) & (F.col("y") < high) & (at > F.col("x"))
    at_end = ((F.col("x") == F.col("x1")) & (F.col("y") == F.col("y1"))) | ((F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2")))
    beside = F.when(flat, F.col("x").between(F.least("x1", "x2"), F.greatest("x1", "x2"))).otherwise(at == F.col("x"))
    touching = at_end | (F.col("y").between(low, high) & beside)
    pairs = (
        probes.join(shuffled(e), ["area", "polygon_id", "band"])
        .where(crossing | touching)
        .groupBy("area", "point_id", "polygon_id")
        .agg(F.count(F.when(crossing, 1)).alias("n"), F.count(F.when(touching, 1)).alias("touching"))
        .where("n % 2 = 1 and touching = 0")
        .select("area", "point_id", "polygon_id")
    )
    if how == "inner":
        return pairs.select("point_id", "polygon_id")
    return points.join(shuffled(pairs), ["area", "point_id"], "left_semi" if how == "semi" else "left_anti")


def bbox_intersects(zones: DataFrame, queries: DataFrame, *, cell: float = 500.0) -> DataFrame:
    """(query_id, zone_id) where boxes (min_x, min_y, max_x, max_y) meet; touching counts."""
    box = ("min_x", "min_y", "max_x", "max_y")
    z = zones.select("zone_id", *(F.col(c).alias(f"z_{c}") for c in box), F.explode(G.box_cells(*box, cell)).alias("cell"))
    q = queries.select("query_id", *box, F.explode(G.box_cells(*box, cell)).alias("cell"))
    return (
        q.join(z, "cell")
        .where("z_min_x <= max_x and z_max_x >= min_x and z_min_y <= max_y and z_max_y >= min_y")
        # of the cells that both share, the first one owns the pair
        .where((F.col("cell.cx") == F.floor(F.greatest("min_x", "z_min_x") / cell)) & (F.col("cell.cy") == F.floor(F.greatest("min_y", "z_min_y") / cell)))
        .select("query_id", "zone_id")
    )


def near_pairs(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """All columns of left (a_*) and right (b_*) rows of one area at most ``radius`` apart; both have area, x and y."""
    a = left.select(*(F.col(c).alias(f"a_{c}") for c in left.columns), F.floor(F.col("x") / radius).alias("cx"), F.floor(F.col("y") / radius).alias("cy"))
    around = F.array(*(F.struct((F.floor(F.col("x") / radius) + i).alias("cx"), (F.floor(F.col("y") / radius) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    b = right.select(*(F.col(c).alias(f"b_{c}") for c in right.columns), F.explode(around).alias("c")).select("*", "c.cx", "c.cy").drop("c")
    on = (F.col("a_area") == F.col("b_area")) & (a.cx == b.cx) & (a.cy == b.cy)
    return a.join(shuffled(b), on).where(G.distance("a_x", "a_y", "b_x", "b_y") <= radius).drop("cx", "cy")


def same_location_pairs(nodes: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """(src, dst), src < dst: nodes so near that they see each other whatever is between."""
    return near_pairs(nodes, nodes, tolerance).where("a_node_id < b_node_id").select(F.col("a_node_id").alias("src"), F.col("b_node_id").alias("dst"))


def visible_pairs(
    nodes: DataFrame, obstacle_edges: DataFrame, max_edge: float | None = None, *, targets: DataFrame | None = None, tolerance: float = 0.5, taut: bool = False, once: bool | None = None,
) -> DataFrame:
    """(area, src, dst, length): nodes that see each other, at most ``max_edge`` apart, or at any distance if it is None.

    A pair sees each other if it is within ``tolerance``, or if the way starts inside an obstacle's corner at neither
    end and properly crosses no obstacle edge.  Nodes have node_id, is_obstacle, x, y and the neighbours of obstacle
    vertices.  An area that is small as a whole is one task's (``sight.seen_whole``); in others, pairs with a wall between
    are not made (``sight.open_pairs``), and the corners of those left are tested.
    With ``targets``, pairs are of one node and one target instead, src the target; with ``once``, only those whose target has the smaller id.

    With ``taut``, a way must be tangent to the corners at its ends: others are on no shortest path between points that are
    not obstacle vertices.  Nodes with another one within ``tolerance`` (column ``loose``, see ``with_loose``) keep all ways, as a path can jump there.
    """
    once = targets is None if once is None else once
    found, others = seen_whole(nodes if targets is None else targets, nodes, obstacle_edges, max_edge, once=once, tolerance=tolerance, taut=taut)
    if others:
        sources, nodes, obstacle_edges = others
        pairs = open_pairs(sources.select(*nodes.columns), nodes, obstacle_edges, max_edge, once=once, tolerance=tolerance).where("a_node_id <> b_node_id")
        found = found.union(seen(pairs, tolerance=tolerance, taut=taut))
    return found


def with_loose(nodes: DataFrame, others: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """``nodes`` with ``loose``: whether another node of the table or of ``others`` is within ``tolerance``."""
    cols = ["area", "node_id", "x", "y"]
    near = near_pairs(nodes.select(*cols), nodes.select(*cols).union(others.select(*cols)), tolerance).where("a_node_id <> b_node_id")
    return nodes.join(shuffled(near.select(F.col("a_node_id").alias("node_id"), F.lit(True).alias("l")).distinct()), "node_id", "left").select(*nodes.columns, F.coalesce("l", F.lit(False)).alias("loose"))


def in_cells(rows: DataFrame, x1: str, y1: str, x2: str, y2: str, size: float) -> DataFrame:
    """A row for each cell (cx, cy) of ``G.crossed_cells``, made by two plain explodes, which are compiled."""
    x, y, u, v = (F.col(c) for c in (x1, y1, x2, y2))
    rows = rows.select("*", F.explode(F.sequence(F.floor(F.least(x, u) / size), F.floor(F.greatest(x, u) / size))).alias("cx"))
    at = lambda to: F.when(x == u, None).otherwise(y + (v - y) / F.nullif(u - x, F.lit(0.0)) * (to - x))
    low, high = F.greatest(F.least(x, u), F.col("cx") * size), F.least(F.greatest(x, u), (F.col("cx") + 1) * size)
    rows = rows.select("*", F.coalesce(at(low), y).alias("_ya"), F.coalesce(at(high), v).alias("_yb"))
    down, up = F.floor(F.least("_ya", "_yb") / size - 1e-9), F.floor(F.greatest("_ya", "_yb") / size + 1e-9)
    return rows.select("*", F.explode(F.sequence(down, up)).alias("cy")).drop("_ya", "_yb")


def seen(pairs: DataFrame, obstacle_edges: DataFrame | None = None, *, cell: float = 50.0, tolerance: float = 0.5, taut: bool = False) -> DataFrame:
    """(area, src, dst, length) of the pairs (a_*, b_*) that see each other; see ``visible_pairs``.

    The ways that the corners leave meet the edges in the grid cells that they pass; without edges, as for the pairs of ``open_pairs``, only the corners are tested.
    If the edges have the right neighbour of their first vertex (right_x, right_y), ways that enter an obstacle through a vertex are blocked, too.
    """
    ends = {s: [f"{s}_{c}" for c in ("x", "y", "left_x", "left_y", "right_x", "right_y")] for s in "ab"}
    pairs = pairs.withColumn("length", G.distance("a_x", "a_y", "b_x", "b_y")).withColumn("near", F.col("length") <= tolerance)
    for s, o in (("a", "b"), ("b", "a")):
        pairs = pairs.where(F.col("near") | ~F.col(f"{s}_is_obstacle") | ~G.enters_polygon(f"{o}_x", f"{o}_y", *ends[s]))
        if taut:
            pairs = pairs.where(F.col("near") | ~F.col(f"{s}_is_obstacle") | F.col(f"{s}_loose") | G.is_tangent(f"{o}_x", f"{o}_y", *ends[s]))
    if obstacle_edges is None:
        return pairs.select(F.col("a_area").alias("area"), F.col("a_node_id").alias("src"), F.col("b_node_id").alias("dst"), "length")
    pairs = pairs.select(F.col("a_area").alias("area"), F.col("a_node_id").alias("src"), F.col("b_node_id").alias("dst"), "a_x", "a_y", "b_x", "b_y", "length", "near")
    pairs = cut(pairs, "pairs")  # what is left after the corners; read for the ways and for the answer
    ways = in_cells(pairs.where("not near"), "a_x", "a_y", "b_x", "b_y", cell)
    corner = ["right_x", "right_y"] if "right_x" in obstacle_edges.columns else []
    edges = in_cells(obstacle_edges.select("area", "x1", "y1", "x2", "y2", *corner), "x1", "y1", "x2", "y2", cell)
    blocked = G.properly_cross("a_x", "a_y", "b_x", "b_y", "x1", "y1", "x2", "y2")
    if corner:
        blocked = blocked | G.passes_through("a_x", "a_y", "b_x", "b_y", "x1", "y1", "x2", "y2", *corner)
    crossing = ways.join(shuffled(edges), ["area", "cx", "cy"]).where(blocked).select("src", "dst").distinct()
    return pairs.join(shuffled(crossing), ["src", "dst"], "left_anti").select("area", "src", "dst", "length")


def recharge_candidates(state: DataFrame, waters: DataFrame, *, cell: float = 500.0) -> DataFrame:
    """(request_id, node_id, place): water nodes within straight range of a leg's start, nearest to the last reachable point first.

    ``state`` has request_id, area, x, y (leg start), range, last_x and last_y; ties go to the smaller node.
    """
    s = state.select("*", F.explode(G.box_cells(F.col("x") - F.col("range"), F.col("y") - F.col("range"), F.col("x") + F.col("range"), F.col("y") + F.col("range"), cell)).alias("cell"))
    w = waters.select(
        "area", "node_id", F.col("x").alias("w_x"), F.col("y").alias("w_y"),
        F.struct(F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).alias("cell"),
    )
    found = s.join(shuffled(w), ["area", "cell"]).where(G.distance("x", "y", "w_x", "w_y") <= F.col("range"))
    order = Window.partitionBy("request_id").orderBy(G.distance("w_x", "w_y", "last_x", "last_y"), "node_id")
    return found.select("request_id", "node_id", F.row_number().over(order).alias("place"))
