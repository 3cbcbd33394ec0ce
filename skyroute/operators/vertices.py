"""Polygon layers as tables of vertices and edges.

A layer is (area, polygon_id, rings): ``area`` is a partition of the plane whose polygons never meet those of another, and
rings are closed lists of (x, y), the outer one first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyroute.functions import geometry as G


def normalize_winding(polygons: DataFrame) -> DataFrame:
    """Outer rings counter-clockwise, inner ones clockwise."""
    return polygons.withColumn("rings", G.normalised_rings("rings"))


def explode_vertices(polygons: DataFrame) -> DataFrame:
    """One row per vertex without the closing one: its address, ring size ``n``, and the neighbours on both sides."""
    rings = polygons.select("area", "polygon_id", F.posexplode("rings").alias("ring_idx", "ring")).where(F.size("ring") > 1)
    rings = rings.withColumn("ring", F.slice("ring", 1, F.size("ring") - 1))
    rows = rings.select("area", "polygon_id", "ring_idx", "ring", F.posexplode("ring").alias("vertex_idx", "v"))
    n, i = F.size("ring"), F.col("vertex_idx")
    left, right = F.element_at("ring", F.pmod(i + 1, n) + 1), F.element_at("ring", F.pmod(i - 1, n) + 1)
    return rows.select(
        "area", "polygon_id", "ring_idx", "vertex_idx", n.alias("n"), "v.x", "v.y",
        left["x"].alias("left_x"), left["y"].alias("left_y"), right["x"].alias("right_x"), right["y"].alias("right_y"),
    )


def ring_edges(vertices: DataFrame) -> DataFrame:
    """Segment from each vertex to the next one of its ring."""
    return vertices.select("area", "polygon_id", "ring_idx", "vertex_idx", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("left_x").alias("x2"), F.col("left_y").alias("y2"))


def walls(vertices: DataFrame) -> DataFrame:
    """The edges with the vertex before their first one, as ``spatial.seen`` takes them to tell ways through corners."""
    return vertices.select("area", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("left_x").alias("x2"), F.col("left_y").alias("y2"), "right_x", "right_y")


def boxes(polygons: DataFrame) -> DataFrame:
    """(area, polygon_id, min_x, min_y, max_x, max_y) of the outer rings."""
    outer = F.element_at("rings", 1)
    xs, ys = F.transform(outer, lambda p: p["x"]), F.transform(outer, lambda p: p["y"])
    return polygons.select(
        "area", "polygon_id", F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y")
    )
