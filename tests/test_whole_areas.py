"""Small areas as a whole give the pairs that rings give, and need no rings."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from skyroute.operators import graph, sight, spatial


@pytest.fixture(scope="module")
def towns(spark):
    """Squares and triangles on a coarse grid, many of them in one line, some that touch a node's line; nodes at their corners, in lanes and at one place."""
    rng = np.random.default_rng(11)
    walls, nodes = [], []
    for area in range(5):
        for k in range(36):
            x, y, s = 60 * (k % 6) + int(rng.integers(0, 3)) * 10, 60 * (k // 6) + int(rng.integers(0, 3)) * 10, int(rng.choice([10, 20, 30]))
            ring = [(x, y), (x + s, y), (x + s, y + s), (x, y + s)] if k % 3 else [(x, y), (x + s, y), (x, y + s)]
            for v in range(len(ring)):
                at, left, right = ring[v], ring[(v + 1) % len(ring)], ring[v - 1]
                walls.append((area, *map(float, at + left + right)))
                nodes.append((area, 1000 * area + 10 * k + v, True, v == 0, *map(float, at + left + right)))
        for k in range(20):
            x, y = map(float, rng.integers(-2, 38, 2) * 10 + 5)
            nodes += [(area, 1000 * area + 900 + 2 * k + d, False, False, x + d * 0.25, y, None, None, None, None) for d in range(1 + (k == 0))]
    nodes = spark.createDataFrame(nodes, "area int, node_id long, is_obstacle boolean, loose boolean, x double, y double, left_x double, left_y double, right_x double, right_y double")
    return nodes, spark.createDataFrame(walls, "area int, x1 double, y1 double, x2 double, y2 double, right_x double, right_y double")


def _rows(df):
    return sorted(map(tuple, df.select("area", "src", "dst", "length").collect()))


@pytest.mark.parametrize("given", [{}, {"taut": True}, {"max_edge": 90.0}, {"points": True}, {"plain": True}])
def test_as_by_rings(towns, monkeypatch, given):
    nodes, walls = towns
    more = {k: v for k, v in given.items() if k in ("taut", "max_edge")}
    if "points" in given:
        more["targets"] = nodes.where("node_id % 1000 >= 900")
    if "plain" in given:
        walls = walls.drop("right_x", "right_y")
    whole = _rows(spatial.visible_pairs(nodes, walls, **more))
    monkeypatch.setattr(sight, "WHOLE", 0)
    assert len(whole) > 500 and whole == _rows(spatial.visible_pairs(nodes, walls, **more))
    some = nodes.where("area < 3 or node_id % 2 = 0")
    want = _rows(spatial.visible_pairs(some, walls, **more))
    monkeypatch.setattr(sight, "WHOLE", 20_000)  # some areas, not all
    monkeypatch.setattr(sight, "BLOCK", 100)
    assert want == _rows(spatial.visible_pairs(some, walls, **more))


def test_no_rings_for_small_areas(towns, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("rings")

    nodes, walls = towns
    monkeypatch.setattr(spatial, "open_pairs", refuse)
    assert spatial.visible_pairs(nodes, walls).count() > 500
    free = nodes.where("not is_obstacle")
    assert spatial.visible_pairs(free, walls.where("false")).count() == 5 * (21 * 20 // 2)


def test_nodes_inside_as_by_grids(spark, monkeypatch):
    """Polygons that overlap and touch each other's corners, some with holes; null areas have no nodes."""
    rng = np.random.default_rng(5)
    ring = lambda x, y, s: [(float(x + a * s), float(y + b * s)) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]
    rows = []
    for k in range(120):
        x, y, s = (10 * int(v) for v in (*rng.integers(0, 14, 2), rng.integers(1, 5)))
        rows.append((k % 4, k, [ring(x, y, s)] + ([ring(x + s / 4, y + s / 4, s / 2)[::-1]] if k % 5 == 0 else [])))
    polygons = spark.createDataFrame(rows, "area int, polygon_id long, rings array<array<struct<x:double,y:double>>>")
    waters = polygons.withColumn("rings", F.expr("transform(rings, r -> transform(r, p -> named_struct('x', p.x + 5, 'y', p.y + 5)))"))
    rows = lambda: sorted(map(tuple, graph.graph_nodes(polygons, waters).collect()))
    whole = rows()
    monkeypatch.setattr(sight, "WHOLE", 0)
    assert 100 < len(whole) < 900 and whole == rows()
