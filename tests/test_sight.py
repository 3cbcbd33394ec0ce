"""Distances of the requests against a plain search over all corners of their town."""

import numpy as np
import pytest

from skyroute.jobs import queries, world
from skyroute.operators import sight, spatial
from skyroute.sources.staging import cut

SF = "/root/testdata/sf0.001"


def town_distances(boxes, asked):
    """Length of the shortest way of each (start, end) around the open boxes, by a dense search."""
    corners = np.array([(x, y) for x0, y0, x1, y1 in boxes for x in (x0, x1) for y in (y0, y1)])
    points = np.vstack([corners, [p for pair in asked for p in pair]])
    a, d = points[:, None, :], points[None, :, :] - points[:, None, :]
    length = np.hypot(d[..., 0], d[..., 1])
    blocked = np.zeros(length.shape, dtype=bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        for x0, y0, x1, y1 in boxes:
            low, high = np.zeros(length.shape), np.ones(length.shape)
            for k, lo, hi in ((0, x0, x1), (1, y0, y1)):
                t, u = (lo - a[..., k]) / d[..., k], (hi - a[..., k]) / d[..., k]
                still = d[..., k] == 0
                between = (lo < a[..., k]) & (a[..., k] < hi)
                low = np.maximum(low, np.where(still, np.where(between, 0, 2), np.minimum(t, u)))
                high = np.minimum(high, np.where(still, 1, np.maximum(t, u)))
            blocked |= low < high - 1e-12
    length[blocked] = np.inf
    out = []
    for k in range(len(asked)):
        here, end = len(corners) + 2 * k, len(corners) + 2 * k + 1
        usable = np.r_[np.arange(len(corners)), here, end]
        best = np.full(len(points), np.inf)
        best[here], open_ = 0.0, set(usable.tolist())
        while open_:
            n = min(open_, key=best.__getitem__)
            if n == end or best[n] == np.inf:
                break
            open_.remove(n)
            best[usable] = np.minimum(best[usable], best[n] + length[n, usable])
        out.append(best[end])
    return out


def test_distances_are_true(spark):
    boxes, asked = {}, {}
    for o in world.obstacles(spark, SF).collect():
        ring = o.rings[0]
        x, y, s = ring[0].x, ring[0].y, ring[1].x - ring[0].x
        ell = len(ring) == 7
        boxes.setdefault(o.area, []).extend([(x, y, x + s, y + s // 2), (x, y, x + s // 2, y + s)] if ell else [(x, y, x + s, y + s)])
    for r in world.requests(spark, SF).collect():
        asked.setdefault(r.area, []).append((r.request_id, ((r.start_x, r.start_y), (r.end_x, r.end_y))))
    expected = {}
    for area, rows in asked.items():
        found = town_distances(boxes.get(area, []), [p for _, p in rows])
        expected |= {k: pytest.approx(v, abs=1e-5) for (k, _), v in zip(rows, found, strict=True)}
    got = {r.request_id: r.distance for r in queries.queries()["shortest_paths"](spark, SF).collect()}
    assert got == expected


def test_ways_of_any_length(spark):
    """A way over 1,000 units, and one through two opposite corners of a building."""
    square = [(100.0, 100.0), (140.0, 100.0), (140.0, 140.0), (100.0, 140.0)]
    walls = [(0, *square[k], *square[(k + 1) % 4], *square[k - 1]) for k in range(4)]
    walls = spark.createDataFrame(walls, "area int, x1 double, y1 double, x2 double, y2 double, right_x double, right_y double")
    places = {1: (0.0, 0.0), 2: (1000.0, 0.0), 3: (200.0, 200.0), 4: (0.0, 1400.0)}
    none = "double(null) left_x, double(null) left_y, double(null) right_x, double(null) right_y".split(", ")
    nodes = spark.createDataFrame([(0, n, False, x, y) for n, (x, y) in places.items()], "area int, node_id long, is_obstacle boolean, x double, y double").selectExpr("*", *none)
    got = {(r.src, r.dst) for r in spatial.visible_pairs(nodes, walls).collect()}
    assert got == {(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)}


def _walls(spark, squares):
    corner = lambda q, k: [(q[0], q[1]), (q[0] + q[2], q[1]), (q[0] + q[2], q[1] + q[2]), (q[0], q[1] + q[2])][k % 4]
    rows = [(q[3], *map(float, corner(q, k) + corner(q, k + 1) + corner(q, k - 1))) for q in squares for k in range(4)]
    nodes = [(q[3], 4 * n + k, True, *map(float, corner(q, k) + corner(q, k + 1) + corner(q, k - 1))) for n, q in enumerate(squares) for k in range(4)]
    walls = spark.createDataFrame(rows, "area int, x1 double, y1 double, x2 double, y2 double, right_x double, right_y double")
    return walls, spark.createDataFrame(nodes, "area int, node_id long, is_obstacle boolean, x double, y double, left_x double, left_y double, right_x double, right_y double")


def _sees(p, points, squares):
    """Whether the way from a point to each of the points stays out of every open square."""
    a, d = np.array(p, float), np.array(points, float) - np.array(p, float)
    blocked = np.zeros(len(points), dtype=bool)
    for low in range(0, len(squares), 500):
        q = np.array([s[:3] for s in squares[low : low + 500]], float)
        enter, leave = np.zeros((len(points), len(q))), np.ones((len(points), len(q)))
        with np.errstate(divide="ignore", invalid="ignore"):
            for k in range(2):
                lo, hi = q[:, k] - a[k], q[:, k] + q[:, 2] - a[k]
                t, u = lo / d[:, k, None], hi / d[:, k, None]
                still, between = d[:, k, None] == 0, (lo < 0) & (hi > 0)
                enter = np.maximum(enter, np.where(still, np.where(between, 0, 2), np.minimum(t, u)))
                leave = np.minimum(leave, np.where(still, 1, np.maximum(t, u)))
        blocked |= (enter < leave - 1e-12).any(axis=1)
    return ~blocked


def test_random_towns_against_every_pair(spark):
    """Pairs that see each other are all among the open ones; squares on one line and narrow lanes are among the towns."""
    rng = np.random.default_rng(3)
    squares = []
    for area in range(6):
        grid = [(80 * i, 80 * j) for i in range(7) for j in range(7)]
        for x, y in grid:
            jitter = rng.integers(0, 25, 2) if area % 2 else (0, 0)
            squares.append((x + int(jitter[0]) - 200, y + int(jitter[1]) - 300, int(rng.choice([79, 40] if area == 4 else [20, 40, 55])), area))
    squares = [s for s in squares if rng.random() < 0.8]
    walls, nodes = _walls(spark, squares)
    got = {(r.src, r.dst) for r in spatial.visible_pairs(nodes, walls).collect()}
    some = {(r.src, r.dst) for r in spatial.visible_pairs(nodes, walls, 130.0).collect()}
    at = [(r.area, r.node_id, (r.x, r.y)) for r in nodes.collect()]
    want = set()
    for area in range(6):
        own = [s for s in squares if s[3] == area]
        here = [x for x in at if x[0] == area]
        inside = lambda p: any(q[0] < p[0] < q[0] + q[2] and q[1] < p[1] < q[1] + q[2] for q in own)  # noqa: E731, B023
        for _, n, p in here:
            for (_, m, o), sees in zip(here, _sees(p, [x[2] for x in here], own), strict=True):
                if n < m and (sees or p == o):
                    assert not inside(p)
                    want.add((n, m))
    assert got == want
    place = {n: p for _, n, p in at}
    assert some == {(n, m) for n, m in want if np.hypot(*np.subtract(place[n], place[m])) <= 130}


def test_twenty_thousand_nodes_in_one_area(spark):
    """Candidate pairs follow what can be seen: here far less than a hundredth of the two hundred million pairs."""
    rng = np.random.default_rng(8)
    squares = [(100 * i + int(rng.integers(0, 35)), 100 * j + int(rng.integers(0, 35)), int(rng.integers(45, 66)), 0) for i in range(71) for j in range(71)][:5000]
    walls, nodes = _walls(spark, squares)
    walls, nodes = cut(walls, "walls"), cut(nodes, "nodes")
    pairs = cut(sight.open_pairs(nodes, nodes, walls).where("a_node_id < b_node_id").select("a_node_id", "b_node_id"), "pairs")
    assert pairs.count() < 20_000 * 100
    places = [(float(r.x), float(r.y)) for r in nodes.orderBy("node_id").collect()]
    for n in rng.integers(0, 20_000, 4).tolist():
        sees = set(np.flatnonzero(_sees(places[n], places, squares)).tolist()) - {n}
        found = {r.a_node_id + r.b_node_id - n for r in pairs.where(f"a_node_id = {n} or b_node_id = {n}").collect()}
        assert sees <= found


def test_ways_behind_a_near_wall_are_not_made(spark, monkeypatch):
    """Candidates are tested against the walls of their own ring, too; tiles of many nodes are dealt to parts without loss."""
    walls, _ = _walls(spark, [(10, -10, 20, 0)])
    points = {1: (0.0, 0.0), 2: (40.0, 0.0), 3: (40.0, 80.0)}
    nodes = spark.createDataFrame([(0, n, x, y) for n, (x, y) in points.items()], "area int, node_id long, x double, y double")
    for most in (sight.MOST, 1):
        monkeypatch.setattr(sight, "MOST", most)
        assert {(r.a_node_id, r.b_node_id) for r in sight.open_pairs(nodes, nodes, walls).where("a_node_id < b_node_id").collect()} == {(1, 3), (2, 3)}
