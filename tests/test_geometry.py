"""Known cases of angles, corners and lines, and whole queries against SQL."""

import math

import pytest

from pyspark.sql import functions as F
from skyroute.functions import geometry as G
from skyroute.functions import projections

SEGMENT, RAY, LINE = (0.0, 1.0), (0.0, math.inf), (-math.inf, math.inf)


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first()


def test_angles(spark):
    lit = F.lit
    got = one(
        spark, G.angle_to(0.0, 0.0, 5.0, 5.0), G.angle_to(0.0, 0.0, -5.0, -5.0), G.angle_is_between(lit(math.pi / 2), lit(0.0), lit(math.pi)),
        G.angle_is_between(lit(math.pi / 2), lit(1.5 * math.pi), lit(math.pi)), G.orientation(0.0, 0.0, 5.0, 0.0, 5.0, -5.0), G.orientation(0.0, 0.0, 5.0, 0.0, 5.0, 5.0),
        G.orientation(0.0, 0.0, 5.0, 0.0, 9.0, 0.0),
    )
    assert got[0] == pytest.approx(math.pi / 4) and got[1] == pytest.approx(1.25 * math.pi)
    assert list(got)[2:] == [True, True, -1.0, 1.0, 0.0]


def test_direction_orders_like_the_angle(spark):
    points = [(math.cos(k) * r, math.sin(k) * r) for k in range(40) for r in (1.0, 3.0)] + [(1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0)]
    rows = spark.createDataFrame(points, "x double, y double").select(G.angle_to(0.0, 0.0, "x", "y").alias("a"), G.direction(0.0, 0.0, "x", "y").alias("d")).collect()
    rows = sorted((r.a, r.d) for r in rows)
    assert all(d1 <= d2 + 1e-12 for (_, d1), (_, d2) in zip(rows[:-1], rows[1:], strict=True)) and all(0 <= d < 4 for _, d in rows)


@pytest.mark.parametrize(("p", "concave"), [((2.0, 2.0), True), ((5.0, 5.0), False), ((2.5, 2.5), False)])
def test_corners(spark, p, concave):
    assert one(spark, G.is_locally_concave(p[0], p[1], 0.0, 5.0, 5.0, 0.0))[0] is concave


def test_ways_into_corners(spark):
    """The corner test by cross products agrees with that by directions."""
    grid = [(float(x), float(y)) for x in (-2, -1, 0, 1, 2) for y in (-2, -1, 0, 1, 2) if (x, y) != (0, 0)]
    rows = [(*a, *b, *t) for a in grid for b in grid for t in grid]
    df = spark.createDataFrame(rows, "lx double, ly double, rx double, ry double, tx double, ty double")
    d = {k: G.direction(F.lit(0.0), F.lit(0.0), f"{k}x", f"{k}y") for k in "lrt"}
    df = df.select("*", *(c.alias(f"d{k}") for k, c in d.items())).withColumn("by_angle", ~G.angle_is_between("dt", "dr", "dl"))
    df = df.withColumn("by_cross", G.enters_polygon("tx", "ty", F.lit(0.0), F.lit(0.0), "lx", "ly", "rx", "ry"))
    assert df.where("by_angle <> by_cross").count() == 0


LINES = [
    ((1, 0, 1, 1), SEGMENT, (0, 0, 2, 0.5), SEGMENT, ("intersecting", 1.0, 0.25)),
    ((0, 0, 1, 1), RAY, (2, 0, 2, 3), SEGMENT, ("intersecting", 2.0, 2.0)),
    ((0, 0, 1, 1), SEGMENT, (3, 0, 0, 3), SEGMENT, ("disjoint", None, None)),
    ((1, 1, 0, 0), RAY, (3, 0, 0, 3), LINE, ("disjoint", None, None)),
    ((0, 0, 1, 1), LINE, (0, 1, 1, 2), LINE, ("parallel", None, None)),
    ((0, 0, 0, 1.5), LINE, (0, 4, 0, 5), RAY, ("collinear", None, None)),
]


@pytest.mark.parametrize(("a", "a_range", "b", "b_range", "expected"), LINES)
def test_lines_in_both_orders(spark, a, a_range, b, b_range, expected):
    a, b = (*map(float, a), *a_range), (*map(float, b), *b_range)
    got = one(spark, G.line_relation(a, b), G.line_relation(b, a))
    assert tuple(got[0]) == expected and tuple(got[1]) == expected


def test_proper_ray_hits(spark):
    ray = (0.0, 0.0, 1.0, 0.0)
    got = one(
        spark, G.proper_ray_hit(ray, (2.0, -1.0, 2.0, 1.0)), G.proper_ray_hit(ray, (2.0, 0.0, 2.0, 1.0)), G.proper_ray_hit(ray, (-1.0, 0.0, 1.0, 0.0)),
        G.proper_ray_hit(ray, (1.0, 0.0, 2.0, 0.0)), G.proper_ray_hit(ray, (-2.0, -1.0, -2.0, 1.0)),
    )
    assert [x and tuple(x) for x in got] == [(2.0, 0.0), None, (0.0, 0.0), None, None]


def test_published_point(spark):
    """EPSG 3035 at 50 N, 5 E."""
    got = one(spark, *projections.to_internal(F.lit(5.0), F.lit(50.0)))
    assert got[0] == pytest.approx(3962799.45, abs=0.01) and got[1] == pytest.approx(2999718.85, abs=0.01)


def test_belgian_grid_near_its_origin(spark):
    """The middle of Brussels, to some hundred metres."""
    df = projections.grb_to_internal(spark.createDataFrame([(149_000.0, 170_500.0)], "gx double, gy double"), "gx", "gy")
    lng, lat = projections.to_external(F.col("x"), F.col("y"))
    got = df.select(lng.alias("lng"), lat.alias("lat")).first()
    assert got.lng == pytest.approx(4.3525, abs=0.01) and got.lat == pytest.approx(50.845, abs=0.01)


def test_affine(spark):
    a = (100.0, 2.0, 0.0, 50.0, 0.0, -2.0)
    got = one(spark, *G.pixel_to_geo(3, 4, *a), *G.geo_to_pixel(106.9, 43.1, *a))
    assert tuple(got) == (106.0, 42.0, 3, 3)
    with pytest.raises(Exception, match="rotated"):
        one(spark, *G.pixel_to_geo(3, 4, 100.0, 2.0, 0.5, 50.0, 0.0, -2.0))


def _ells():
    """The same notched building in its four mirrored positions, wound counter-clockwise."""
    ring = [(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)]
    out = []
    for mx, my in ((1, 1), (-1, 1), (1, -1), (-1, -1)):
        moved = [(x if mx > 0 else 4 - x, y if my > 0 else 4 - y) for x, y in ring]
        out.append(moved if mx * my > 0 else moved[::-1])
    return out


def _inside(ring, x, y):
    """Strictly inside, by quarter squares: the building is made of four squares of side 2, one of them missing."""
    corner = next((cx, cy) for cx in (0, 4) for cy in (0, 4) if (cx, cy) not in ring)
    in_notch = abs(x - corner[0]) <= 2 and abs(y - corner[1]) <= 2
    return 0 < x < 4 and 0 < y < 4 and not in_notch


def test_boundaries_of_mirrored_buildings(spark):
    from skyroute.operators.graph import graph_nodes
    from skyroute.operators.spatial import points_in_polygons

    close = lambda r: [{"x": float(x), "y": float(y)} for x, y in [*r, r[0]]]
    rings = _ells()
    polygons = spark.createDataFrame([(k, 10**9 + k, [close(r)]) for k, r in enumerate(rings)], "area int, polygon_id long, rings array<array<struct<x:double,y:double>>>")
    grid = [(k, 1000 * k + 10 * i + j, i / 2, j / 2) for k in range(4) for i in range(-1, 10) for j in range(-1, 10)]
    points = spark.createDataFrame(grid, "area int, point_id long, x double, y double")
    for band in (100.0, 1.5):
        got = {r.point_id for r in points_in_polygons(points, polygons, band=band).collect()}
        assert got == {n for k, n, x, y in grid if _inside(rings[k], x, y)}
    assert graph_nodes(polygons, None).count() == 24

    # two buildings that share a wall, and one that stands inside another: only the latter's corners are no nodes
    square = lambda x, y, s: close([(x, y), (x + s, y), (x + s, y + s), (x, y + s)])
    walls = spark.createDataFrame([(0, 1, [square(0, 0, 4)]), (0, 2, [square(4, 0, 4)]), (0, 3, [square(5, 1, 2)])], polygons.schema)
    assert graph_nodes(walls, None).count() == 8


def test_nodes_of_large_rings_have_ids_of_their_own(spark):
    from skyroute.operators.graph import graph_nodes

    ring = [(float(math.cos(k / 1200 * 2 * math.pi)), float(math.sin(k / 1200 * 2 * math.pi))) for k in range(1200)]
    hole = [(0.1, 0.1), (0.1, 0.2), (0.2, 0.2), (0.2, 0.1)]
    close = lambda r: [{"x": x, "y": y} for x, y in [*r, r[0]]]
    schema = "area int, polygon_id long, rings array<array<struct<x:double,y:double>>>"
    big = spark.createDataFrame([(0, 10**9, [close(ring), close(hole)]), (0, 10**9 + 1, [close([(x + 5, y) for x, y in ring])])], schema)
    nodes = graph_nodes(big, big.selectExpr("area + 1 as area", "polygon_id", "rings"))
    assert nodes.count() == nodes.select("node_id").distinct().count() == 2 * 2404


def test_orientation_without_rounding(spark):
    import random
    from fractions import Fraction

    from skyroute.functions import geometry as G

    rnd = random.Random(11)
    rows = []
    for k in range(3000):
        ax, ay, dx, dy = (rnd.choice((rnd.uniform(-1, 1), rnd.uniform(-1e9, 1e9), rnd.uniform(-1e-6, 1e-6))) for _ in range(4))
        t, u = rnd.uniform(-3, 3), rnd.uniform(-3, 3)
        if k % 10 == 0:
            t = u
        rows.append((ax, ay, ax + t * dx, ay + t * dy, ax + u * dx, ay + u * dy))
    rows += [(1.0, 1.0, 1.0, 1.0, 5.0, 7.0), (0.0, 0.0, 0.1, 0.1, 0.3, 0.3), (0.1, 0.1, 0.2, 0.2, 0.3, 0.3)]
    df = spark.createDataFrame(rows, "ax double, ay double, bx double, by double, cx double, cy double")
    args = ("ax", "ay", "bx", "by", "cx", "cy")
    wrong = 0
    for r in df.select("*", G.orientation_exact(*args).alias("exact"), G.orientation(*args).alias("plain")).collect():
        ax, ay, bx, by, cx, cy = map(Fraction, r[:6])
        det = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
        sign = (det > 0) - (det < 0)
        assert r.exact == sign
        wrong += r.plain != sign
    assert wrong > 100
    assert spark.createDataFrame([(None, 1.0, 1.0, 1.0, 1.0, 1.0)], df.schema).select(G.orientation_exact(*args)).first()[0] is None


def test_polygons_of_all_sizes_contain_points(spark):
    import random

    from skyroute.operators.spatial import points_in_polygons

    rnd = random.Random(4)
    square = lambda x, y, s: [{"x": a, "y": b} for a, b in ((x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y))]
    boxes = [(k % 2, k, rnd.uniform(-900, 900), rnd.uniform(-900, 900), 2.0 ** rnd.uniform(-6, 12)) for k in range(150)]
    polygons = spark.createDataFrame([(a, k, [square(x, y, s)]) for a, k, x, y, s in boxes], "area int, polygon_id long, rings array<array<struct<x:double,y:double>>>")
    points = [(k % 2, k, rnd.uniform(-1000, 3000), rnd.uniform(-1000, 3000)) for k in range(300)] + [(a, 1000 + k, x + s / 2, y + s / 3) for a, k, x, y, s in boxes]
    found = {tuple(r) for r in points_in_polygons(spark.createDataFrame(points, "area int, point_id long, x double, y double"), polygons).collect()}
    assert found == {(p, k) for area, p, px, py in points for a, k, x, y, s in boxes if a == area and x < px < x + s and y < py < y + s}
