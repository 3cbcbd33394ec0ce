"""Stretches of paths inside zones of any shape."""

from skyroute.operators.airspace import zone_passages

ZONE = "zone_id int, lower int, upper int, category string, polygons array<array<array<array<double>>>>"


def square(a, b):
    return [[float(x), float(y)] for x, y in ((a, a), (b, a), (b, b), (a, b), (a, a))]


def found(spark, points, zones, altitude=50.0):
    paths = spark.createDataFrame([(p, k, float(x), float(y)) for p, line in points.items() for k, (x, y) in enumerate(line)], "path_id int, seq int, x double, y double")
    conditions = spark.createDataFrame([("Red", "ask"), ("red", "avoid")], "category string, condition string")
    rows = zone_passages(paths, spark.createDataFrame(zones, ZONE), conditions, altitude).collect()
    return sorted((r.path_id, r.zone_id, round(r.enters, 6), round(r.leaves, 6), tuple(r.conditions)) for r in rows)


def test_hole_corners_borders_and_limits(spark):
    zone = (1, 0, 100, "RED", [[square(0, 400), square(100, 300)[::-1]]])
    paths = {
        1: [(-50, 200), (450, 200)],  # through the hole
        2: [(50, 10), (50, 20), (50, 30), (50, 30), (60, 30)],  # inside throughout, with a point twice
        3: [(-10, 0), (410, 0)],  # along the border
        4: [(-100, 100), (100, -100)],  # touches a corner
        5: [(100, 50), (100, 350)],  # along the hole's border
        6: [(-10, 50), (0, 50), (10, 50)],  # a point on the border
        7: [(20, 20)],
    }
    both = ("ask", "avoid")
    assert found(spark, paths, [zone]) == [
        (1, 1, 50.0, 150.0, both), (1, 1, 350.0, 450.0, both), (2, 1, 0.0, 30.0, both), (5, 1, 0.0, 50.0, both), (5, 1, 250.0, 300.0, both), (6, 1, 10.0, 20.0, both),
    ]
    assert found(spark, paths, [zone], 101.0) == []


def test_parts_that_share_a_border_and_overlapping_zones(spark):
    zones = [(1, 0, 9, "blue", [[square(0, 100)], [[[100.0, 0.0], [200.0, 0.0], [150.0, 100.0], [100.0, 0.0]]]]), (2, 0, 9, None, [[square(-50, 50)]])]
    out = found(spark, {1: [(-100, 20), (300, 20)]}, zones, 5.0)
    assert out == [(1, 1, 100.0, 200.0, ()), (1, 1, 210.0, 290.0, ()), (1, 2, 50.0, 150.0, ())]


def test_nothing(spark):
    assert found(spark, {}, [(1, 0, 9, "red", [[square(0, 100)]])]) == [] == found(spark, {1: [(0, 0), (5, 5)]}, [])
