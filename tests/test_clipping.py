"""Rings of a batch clipped together."""

import math
import random

import numpy as np
import pyarrow as pa

from skyroute.functions import ring_arrays
from skyroute.operators.shapes import clip_to_tiles


def star(rnd, cx, cy, n):
    ring = [(cx + (r := rnd.uniform(3, 40)) * math.cos(a), cy + r * math.sin(a)) for a in (2 * math.pi * k / n for k in range(n))]
    return [*ring, ring[0]]


def size(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring[:-1], ring[1:], strict=True)) / 2


def test_flat_and_nested_are_inverse():
    rows = pa.array([[[{"x": 1.0, "y": 2.0}, {"x": 3.0, "y": 4.0}], []], None, [], [[{"x": 5.0, "y": 6.0}]]], ring_arrays.RINGS)
    for part in (rows, rows.slice(1), rows.slice(2, 1), rows.slice(4)):
        assert ring_arrays.nested(*ring_arrays.flat(part), null=np.array([not r for r in part.is_valid().to_pylist()], dtype=bool)).to_pylist() == part.to_pylist()


def test_parts_add_up(spark):
    rnd = random.Random(3)
    rings = {k: star(rnd, rnd.uniform(-50, 50), rnd.uniform(-50, 50), rnd.randint(3, 14)) for k in range(60)}
    rows = [(k % 3, k, [[{"x": x, "y": y} for x, y in r]]) for k, r in rings.items()]
    df = spark.createDataFrame(rows, "area int, polygon_id long, rings array<array<struct<x:double,y:double>>>")
    parts = clip_to_tiles(df, 10.0).collect()
    total = dict.fromkeys(rings, 0.0)
    for r in parts:
        total[r.polygon_id] += r.clipped_area
        (ring,) = r.rings
        assert ring[0] == ring[-1] and all(r.tx * 10 <= p.x <= r.tx * 10 + 10 and r.ty * 10 <= p.y <= r.ty * 10 + 10 for p in ring)
        assert math.isclose(abs(size([tuple(p) for p in ring])), r.clipped_area, abs_tol=1e-9)
    assert all(math.isclose(total[k], size(r), rel_tol=1e-9) for k, r in rings.items())
    assert clip_to_tiles(df.limit(0), 10.0).count() == 0


def test_holes_leave_nothing(spark):
    square = lambda a, b: [{"x": float(x), "y": float(y)} for x, y in ((a, a), (b, a), (b, b), (a, b), (a, a))]
    df = spark.createDataFrame([(0, 1, [square(0, 40), square(10, 30)[::-1]])], "area int, polygon_id long, rings array<array<struct<x:double,y:double>>>")
    out = {(r.tx, r.ty): r.clipped_area for r in clip_to_tiles(df, 10.0).collect()}
    assert len(out) == 12 and set(out.values()) == {100.0} and (1, 1) not in out
