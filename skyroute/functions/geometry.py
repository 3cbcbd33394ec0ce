"""Angles, orientation and line relations as columns.

Coordinates are DOUBLE columns.  ``left`` is the next vertex of a ring and ``right`` the previous one, in a
counter-clockwise outer ring.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def distance(x1, y1, x2, y2) -> Column:
    dx, dy = col(x2) - col(x1), col(y2) - col(y1)
    return F.sqrt(dx * dx + dy * dy)


def angle_to(x, y, tx, ty) -> Column:
    """Direction in [0, 2 pi)."""
    a = F.atan2(col(ty) - col(y), col(tx) - col(x))
    return F.when(a < 0, a + 2 * math.pi).otherwise(a)


def pseudoangle_to(x, y, tx, ty) -> Column:
    """Grows with the direction, without trigonometry: [0, 2] above the x axis and [-2, 0] below it; NaN for the point itself."""
    dx, dy = col(tx) - col(x), col(ty) - col(y)
    size = F.abs(dx) + F.abs(dy)
    value = F.when(size > 0, 1 - dx / F.nullif(size, F.lit(0.0))).otherwise(F.lit(float("nan")))
    return F.when(dy >= 0, F.abs(value)).otherwise(-F.abs(value))


def direction(x, y, tx, ty) -> Column:
    """Pseudo-angle moved to [0, 4): the same order as ``angle_to``, and exact for multiples of one vector."""
    p = pseudoangle_to(x, y, tx, ty)
    return F.when(p < 0, p + 4).otherwise(p)


def angle_is_between(angle, low, high) -> Column:
    """Whether a direction lies in the counter-clockwise range from low to high, ends included."""
    a, lo, hi = col(angle), col(low), col(high)
    return F.when(lo < hi, (lo <= a) & (a <= hi)).otherwise((lo <= a) | (a <= hi))


def orientation(ax, ay, bx, by, cx, cy) -> Column:
    """1 where a, b, c turn counter-clockwise, -1 clockwise, 0 on one line; in plain doubles, ``orientation_exact`` is without rounding."""
    return F.signum((col(bx) - col(ax)) * (col(cy) - col(ay)) - (col(by) - col(ay)) * (col(cx) - col(ax)))


#: Relative error of the plain cross product: beyond it the sign is right.
_DOUBT = (3 + 16 * 2.0**-53) * 2.0**-53


def orientation_exact(ax, ay, bx, by, cx, cy) -> Column:
    """``orientation`` without rounding: where the plain cross product may have the wrong sign, the exact sum of the products' halves decides.

    Right for all finite coordinates whose products neither overflow nor underflow (about 1e-140 to 1e140).  Only rows in doubt pay for
    the exact sum.
    """
    ax, ay, bx, by, cx, cy = map(col, (ax, ay, bx, by, cx, cy))
    left, right = (bx - ax) * (cy - ay), (by - ay) * (cx - ax)
    det = left - right
    products = [(bx, cy), (-by, cx), (ax, by), (-ay, bx), (cx, ay), (-cy, ax)]
    terms = F.flatten(F.array(*(_halves(a, b) for a, b in products)))
    total = F.aggregate(terms, F.array().cast("array<double>"), _grown)
    # no part overlaps another, so that the sign is that of the largest
    exact = F.signum(F.coalesce(F.try_element_at(F.filter(total, lambda v: v != 0), F.lit(-1)), F.lit(0.0)))
    return F.when(F.abs(det) > _DOUBT * (F.abs(left) + F.abs(right)), F.signum(det)).when(det.isNotNull(), exact)


def _halves(a: Column, b: Column) -> Column:
    """A product as two doubles whose sum it is."""

    def split(v):
        big = v * (2.0**27 + 1)
        high = big - (big - v)
        return high, v - high

    (ah, al), (bh, bl), p = split(a), split(b), a * b
    return F.array(al * bl - (((p - ah * bh) - al * bh) - ah * bl), p)


def _grown(parts: Column, value: Column) -> Column:
    """Parts from small to large that don't overlap, and one more double, as such parts."""

    def step(state, part):
        s = state["sum"] + part
        back = s - state["sum"]
        rest = (state["sum"] - (s - back)) + (part - back)
        return F.struct(s.alias("sum"), F.concat(state["rests"], F.array(rest)).alias("rests"))

    start = F.struct(value.alias("sum"), F.array().cast("array<double>").alias("rests"))
    return F.aggregate(parts, start, step, lambda state: F.concat(state["rests"], F.array(state["sum"])))


def is_locally_concave(x="x", y="y", left_x="left_x", left_y="left_y", right_x="right_x", right_y="right_y") -> Column:
    return angle_to(x, y, right_x, right_y) - angle_to(x, y, left_x, left_y) > math.pi


def enters_polygon(tx, ty, x="x", y="y", left_x="left_x", left_y="left_y", right_x="right_x", right_y="right_y") -> Column:
    """Whether the way from a vertex to a target starts strictly inside the polygon's corner.

    The same as the target's direction not lying between those of the right and the left neighbour, by cross products only.
    """
    lx, ly, rx, ry, dx, dy = (col(p) - col(o) for p, o in ((left_x, x), (left_y, y), (right_x, x), (right_y, y), (tx, x), (ty, y)))
    return _enters(dx, dy, lx, ly, rx, ry)


def is_tangent(tx, ty, x="x", y="y", left_x="left_x", left_y="left_y", right_x="right_x", right_y="right_y") -> Column:
    """Whether the line through a vertex and a target enters the polygon's corner on neither side of the vertex.

    A shortest way bends, and passes, only at such corners; no line is tangent at a concave one.
    """
    lx, ly, rx, ry, dx, dy = (col(p) - col(o) for p, o in ((left_x, x), (left_y, y), (right_x, x), (right_y, y), (tx, x), (ty, y)))
    return ~_enters(dx, dy, lx, ly, rx, ry) & ~_enters(-dx, -dy, lx, ly, rx, ry)


def _enters(dx, dy, lx, ly, rx, ry) -> Column:
    corner, from_left, to_right = _cross(lx, ly, rx, ry), _cross(lx, ly, dx, dy), _cross(dx, dy, rx, ry)
    straight = (lx * rx + ly * ry < 0) & (from_left > 0)
    along_right = (to_right == 0) & (dx * rx + dy * ry >= 0)
    along_left = (from_left == 0) & (dx * lx + dy * ly >= 0)
    wide = ~(((from_left <= 0) & (to_right <= 0)) | along_left | along_right)
    return F.when(corner > 0, (from_left > 0) & (to_right > 0)).when(corner < 0, wide).otherwise(straight)


def _cross(ax, ay, bx, by) -> Column:
    return ax * by - ay * bx


def line_relation(a: tuple, b: tuple) -> Column:
    """How two lines relate; each is (x1, y1, x2, y2, low, high), where the line parameter is limited to [low, high].

    A segment is limited to [0, 1], a ray to [0, inf] and a line to [-inf, inf].  Returns a struct of ``relation`` (intersecting,
    disjoint, collinear or parallel) and the point, null but for intersecting.
    """
    ax, ay, ax2, ay2, a_low, a_high = map(col, a)
    bx, by, bx2, by2, b_low, b_high = map(col, b)
    rx, ry, sx, sy, qx, qy = ax2 - ax, ay2 - ay, bx2 - bx, by2 - by, bx - ax, by - ay
    d = _cross(rx, ry, sx, sy)
    safe = F.nullif(d, F.lit(0.0))
    t, u = _cross(qx, qy, sx / safe, sy / safe), _cross(qx, qy, rx / safe, ry / safe)
    hit = t.between(a_low, a_high) & u.between(b_low, b_high)
    name = (
        F.when(d == 0, F.when(_cross(qx, qy, rx, ry) == 0, F.lit("collinear")).otherwise(F.lit("parallel")))
        .when(hit, F.lit("intersecting"))
        .otherwise(F.lit("disjoint"))
    )
    on = (d != 0) & hit
    return F.struct(name.alias("relation"), F.when(on, ax + t * rx).alias("x"), F.when(on, ay + t * ry).alias("y"))


def proper_ray_hit(ray: tuple, segment: tuple) -> Column:
    """Point where a ray (x1, y1, x2, y2) meets a segment other than at its ends; null without one.

    On one line it is the ray's start, if that lies strictly inside the segment.
    """
    x, y, rx, ry = map(col, ray)
    sx, sy, tx, ty = map(col, segment)
    hit = line_relation((x, y, rx, ry, 0.0, INFINITY), (sx, sy, tx, ty, 0.0, 1.0))
    along = ((x - sx) * (tx - sx) + (y - sy) * (ty - sy)) / F.nullif((tx - sx) * (tx - sx) + (ty - sy) * (ty - sy), F.lit(0.0))
    inside = (hit["relation"] == "collinear") & (along > 0) & (along < 1)
    px, py = F.when(inside, x).otherwise(hit["x"]), F.when(inside, y).otherwise(hit["y"])
    at_end = ((px == sx) & (py == sy)) | ((px == tx) & (py == ty))
    return F.when(px.isNotNull() & ~at_end, F.struct(px.alias("x"), py.alias("y")))


def properly_cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Whether the insides of segments ab and cd cross in a point."""
    return (orientation(ax, ay, bx, by, cx, cy) * orientation(ax, ay, bx, by, dx, dy) < 0) & (
        orientation(cx, cy, dx, dy, ax, ay) * orientation(cx, cy, dx, dy, bx, by) < 0
    )


def passes_through(ax, ay, bx, by, x="x", y="y", left_x="left_x", left_y="left_y", right_x="right_x", right_y="right_y") -> Column:
    """Whether segment ab has a vertex strictly inside it and enters the polygon's corner there, on either side."""
    x_, y_ = col(x), col(y)
    ahead = (x_ - col(ax)) * (col(bx) - col(ax)) + (y_ - col(ay)) * (col(by) - col(ay)) > 0
    behind = (x_ - col(bx)) * (col(ax) - col(bx)) + (y_ - col(by)) * (col(ay) - col(by)) > 0
    return (orientation(ax, ay, bx, by, x, y) == 0) & ahead & behind & ~is_tangent(bx, by, x, y, left_x, left_y, right_x, right_y)


def signed_area(ring) -> Column:
    """Shoelace area of a closed ring of (x, y); positive counter-clockwise."""
    ring = col(ring)
    pairs = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v) / 2


def normalised_rings(rings) -> Column:
    """Rings with the outer one counter-clockwise and the others clockwise."""
    return F.transform(col(rings), lambda ring, k: F.when((signed_area(ring) > 0) == (k == 0), ring).otherwise(F.reverse(ring)))


def pixel_to_geo(px, py, a, b, c, d, e, f) -> tuple[Column, Column]:
    """Affine transform of a pixel: (a + b px + c py, d + e px + f py); the rotation terms c and e must be 0."""
    ok = F.assert_true((col(c) == 0) & (col(e) == 0), F.lit("rotated rasters are not supported")).isNull()
    return F.when(ok, col(a) + col(b) * col(px)), F.when(ok, col(d) + col(f) * col(py))


def geo_to_pixel(x, y, a, b, c, d, e, f) -> tuple[Column, Column]:
    """Inverse of ``pixel_to_geo``, cut towards zero."""
    ok = F.assert_true((col(c) == 0) & (col(e) == 0), F.lit("rotated rasters are not supported")).isNull()
    return F.when(ok, ((col(x) - col(a)) / col(b)).cast("int")), F.when(ok, ((col(y) - col(d)) / col(f)).cast("int"))


def crossed_cells(x1, y1, x2, y2, size: float) -> Column:
    """Grid cells (cx, cy) that a segment's column-wise extent meets: every cell it passes, and few others."""
    x1, y1, x2, y2 = map(col, (x1, y1, x2, y2))
    flip = x1 > x2
    ax, ay = F.when(flip, x2).otherwise(x1), F.when(flip, y2).otherwise(y1)
    bx, by = F.when(flip, x1).otherwise(x2), F.when(flip, y1).otherwise(y2)
    slope = F.when(bx > ax, (by - ay) / F.nullif(bx - ax, F.lit(0.0)))
    columns = F.sequence(F.floor(ax / size), F.floor(bx / size))

    def column(cx):
        low, high = F.greatest(ax, cx * size), F.least(bx, (cx + 1) * size)
        ya, yb = F.when(bx > ax, ay + slope * (low - ax)).otherwise(ay), F.when(bx > ax, ay + slope * (high - ax)).otherwise(by)
        rows = F.sequence(F.floor(F.least(ya, yb) / size - 1e-9), F.floor(F.greatest(ya, yb) / size + 1e-9))
        return F.transform(rows, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))

    return F.flatten(F.transform(columns, column))


def box_cells(x1, y1, x2, y2, size: float) -> Column:
    """Grid cells that a box meets."""
    rows = F.sequence(F.floor(col(y1) / size), F.floor(col(y2) / size))
    return F.flatten(
        F.transform(F.sequence(F.floor(col(x1) / size), F.floor(col(x2) / size)), lambda cx: F.transform(rows, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy"))))
    )
