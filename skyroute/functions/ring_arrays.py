"""Rings of a whole Arrow batch as flat numpy arrays, and back: nothing is done for each point in Python."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
RINGS = pa.list_(pa.list_(POINT))


def flat(rings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, points of each ring, rings of each row) of a column of rings; a null row or ring has none."""
    counts = rings.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    inner = rings.flatten()
    sizes = inner.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    x, y = (c.to_numpy(zero_copy_only=False) for c in inner.flatten().flatten())
    return x, y, sizes, counts


def nested(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, counts: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """The inverse of ``flat``; rows marked in ``null`` are null and must have no rings."""
    ends = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
    points = pa.StructArray.from_arrays([pa.array(x, pa.float64()), pa.array(y, pa.float64())], fields=list(POINT))
    inner = pa.ListArray.from_arrays(ends(sizes), points)
    return pa.ListArray.from_arrays(ends(counts), inner, mask=None if null is None else pa.array(null, pa.bool_()))


def _previous(sizes: np.ndarray) -> np.ndarray:
    """For each point the place of the one before it in its ring, which is closed without repeating a point."""
    ends = np.cumsum(sizes)
    before = np.arange(sizes.sum()) - 1
    some = sizes > 0
    before[(ends - sizes)[some]] = ends[some] - 1
    return before


def clipped(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, sizes) of closed rings, each clipped to its own box (x1, y1, x2, y2), side after side; a ring of which nothing is left has size 0."""
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, dtype=np.int64)
    opened = np.ones(len(x), dtype=bool)
    opened[(first + sizes - 1)[sizes > 0]] = False
    xy, sizes = np.column_stack([x[opened], y[opened]]), np.maximum(sizes - 1, 0)
    for axis, side, sign in ((0, 0, 1.0), (0, 2, -1.0), (1, 1, 1.0), (1, 3, -1.0)):
        ring = np.repeat(np.arange(len(sizes)), sizes)
        limit, before = boxes[ring, side], _previous(sizes)
        here, there = xy[:, axis], xy[before, axis]
        inside = sign * (here - limit) >= 0
        crosses = inside != inside[before]
        share = np.divide(limit - there, here - there, out=np.zeros(len(here)), where=crosses)
        cut = xy[before] + share[:, None] * (xy - xy[before])
        cut[:, axis] = limit
        kept = np.column_stack([crosses, inside]).ravel()  # the point on the side comes before the one behind it
        xy, ring = np.stack([cut, xy], axis=1).reshape(-1, 2)[kept], np.repeat(ring, 2)[kept]
        sizes = np.bincount(ring, minlength=len(sizes))
        whole = (sizes >= 3)[ring]
        xy, sizes = xy[whole], np.where(sizes >= 3, sizes, 0)
    ring, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
    some = sizes > 0
    starts = (ends - sizes)[some]
    xy = np.insert(xy, ends[some], xy[starts], axis=0) if len(starts) else xy
    return xy[:, 0], xy[:, 1], np.where(some, sizes + 1, 0)


def areas(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Signed shoelace area of each closed ring, taken from the ring's first point."""
    ring = np.repeat(np.arange(len(sizes)), sizes)
    start = (np.cumsum(sizes) - sizes)[ring]
    dx, dy = x - x[start], y - y[start]
    before = _previous(sizes)
    return np.bincount(ring, weights=dx[before] * dy - dx * dy[before], minlength=len(sizes)) / 2
