"""Areas shared by convex polygons, for Arrow UDFs and grouped folds: clipping by half-planes in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F


def area(p: np.ndarray) -> float:
    """Signed area of the corners (n, 2)."""
    if len(p) < 3:
        return 0.0
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def is_convex(p: np.ndarray) -> bool:
    """Whether all corners turn one way, once around."""
    edge = np.roll(p, -1, axis=0) - p
    after = np.roll(edge, -1, axis=0)
    turn = edge[:, 0] * after[:, 1] - edge[:, 1] * after[:, 0]
    around = np.arctan2(turn, (edge * after).sum(axis=1)).sum()
    return bool(((turn >= 0).all() or (turn <= 0).all()) and abs(around) < 6.5)


def intersection(a: np.ndarray, b: np.ndarray) -> float:
    """Area that two simple polygons share; corners in either direction.

    A polygon is the signed sum of the triangles from its first corner, so two share the signed sum of what their triangles share.
    """
    if len(a) < 3 or len(b) < 3:
        return 0.0
    if is_convex(a) and is_convex(b):
        return _convex(a, b)
    fans = [[np.stack([p[0], p[i], p[i + 1]]) for i in range(1, len(p) - 1)] for p in (a, b)]
    return abs(sum(np.sign(area(t)) * np.sign(area(u)) * _convex(t, u) for t in fans[0] for u in fans[1]))


def _convex(a: np.ndarray, b: np.ndarray) -> float:
    a, b = (p if area(p) >= 0 else p[::-1] for p in (a, b))
    if len(a) < 3 or len(b) < 3 or area(a) == 0 or area(b) == 0:
        return 0.0
    out = a
    for p, q in zip(b, np.roll(b, -1, axis=0), strict=True):
        if not len(out):
            return 0.0
        edge = q - p
        side = edge[0] * (out[:, 1] - p[1]) - edge[1] * (out[:, 0] - p[0])
        kept = []
        for i in range(len(out)):
            j = (i + 1) % len(out)
            if side[i] >= 0:
                kept.append(out[i])
            if side[i] * side[j] < 0:
                kept.append(out[i] + (out[j] - out[i]) * side[i] / (side[i] - side[j]))
        out = np.array(kept).reshape(-1, 2)
    return abs(area(out))


def overlap_ratio(a: np.ndarray, b: np.ndarray) -> float:
    """Intersection over union; 0 for an empty union."""
    inter = intersection(a, b)
    union = abs(area(a)) + abs(area(b)) - inter
    return inter / union if union else 0.0


#: Corners of polygons that are clipped at once.
AT_ONCE = 1 << 15


def intersections(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """`intersection` of many pairs at once; a and b: the corners of all polygons (k, 2), and each polygon's number of corners.

    Pairs of the same widths are clipped together. Polygons of more than eight corners are widened to a power of two by their last one.
    """
    out = np.zeros(len(a[1]))
    begin = [np.cumsum(n) - n for _, n in (a, b)]
    width = [np.where(n <= 8, n, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)) for _, n in (a, b)]
    kind = np.where((a[1] >= 3) & (b[1] >= 3), width[0] << 32 | width[1], 0)
    for v, w in ((k >> 32, k & 0xFFFFFFFF) for k in np.unique(kind) if k):
        rows = np.flatnonzero(kind == (v << 32 | w))
        for part in np.split(rows, range(size := max(1, AT_ONCE // int(v + w)), len(rows), size)):
            out[part] = _shared(*((xy.T, at[part], n[part], int(k)) for (xy, n), at, k in zip((a, b), begin, (v, w), strict=True)))
    return out


def _along(xy: np.ndarray, begin: np.ndarray, n: np.ndarray, width: int, shift: int = 0) -> np.ndarray:
    """(2, width, polygons): each polygon's corners from `shift` on, the last one repeated up to the width."""
    return xy[:, begin + (np.minimum(np.arange(width)[:, None], n - 1) + shift) % n]


def _shared(*pair: tuple) -> np.ndarray:
    shapes = [_along(*p) for p in pair]
    out = np.zeros(shapes[0].shape[2])
    near = np.flatnonzero(_near(*shapes))
    convex = np.ones(len(near), bool)
    for xy, begin, n, width in pair:
        convex &= _are_convex(xy, begin[near], n[near], width)
    for rows, area_of in ((near[convex], _clipped), (near[~convex], _fanned)):
        if len(rows):
            out[rows] = area_of(*(s[:, :, rows] for s in shapes))
    return out


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the boxes around share more than a border; all others share nothing."""
    return ~((a.max(axis=1) <= b.min(axis=1)) | (b.max(axis=1) <= a.min(axis=1))).any(axis=0)


def _are_convex(xy: np.ndarray, begin: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """`is_convex` of each."""
    at, nxt, then = (_along(xy, begin, n, width, k) for k in range(3))
    (ex, ey), (fx, fy) = nxt - at, then - nxt
    turn = ex * fy - ey * fx
    around = (np.arctan2(turn, ex * fx + ey * fy) * (np.arange(width)[:, None] < n)).sum(axis=0)
    return ((turn >= 0).all(axis=0) | (turn <= 0).all(axis=0)) & (np.abs(around) < 6.5)


def _areas(p: np.ndarray) -> np.ndarray:
    """`area` of each; corners (2, width, polygons)."""
    x, y = p
    return (x * np.roll(y, -1, axis=0) - np.roll(x, -1, axis=0) * y).sum(axis=0) / 2


def _clipped(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`_convex` of each pair. A corner that is repeated changes nothing, and a polygon of which nothing is left is one point."""
    sizes = [_areas(p) for p in (a, b)]
    out, by = (np.where(size >= 0, p, p[:, ::-1]) for p, size in zip((a, b), sizes, strict=True))
    column = np.arange(out.shape[2])
    for p, edge in zip(by.swapaxes(0, 1), (np.roll(by, -1, axis=1) - by).swapaxes(0, 1), strict=True):
        side = edge[0] * (out[1] - p[1]) - edge[1] * (out[0] - p[0])
        after = np.roll(side, -1, axis=0)
        kept = np.empty((2 * len(side), len(column)), bool)
        kept[::2], kept[1::2] = side >= 0, side * after < 0
        if kept[::2].all():
            continue
        corners = np.empty((2, *kept.shape))
        with np.errstate(all="ignore"):
            corners[:, ::2], corners[:, 1::2] = out, out + (np.roll(out, -1, axis=1) - out) * side / (side - after)
        spot = np.cumsum(kept, axis=0)
        out = np.zeros((2, max(1, spot[-1].max()), len(column)))
        out[:, spot[kept] - 1, np.broadcast_to(column, kept.shape)[kept]] = corners[:, kept]
        for k in range(1, out.shape[1]):
            np.copyto(out[:, k], out[:, k - 1], where=k >= spot[-1])
    return np.where((sizes[0] == 0) | (sizes[1] == 0), 0.0, np.abs(_areas(out)))


def _fanned(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Signed sum over the triangles of each pair, some of the left polygons' triangles at a time."""
    fans = [np.stack([np.broadcast_to(p[:, :1], p[:, 2:].shape), p[:, 1:-1], p[:, 2:]], axis=1) for p in (a, b)]
    signs = [np.sign(_areas(f.reshape(2, 3, -1))).reshape(f.shape[2:]) for f in fans]
    total = np.zeros(a.shape[2])
    step = max(1, AT_ONCE // (3 * signs[1].size))
    for k in range(0, len(signs[0]), step):
        sign = signs[0][k : k + step, None] * signs[1]
        t, u = (np.broadcast_to(f, (2, 3, *sign.shape)).reshape(2, 3, -1) for f in (fans[0][:, :, k : k + step, None], fans[1][:, :, None]))
        rows = np.flatnonzero((sign.ravel() != 0) & _near(t, u))
        shared = np.zeros(sign.size)
        shared[rows] = _clipped(t[:, :, rows], u[:, :, rows])
        total += (sign * shared.reshape(sign.shape)).sum(axis=(0, 1))
    return np.abs(total)


def _corners(x: pa.Array, y: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two array<double> -> corners of all (k, 2), number of each; null has none."""
    xy = [v.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) for v in (x, y)]
    return np.stack(xy, axis=1), pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def sizes(corners: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Area of each polygon, without a sign."""
    xy, n = corners
    out, begin = np.zeros(len(n)), np.cumsum(n) - n
    if len(xy):
        last = np.zeros(len(xy), bool)
        last[(begin + n - 1)[n > 0]] = True
        after = np.roll(xy, -1, axis=0)
        after[last] = xy[begin[n > 0]]
        whole = n > 2
        out[n > 0] = np.add.reduceat(xy[:, 0] * after[:, 1] - xy[:, 1] * after[:, 0], begin[n > 0]) / 2
        out[~whole] = 0.0
    return np.abs(out)


def polygon_shares(ax, ay, bx, by, whole: bool = False):
    """Column of struct<inter, a, b>: the area that two simple polygons share, and that of each; of corners as `polygon_intersection` has them,
    but as arrays of x and of y, which cost less to move than arrays of points."""

    @F.arrow_udf("struct<inter: double, a: double, b: double>")
    def shares(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        cut = np.trunc if whole else np.asarray
        for batch in batches:
            a, b = ((cut(xy), n) for xy, n in (_corners(*batch[:2]), _corners(*batch[2:])))
            yield pa.StructArray.from_arrays([pa.array(v, pa.float64()) for v in (intersections(a, b), sizes(a), sizes(b))], ["inter", "a", "b"])

    return shares.asNondeterministic()(ax, ay, bx, by)


def polygon_intersection(a, b, whole: bool = False):
    """Column of the area that two simple polygons share, of their corners truncated to whole numbers if `whole`; null polygons share none."""
    return polygon_shares(a["x"], a["y"], b["x"], b["y"], whole)["inter"]


def box_of(x, y, whole: bool = False):
    """Column of the box around corners given as arrays of x and of y."""
    cut = (lambda v: v.cast("long")) if whole else (lambda v: v)
    low, high = ([cut(f(v)).cast("double") for v in (x, y)] for f in (F.array_min, F.array_max))
    return F.struct(low[0].alias("x"), low[1].alias("y"), (high[0] - low[0]).alias("w"), (high[1] - low[1]).alias("h"))
