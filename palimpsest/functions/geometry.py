"""Boxes, quads, regions of interest and sizes as Column expressions; every one stays inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def whole(x) -> Column:
    """Truncation toward zero to a long."""
    return F.expr("bigint(0)") + _c(x).cast("long")


def half_even(x) -> Column:
    """Rounding to a long, halves to even."""
    return F.bround(_c(x).cast("double")).cast("long")


def _xs(quad: Column) -> Column:
    return F.transform(quad, lambda p: p["x"])


def _ys(quad: Column) -> Column:
    return F.transform(quad, lambda p: p["y"])


def box(x, y, w, h) -> Column:
    return F.struct(*[_c(v).cast("double").alias(k) for k, v in (("x", x), ("y", y), ("w", w), ("h", h))])


def quad_of(b: Column) -> Column:
    """The corners of an upright box, clockwise from top left."""
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    r, d = b["x"] + b["w"], b["y"] + b["h"]
    return F.array(at(b["x"], b["y"]), at(r, b["y"]), at(r, d), at(b["x"], d))


def bounding_box(quad: Column) -> Column:
    x, y = F.array_min(_xs(quad)), F.array_min(_ys(quad))
    return box(x, y, F.array_max(_xs(quad)) - x, F.array_max(_ys(quad)) - y)


def parse_roi(text: Column) -> Column:
    """'a,b,c,d' -> ROI struct; null unless four numbers; all divided by 100 if any is over 1."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("double"))
    ok = (F.size(parts) == 4) & ~F.exists(parts, lambda p: p.isNull())
    scale = F.when(F.array_max(parts) > 1, 100.0).otherwise(1.0)
    return F.when(ok, F.struct(*[(parts[i] / scale).alias(k) for i, k in enumerate(("x1", "y1", "x2", "y2"))]))


def overlap_area(a: Column, b: Column) -> Column:
    """Area that two upright boxes share."""
    side = lambda p, s: F.greatest(F.lit(0.0), F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p]))
    return side("x", "w") * side("y", "h")


def iou(a: Column, b: Column) -> Column:
    inter = overlap_area(a, b)
    return inter / (a["w"] * a["h"] + b["w"] * b["h"] - inter + F.lit(1e-6))


def in_roi(b: Column, roi: Column | None, width, height) -> Column:
    """Box wholly inside the region, borders included; the region's pixels are truncated. True without a region."""
    if roi is None:
        return F.lit(True)
    px = lambda k, n: whole(roi[k] * _c(n))
    inside = (b["x"] >= px("x1", width)) & (b["y"] >= px("y1", height)) & (b["x"] + b["w"] <= px("x2", width)) & (b["y"] + b["h"] <= px("y2", height))
    return roi.isNull() | inside


def size_ratios(b: Column, width, height) -> tuple[Column, Column]:
    return b["w"] / _c(width), b["h"] / _c(height)


def size_fits(b: Column, width, height, least=(0.01, 0.01), most=(0.9, 0.15)) -> Column:
    """Both ratios within inclusive limits."""
    w, h = size_ratios(b, width, height)
    return w.between(least[0], most[0]) & h.between(least[1], most[1])


def padded_crop(b: Column, width, height, pad: float = 0.05) -> Column:
    """Rectangle x1, y1, x2, y2: clamped to the image, padded by a truncated share of its sides, clamped again."""
    limit = {"x": _c(width).cast("long"), "y": _c(height).cast("long")}
    out = []
    for p, s in (("x", "w"), ("y", "h")):
        a, z = F.greatest(F.lit(0), whole(b[p])), F.least(limit[p], whole(b[p] + b[s]))
        more = whole((z - a) * pad)
        out.append((F.greatest(F.lit(0), a - more), F.least(limit[p], z + more)))
    (x1, x2), (y1, y2) = out
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def scaled_size(width, height, factor) -> Column:
    return F.struct(whole(_c(width) * _c(factor)).alias("w"), whole(_c(height) * _c(factor)).alias("h"))


def _with_ratios(h: Column, w: Column, height, width) -> Column:
    return F.struct(h.alias("h"), w.alias("w"), (h / _c(height).cast("double")).alias("ratio_h"), (w / _c(width).cast("double")).alias("ratio_w"))


def limited_size(width, height, limit: float, kind: str = "max") -> Column:
    """Sides scaled by one ratio so that the longer (`max`), shorter (`min`) or long (`resize_long`) side meets the limit, truncated,
    then rounded to multiples of 32 (halves to even), 32 at least."""
    w, h = _c(width).cast("double"), _c(height).cast("double")
    if kind == "max":
        ratio = F.when(F.greatest(w, h) > limit, F.lit(float(limit)) / F.greatest(w, h)).otherwise(1.0)
    elif kind == "min":
        ratio = F.when(F.least(w, h) < limit, F.lit(float(limit)) / F.least(w, h)).otherwise(1.0)
    elif kind == "resize_long":
        ratio = F.lit(float(limit)) / F.greatest(w, h)
    else:
        raise ValueError(f"unknown limit kind {kind}")
    side = lambda s: F.greatest(half_even(whole(s * ratio) / 32.0) * 32, F.lit(32))
    return _with_ratios(side(h), side(w), height, width)


def fixed_size(width, height, to_h: int, to_w: int, keep_ratio: bool = False) -> Column:
    w = F.ceil(_c(width) * to_h / _c(height).cast("double") / 32.0) * 32 if keep_ratio else F.lit(to_w).cast("long")
    return _with_ratios(F.lit(to_h).cast("long"), w, height, width)


def strided_size(width, height, side: int, kind: str = "max", stride: int = 128) -> Column:
    """Sides scaled by one ratio and truncated, then raised to multiples of `stride`. The longer side (`max`) or the shorter one (`min`) meets
    `side`; or (`enlarge`) both grow by a quarter, unless that takes the height beyond `side`, when the height meets it."""
    w, h, to = _c(width).cast("double"), _c(height).cast("double"), F.lit(float(side))
    if kind == "enlarge":
        ratio = F.when(h * 1.25 > to, to / h).otherwise(1.25)
    elif kind in ("max", "min"):
        ratio = to / (F.greatest(w, h) if kind == "max" else F.least(w, h))
    else:
        raise ValueError(f"unknown kind {kind}")
    up = lambda s: F.floor((whole(s * ratio) + (stride - 1)) / float(stride)) * stride
    return _with_ratios(up(h), up(w), height, width)


def long_size(width, height, long_side: int) -> Column:
    """Long side scaled to the given length, both sides then raised to multiples of 128."""
    return strided_size(width, height, long_side)


def least_padded(width, height) -> Column:
    """Sides padded to 32 where together they are under 64."""
    w, h = _c(width), _c(height)
    small = w + h < 64
    return F.struct(F.when(small, F.greatest(F.lit(32), h)).otherwise(h).alias("h"), F.when(small, F.greatest(F.lit(32), w)).otherwise(w).alias("w"))


def tiles(width, height, size: int = 640, overlap: int = 64) -> Column:
    """Array of left, top, right, bottom tiles with the given overlap; those at the far edges are moved back to keep their size."""
    w, h = _c(width).cast("long"), _c(height).cast("long")

    def starts(n: Column) -> Column:
        last = n - overlap - 1
        return F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last, F.lit(size - overlap).cast("long"))).otherwise(F.expr("cast(array() as array<bigint>)"))

    def span(a: Column, n: Column) -> tuple[Column, Column]:
        end = F.least(a + size, n)
        return F.when(end >= n, F.greatest(F.lit(0), n - size)).otherwise(a), end

    def tile(x: Column, y: Column) -> Column:
        (left, right), (top, bottom) = span(x, w), span(y, h)
        return F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))

    grid = F.flatten(F.transform(starts(h), lambda y: F.transform(starts(w), lambda x: tile(x, y))))
    one = F.array(F.struct(F.lit(0).cast("long").alias("left"), F.lit(0).cast("long").alias("top"), w.alias("right"), h.alias("bottom")))
    return F.when((w <= size) & (h <= size), one).otherwise(grid)


def _span(begin: Column, end: Column) -> Column:
    return F.struct(begin.cast("int").alias("begin"), end.cast("int").alias("end"))


def half_windows(width) -> Column:
    """Columns of a line's left half, right half and middle half."""
    half = F.floor(_c(width) / 2)
    quarter = F.floor(half / 2)
    return F.array(_span(F.lit(0), half), _span(half, half * 2), _span(quarter, quarter + half))


def square_windows(width, height, base: int = 32) -> Column:
    """Columns of windows of four squares that advance by two, over a line resized to `base` rows and an even number of squares, six
    at least; the resized width is base times that number."""
    squares = F.greatest(F.lit(6), F.floor(F.floor(_c(width) / _c(height)) / 2) * 2).cast("int")
    return F.transform(F.sequence(F.lit(0), F.floor(squares / 2).cast("int") - 2), lambda i: _span(i * 2 * base, (i * 2 + 4) * base))


def two_tile_size(width, height, size: int = 640, overlap: int = 64) -> Column:
    """Sizes for tiled detection: the long side spans two tiles, the other follows with integer division."""
    w, h, span = _c(width).cast("long"), _c(height).cast("long"), 2 * size - overlap
    return F.struct(F.when(h > w, F.lit(span)).otherwise(F.floor(h * span / w)).cast("long").alias("h"), F.when(h > w, F.floor(w * span / h)).otherwise(F.lit(span)).cast("long").alias("w"))


def distance(p: Column, q: Column) -> Column:
    return F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))


def crop_dims(quad: Column) -> Column:
    """Width and height of the rectified crop of a quad, and whether it is turned (height 1.5 times the width or more)."""
    p = [quad[i] for i in range(4)]
    w, h = whole(F.greatest(distance(p[0], p[1]), distance(p[2], p[3]))), whole(F.greatest(distance(p[0], p[3]), distance(p[1], p[2])))
    return F.struct(w.alias("w"), h.alias("h"), (F.try_divide(h.cast("double"), w.cast("double")) >= 1.5).alias("turned"))


def ordered_corners(quad: Column) -> Column:
    """Four points as top left, top right, bottom right, bottom left: by x, then each pair by y."""
    s = F.array_sort(F.transform(quad, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    upper = lambda a, b: F.when(b["y"] > a["y"], a).otherwise(b)
    lower = lambda a, b: F.when(b["y"] > a["y"], b).otherwise(a)
    return F.array(upper(s[0], s[1]), upper(s[2], s[3]), lower(s[2], s[3]), lower(s[0], s[1]))


def _edges(quad: Column) -> Column:
    """Each point with its successor."""
    return F.zip_with(quad, F.concat(F.slice(quad, 2, F.size(quad)), F.slice(quad, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def signed_area(quad: Column) -> Column:
    return F.aggregate(_edges(quad), F.lit(0.0), lambda s, e: s + e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]) / 2.0


def polygon_area(quad: Column) -> Column:
    return F.abs(signed_area(quad))


def perimeter(quad: Column) -> Column:
    return F.aggregate(_edges(quad), F.lit(0.0), lambda s, e: s + distance(e["p"], e["q"]))


def unclip_distance(quad: Column, ratio: float = 1.5) -> Column:
    return F.try_divide(polygon_area(quad) * ratio, perimeter(quad))


def rescaled(value: Column, size, to) -> Column:
    """Coordinate moved to another size: rounded (halves to even), clipped to it."""
    return F.least(F.greatest(half_even(value / _c(size) * _c(to)), F.lit(0)), _c(to).cast("long"))


def aspect_bucket(width, height) -> Column:
    return F.greatest(F.lit(1), half_even(_c(width) / _c(height).cast("double")))


def recognition_size(width, height, most: int = 12, base: int = 32, shapes=((64, 64), (96, 48), (112, 40), (128, 32))) -> Column:
    """Input size of a line by its ratio, truncated plus one and capped: a listed shape up to 4, else base-high and ratio times as wide."""
    r = F.least(whole(_c(width).cast("double") / _c(height)) + 1, F.lit(most))
    pick = lambda i: reduce(lambda acc, k: acc.when(r == k + 1, F.lit(shapes[k][i])), range(1, len(shapes)), F.when(r == 1, F.lit(shapes[0][i])))
    return F.struct(pick(0).otherwise(r * base).cast("long").alias("w"), pick(1).otherwise(F.lit(base)).cast("long").alias("h"))


def line_size(width, height, kind: str, shape: tuple[int, int] = (32, 128), most: int = 12, base: int = 32, shapes=((64, 64), (96, 48), (112, 40), (128, 32)), widths: tuple[int, int] = (48, 160), step: int = 4, factor=1.0) -> Column:
    """struct<h, w, resized_w, valid_ratio>: the input of a model of lines, and the width that a line is resized to within it.

    `stretch`: the shape (height, width), filled. `pad`: the shape; the line keeps its ratio where it fits. `ratio`: a listed shape (width,
    height) by the ratio rounded, 1 to `most`, else base-high and ratio times as wide; the line as in `pad`, its width times `factor`.
    `dynamic`: as `pad`, but as wide as the line needs. `steps`: widths in multiples of `step` between `widths`, in the widest. `thirds`:
    one, two or three squares by the ratio, else the shape's width.
    """
    w, h = _c(width).cast("double"), _c(height).cast("double")
    to_h, to_w = F.lit(shape[0]), F.lit(shape[1]).cast("long")
    if kind == "ratio":
        r = F.least(F.greatest(F.lit(1), half_even(w / h)), F.lit(most))
        pick = lambda i, other: reduce(lambda acc, k: acc.when(r == k + 1, F.lit(shapes[k][i])), range(1, len(shapes)), F.when(r == 1, F.lit(shapes[0][i]))).otherwise(other)
        to_w, to_h = pick(0, r * base).cast("long"), pick(1, F.lit(base))
    if kind == "dynamic":
        to_w = whole(to_h * F.greatest(w / h, F.lit(shape[1] * 1.0 / shape[0])))
    exact = F.ceil(to_h * (w / h))
    valid = None
    if kind == "stretch":
        resized = to_w
    elif kind in ("pad", "dynamic", "ratio"):
        resized = F.when(exact > to_w, to_w).otherwise(F.least(to_w, F.ceil(to_h * (w / h) * _c(factor))))
    elif kind == "steps":
        near = F.greatest(F.lit(widths[0]), F.when(exact % step != 0, half_even(exact / float(step)) * step).otherwise(exact))
        to_w, resized, valid = F.lit(widths[1]).cast("long"), F.least(F.lit(widths[1]), near), valid_ratio(near, widths[1])
    elif kind == "thirds":
        resized = F.when(w <= h, to_h).when(w <= h * 2, to_h * 2).when(w <= h * 3, to_h * 3).otherwise(to_w)
    else:
        raise ValueError(f"no kind of line {kind}")
    valid = valid_ratio(resized, to_w) if valid is None else valid
    return F.struct(to_h.cast("long").alias("h"), to_w.alias("w"), resized.cast("long").alias("resized_w"), valid.alias("valid_ratio"))


def valid_ratio(resized_w, image_w) -> Column:
    return F.least(F.lit(1.0), _c(resized_w).cast("double") / _c(image_w))


def boundary_ok(values: Column, with_score: bool) -> Column:
    """Eight numbers at least, pairs of them, and one more with a score."""
    n = F.size(values)
    return (n >= 8) & (n % 2 == (1 if with_score else 0))


def shrunk_along_width(quad: Column, begin: float = 0.0, end: float = 1.0) -> Column:
    """The part of a quad between two shares of its upper and lower edges; shares outside 0 to 1 expand it."""
    along = lambda a, b, r: F.struct(*[(a[k] + (b[k] - a[k]) * r).alias(k) for k in "xy"])
    p = [quad[i] for i in range(4)]
    return F.array(along(p[0], p[1], begin), along(p[0], p[1], end), along(p[3], p[2], end), along(p[3], p[2], begin))


def ring(upper: Column, lower: Column) -> Column:
    """Polygon of pairs of points along a line: one side forward, the other back."""
    return F.concat(upper, F.reverse(lower))


def along_direction(points: Column) -> Column:
    """array<struct<x, y, dx, dy>> in the order of projections on the mean direction; of 16 points or more, each half is then put in
    the order of its own mean direction. Equal projections stay as they are. Missing dx or dy take no part in a mean; points without
    a projection come last."""
    bound = lambda v, body: F.transform(F.array(v), body)[0]  # noqa: E731  (v is worked out once)

    def mean(p: Column, k: str) -> Column:
        known = F.filter(F.transform(p, lambda q: q[k]), lambda v: v.isNotNull())
        return bound(known, lambda v: F.try_divide(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), F.size(v)))

    def sort(p: Column) -> Column:
        projected = lambda m: F.transform(p, lambda q, i: F.struct((q["x"] * m["dx"] + q["y"] * m["dy"]).alias("at"), i.alias("i"), q.alias("q")))
        keyed = bound(F.struct(mean(p, "dx").alias("dx"), mean(p, "dy").alias("dy")), projected)
        last = F.transform(keyed, lambda k: F.struct(k["at"].isNull().alias("none"), k["at"].alias("at"), k["i"].alias("i"), k["q"].alias("q")))
        return F.transform(F.array_sort(last), lambda k: k["q"])

    def halves(once: Column) -> Column:
        half = F.floor(F.size(once) / 2).cast("int")
        parts = F.concat(*[bound(p, sort) for p in (F.slice(once, F.lit(1), half), F.slice(once, half + 1, F.size(once) - half))])
        return F.when(F.size(once) >= 16, parts).otherwise(once)

    return bound(bound(points, sort), halves)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x.cast("double") - F.array_max(a).cast("double")))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))
