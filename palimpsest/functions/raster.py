"""Kernels over pixel arrays in numpy: 8-bit pictures (height, width, channels) in blue, green, red order, and probability maps."""

from __future__ import annotations

import numpy as np

# Weights of blue, green and red in grey, in 1 / 32768; mean and deviation of channels.
GREY = np.array([3735, 19235, 9798])
MEAN, DEVIATION = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def level(x: np.ndarray) -> np.ndarray:
    """Rounded (halves to even) and clipped to 8 bits."""
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def mirrored(n: int, pad: int) -> np.ndarray:
    """Indices -pad .. n + pad - 1 reflected at the border pixels, which are not repeated."""
    if n == 1:
        return np.zeros(2 * pad + 1, np.int64)
    i = np.arange(-pad, n + pad) % (2 * n - 2)
    return np.where(i < n, i, 2 * n - 2 - i)


def blurred(x: np.ndarray, size: int = 15) -> np.ndarray:
    """Gaussian blur; the deviation follows from the kernel's size."""
    half = size // 2
    sigma = 0.3 * (half - 1) + 0.8
    k = np.exp(-np.square(np.arange(-half, half + 1)) / (2 * sigma * sigma))
    k /= k.sum()
    h, w = x.shape[:2]
    rows = x.astype(float)[mirrored(h, half)]
    down = sum(k[i] * rows[i : i + h] for i in range(size))[:, mirrored(w, half)]
    return level(sum(k[i] * down[:, i : i + w] for i in range(size)))


def contrasted(x: np.ndarray, alpha: float, beta: float = 0.0) -> np.ndarray:
    return level(np.abs(x.astype(float) * alpha + beta))


def softened(x: np.ndarray, size: int = 15, alpha: float = 0.3) -> np.ndarray:
    """What a detector sees: blurred, with less contrast."""
    return contrasted(blurred(x, size), alpha)


def grey(x: np.ndarray) -> np.ndarray:
    """(h, w, 1); pictures of one channel as they are, an alpha channel is left out."""
    if x.shape[2] == 1:
        return x
    return ((x[..., :3].astype(np.int64) @ GREY + 16384) >> 15).astype(np.uint8)[..., None]


def enhanced(x: np.ndarray) -> np.ndarray:
    """What a recogniser sees: grey, sharpened by its eight neighbours, with more contrast, in as many channels as before (at most 3)."""
    g = grey(x)[..., 0].astype(np.int64)
    h, w = g.shape
    p = g[mirrored(h, 1)][:, mirrored(w, 1)]
    sharp = level(10 * g - sum(p[i : i + h, j : j + w] for i in range(3) for j in range(3)))
    return np.repeat(contrasted(sharp, 1.5, 10.0)[..., None], min(x.shape[2], 3), axis=2)


def resized(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, by pixels' centres."""
    if x.shape[:2] == (h, w):
        return x

    def along(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.minimum(at.astype(np.int64), max(n - 2, 0))
        return low, np.minimum(low + 1, n - 1), at - low

    (a, b, s), (c, d, t) = along(x.shape[0], h), along(x.shape[1], w)
    v = x.astype(float)
    rows = v[a] + (v[b] - v[a]) * s[:, None, None]
    return level(rows[:, c] + (rows[:, d] - rows[:, c]) * t[None, :, None])


def normalised(x: np.ndarray, scale: float = 1 / 255, mean=MEAN, deviation=DEVIATION) -> np.ndarray:
    """(channels, h, w) float32."""
    n = x.shape[2]
    v = (x.astype(np.float32) * np.float32(scale) - np.array(mean[:n], np.float32)) / np.array(deviation[:n], np.float32)
    return v.transpose(2, 0, 1)


def padded(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Zeros below and to the right, up to the size."""
    return np.pad(x, ((0, max(h - x.shape[0], 0)), (0, max(w - x.shape[1], 0)), (0, 0)))


def cropped(x: np.ndarray, left: int, top: int, right: int, bottom: int) -> np.ndarray:
    return x[max(top, 0) : max(bottom, 0), max(left, 0) : max(right, 0)]


def otsu(g: np.ndarray) -> int:
    """The level that parts grey values with the most variance between both sides; the first of equal ones."""
    n = np.bincount(g.ravel(), minlength=256).astype(float)
    below, total = np.cumsum(n), n.sum()
    low, whole = np.cumsum(n * np.arange(256)), (n * np.arange(256)).sum()
    above = total - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * np.square(low / below - (whole - low) / above)
    return int(np.nan_to_num(between).argmax())


def binarised(x: np.ndarray) -> np.ndarray:
    """Black and white of pictures with three channels; others as they are."""
    if x.shape[2] != 3:
        return x
    g = grey(x)
    return np.repeat(np.where(g > otsu(g), 255, 0).astype(np.uint8), 3, axis=2)


def on_colour(x: np.ndarray, colour=(255, 255, 255)) -> np.ndarray:
    """A picture with an alpha channel laid on a colour (red, green, blue); others as they are."""
    if x.shape[2] != 4:
        return x
    alpha = x[..., 3:] / 255
    return (np.array(colour[::-1]) * (1 - alpha) + x[..., :3] * alpha).astype(np.uint8)


def _cubic(t: np.ndarray) -> np.ndarray:
    """Weights of the four pixels around, for a share t of the way from the second to the third."""
    a, d = -0.75, np.abs(t[..., None] - np.array([-1.0, 0.0, 1.0, 2.0]))
    return np.where(d <= 1, (a + 2) * d**3 - (a + 3) * d**2 + 1, a * (d**3 - 5 * d**2 + 8 * d - 4))


def rectified(x: np.ndarray, quad: np.ndarray, w: int, h: int) -> np.ndarray:
    """The quad (corners clockwise from top left) as an upright picture, by perspective and cubic interpolation; border pixels go on
    outwards. One 1.5 times as high as wide or more is turned left."""
    if w < 1 or h < 1:
        return np.zeros((0, 0, x.shape[2]), np.uint8)
    to = np.array([(0, 0), (w, 0), (w, h), (0, h)], float)
    lines, values = [], []
    for (u, v), (p, q) in zip(to, np.asarray(quad, float), strict=True):
        lines += [[u, v, 1, 0, 0, 0, -u * p, -v * p], [0, 0, 0, u, v, 1, -u * q, -v * q]]
        values += [p, q]
    m = np.append(np.linalg.lstsq(np.array(lines), np.array(values), rcond=None)[0], 1).reshape(3, 3)
    v, u = np.mgrid[0:h, 0:w]
    sx, sy, sw = np.tensordot(m, np.stack([u, v, np.ones_like(u)]), 1)
    sx, sy = sx / sw, sy / sw
    x0, y0 = np.floor(sx).astype(np.int64), np.floor(sy).astype(np.int64)
    wx, wy = _cubic(sx - x0), _cubic(sy - y0)
    out = np.zeros((h, w, x.shape[2]))
    for j in range(4):
        row = np.clip(y0 + j - 1, 0, x.shape[0] - 1)
        for i in range(4):
            out += (wy[..., j] * wx[..., i])[..., None] * x[row, np.clip(x0 + i - 1, 0, x.shape[1] - 1)]
    got = level(out)
    return np.rot90(got) if h / w >= 1.5 else got


def regions(mask: np.ndarray, corners: bool = True) -> np.ndarray:
    """Labels 1, 2, ... of connected true pixels by their first pixel, 0 elsewhere; pixels touch at sides and, if asked, at corners."""
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]  # runs of true pixels, row by row
    parent = np.arange(len(row))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    reach = 1 if corners else 0
    first = np.searchsorted(row, np.arange(h + 1))
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if start[i] < end[j] + reach and start[j] < end[i] + reach:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    label = np.unique([root(i) for i in range(len(row))], return_inverse=True)[1] + 1 if len(row) else parent
    step = np.zeros((h, w + 1), np.int64)
    np.add.at(step, (row, start), label)
    np.add.at(step, (row, end), -label)
    return np.cumsum(step, axis=1)[:, :w]


def filled(mask: np.ndarray) -> np.ndarray:
    """The mask with its holes."""
    outside = regions(~np.pad(mask, 1), corners=False)
    return (outside != outside[0, 0])[1:-1, 1:-1]


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull of points (n, 2), corners in one direction, none on a side."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(ordered: np.ndarray) -> list:
        out: list = []
        for q in ordered.tolist():
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def least_rectangle(points: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(corners, side, other side) of the rectangle of least area around points: one side of it lies on a side of their hull."""
    p = hull(points).astype(float)
    if len(p) == 1:
        return np.repeat(p, 4, axis=0), 0.0, 0.0
    sides = np.roll(p, -1, axis=0) - p
    unit = sides / np.linalg.norm(sides, axis=1, keepdims=True)
    across = np.stack([-unit[:, 1], unit[:, 0]], axis=1)
    u, v = p @ unit.T, p @ across.T
    best = int(((u.max(0) - u.min(0)) * (v.max(0) - v.min(0))).argmin())
    (a, b), (c, d) = ((x[:, best].min(), x[:, best].max()) for x in (u, v))
    corners = np.array([(a, c), (b, c), (b, d), (a, d)]) @ np.stack([unit[best], across[best]])
    return corners, float(b - a), float(d - c)


def clockwise(corners: np.ndarray) -> np.ndarray:
    """Top left, top right, bottom right, bottom left: by x, then each pair by y."""
    p = corners[np.argsort(corners[:, 0], kind="stable")]
    left, right = (q if q[1, 1] > q[0, 1] else q[::-1] for q in (p[:2], p[2:]))
    return np.array([left[0], right[0], right[1], left[1]])


def widened(corners: np.ndarray, by: float) -> np.ndarray:
    """A rectangle moved outwards on all sides: the least rectangle around its outline with round corners."""
    out = corners.astype(float)
    for i, j in ((0, 1), (1, 0), (3, 2), (2, 3), (0, 3), (3, 0), (1, 2), (2, 1)):
        side = corners[i] - corners[j]
        if by and (n := np.linalg.norm(side)):
            out[i] += side / n * by
    return out


def mean_within(prob: np.ndarray, quad: np.ndarray) -> float:
    """Mean of the pixels in a convex quad or on its border, its corners truncated to pixels."""
    h, w = prob.shape
    (x0, y0), (x1, y1) = (np.clip(f(quad), 0, (w - 1, h - 1)).astype(np.int64) for f in (lambda q: np.floor(q.min(0)), lambda q: np.ceil(q.max(0))))
    q = np.trunc(quad - (x0, y0))
    y, x = np.mgrid[0 : y1 - y0 + 1, 0 : x1 - x0 + 1]
    left, right = np.ones(x.shape, bool), np.ones(x.shape, bool)
    for (ax, ay), (bx, by) in zip(q, np.roll(q, -1, axis=0), strict=True):
        side = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        left &= side >= 0
        right &= side <= 0
    inside = left | right
    return float(prob[y0 : y1 + 1, x0 : x1 + 1][inside].mean()) if inside.any() else 0.0


def map_boxes(prob: np.ndarray, to_h: int, to_w: int, mask: float = 0.3, least_score: float = 0.6, unclip: float = 1.5, most: int = 1000, least_side: float = 3, exact: bool = False) -> list[tuple[np.ndarray, float]]:
    """(quad, score) of each text region of a probability map, in whole coordinates of a picture of another size.

    A region is a set of connected pixels over `mask`; only the first `most` are looked at, which is the detector's own setting.
    Its rectangle is left out if a side is under `least_side`, or if its score is under `least_score`: the mean over the
    rectangle or, with `exact`, over the region and its holes. It is widened by area * unclip / perimeter, and left out if a
    side is then under least_side + 2. Holes are no regions of their own.
    """
    h, w = prob.shape
    label, out = regions(prob > mask), []
    ys, xs = np.nonzero(label)
    order = np.argsort(label[ys, xs], kind="stable")
    ys, xs = ys[order], xs[order]
    ends = [0, *np.cumsum(np.bincount(label[ys, xs], minlength=1)[1:]).tolist()]
    for a, b in list(zip(ends, ends[1:], strict=False))[:most]:
        y, x = ys[a:b], xs[a:b]
        corners, one, other = least_rectangle(np.stack([x, y], axis=1))
        if min(one, other) < least_side or max(one, other) == 0:
            continue
        if exact:
            own = np.zeros((int(np.ptp(y)) + 1, int(np.ptp(x)) + 1), bool)
            own[y - y.min(), x - x.min()] = True
            score = float(prob[y.min() : y.max() + 1, x.min() : x.max() + 1][filled(own)].mean())
        else:
            score = mean_within(prob, clockwise(corners))
        by = one * other * unclip / (2 * (one + other))
        if score < least_score or min(one, other) + 2 * by < least_side + 2:
            continue
        quad = clockwise(widened(corners, by))
        out.append((np.clip(np.rint(quad * (to_w / w, to_h / h)), 0, (to_w, to_h)), score))
    return out


def outlined(x: np.ndarray, polygons: list[np.ndarray], colour=(0, 0, 255), thick: int = 2) -> np.ndarray:
    """The picture with closed polygons drawn over it; what lies outside is cut off."""
    out = x.copy()
    h, w, channels = x.shape
    reach = np.arange(thick) - (thick - 1) // 2
    for polygon in polygons:
        for a, b in zip(polygon, np.roll(polygon, -1, axis=0), strict=True):
            n = int(np.abs(b - a).max()) + 1
            at = np.rint(a + (b - a) * np.linspace(0, 1, n + 1)[:, None]).astype(int)
            cols, rows = (at[:, None, None, 0] + reach[:, None]), (at[:, None, None, 1] + reach)
            cols, rows = (v.ravel() for v in np.broadcast_arrays(cols, rows))
            inside = (cols >= 0) & (cols < w) & (rows >= 0) & (rows < h)
            out[rows[inside], cols[inside]] = np.resize(colour, channels)
    return out
