"""Pictures as columns: Spark's image structs through numpy kernels, in Arrow batches. Sizes and windows are planned natively, so rows
are multiplied before pixels are touched, and one picture or probability map is held at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import raster
from .folds import _key_schema

#: Spark's image struct; `mode` is the type code of 8-bit arrays with so many channels.
PICTURE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
_ARROW = pa.struct([("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("mode", pa.int32()), ("data", pa.binary())])
_MODE = {1: 0, 3: 16, 4: 24}


def pixels(picture: dict | None) -> np.ndarray | None:
    """(height, width, channels) of an image struct; None for a null or unreadable one."""
    if picture is None or not picture["data"] or picture["height"] < 1 or picture["width"] < 1:
        return None
    return np.frombuffer(picture["data"], np.uint8).reshape(picture["height"], picture["width"], picture["nChannels"])


def picture_of(origin: str | None, x: np.ndarray) -> dict:
    h, w, c = x.shape
    return {"origin": origin, "height": h, "width": w, "nChannels": c, "mode": _MODE.get(c, 0), "data": x.tobytes()}


def mapped(kernel: Callable[..., np.ndarray], picture: Column, *values: Column) -> Column:
    """Column of kernel(pixels, *values); null where the picture is unreadable, a value is null or the kernel leaves no pixels."""

    @F.arrow_udf(PICTURE)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pictures, others in batches:
            out: list[dict | None] = []
            for one, rest in zip(pictures, others.to_pylist(), strict=True):
                one, rest = one.as_py(), list(rest.values())
                x = None if None in rest[1:] else pixels(one)
                got = None if x is None else kernel(x, *rest[1:])
                out.append(None if got is None or not got.size else picture_of(one["origin"], got))
            yield pa.array(out, _ARROW)

    return run(picture, F.struct(F.lit(0).alias("none"), *[v.alias(f"v{i}") for i, v in enumerate(values)]))


softened = lambda picture, size=15, alpha=0.3: mapped(lambda x: raster.softened(x, size, alpha), picture)
enhanced = lambda picture: mapped(raster.enhanced, picture)
binarised = lambda picture: mapped(raster.binarised, picture)
on_colour = lambda picture: mapped(raster.on_colour, picture)


def resized(picture: Column, height: Column, width: Column) -> Column:
    return mapped(raster.resized, picture, height, width)


def padded(picture: Column, height: Column, width: Column) -> Column:
    return mapped(raster.padded, picture, height, width)


def cropped(picture: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return mapped(raster.cropped, picture, left, top, right, bottom)


def rectified(picture: Column, quad: Column) -> Column:
    """The upright crop of a quad; its size comes from geometry.crop_dims."""
    size = G.crop_dims(quad)
    return mapped(lambda x, q, w, h: raster.rectified(x, np.array([(p["x"], p["y"]) for p in q]), w, h), picture, quad, size["w"], size["h"])


def least_rectangle_crop(picture: Column, points: Column) -> Column:
    """The upright crop of the least rectangle around points, which are truncated to pixels."""

    def crop(x: np.ndarray, points: list) -> np.ndarray:
        quad = raster.clockwise(raster.least_rectangle(np.array([(int(p["x"]), int(p["y"])) for p in points]))[0])
        d = lambda i, j: float(np.linalg.norm(quad[i] - quad[j]))
        return raster.rectified(x, quad, int(max(d(0, 1), d(2, 3))), int(max(d(0, 3), d(1, 2))))

    return mapped(crop, picture, points)


def fitted(picture: Column, size: Column) -> Column:
    """A line resized and padded to a geometry.line_size."""
    return padded(resized(picture, size["h"], size["resized_w"]), size["h"], size["w"])


def outlined(picture: Column, quads: Column, colour=(0, 0, 255), thick: int = 2) -> Column:
    """The picture with its quads drawn over it, for a look at detections, lines or regions."""
    return mapped(lambda x, q: raster.outlined(x, [np.array([(p["x"], p["y"]) for p in one], float) for one in q], colour, thick), picture, quads)


def crops(boxes: DataFrame, image: str = "image") -> DataFrame:
    """(…, image, quad) -> the same with the upright crop of each quad as its picture."""
    return boxes.withColumn(image, rectified(F.col(image), F.col("quad")))


def normalised(picture: Column, scale: float = 1 / 255, mean=raster.MEAN, deviation=raster.DEVIATION) -> Column:
    """array<float> of channels, rows, columns: a model's input; null for an unreadable picture."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [pixels(v.as_py()) for v in batch]
            yield pa.array([None if x is None else raster.normalised(x, scale, mean, deviation).ravel() for x in found], pa.list_(pa.float32()))

    return run(picture)


#: Steps by name, for chains from configuration.
STEPS: dict[str, Callable[..., Column]] = {"soften": softened, "enhance": enhanced, "binarise": binarised, "on_colour": on_colour, "normalise": normalised}


def chained(picture: Column, steps: list[dict | str]) -> Column:
    """Steps of STEPS one after the other: names, or {name: parameters}. An unknown name is an error."""
    for step in steps:
        name, options = (step, {}) if isinstance(step, str) else next(iter(step.items()))
        if name not in STEPS:
            raise ValueError(f"no picture step {name}")
        picture = STEPS[name](picture, **(options or {}))
    return picture


def windows(rows: DataFrame, spans: Column, image: str = "image") -> DataFrame:
    """A row per window: chunk_idx, and `image` cut to the window's columns. `spans` is an array of begin and end columns."""
    out = rows.select("*", F.posexplode(spans).alias("chunk_idx", "__span"))
    return out.withColumn(image, cropped(F.col(image), F.col("__span.begin"), F.lit(0), F.col("__span.end"), F.col(image)["height"])).drop("__span")


def tiled(rows: DataFrame, image: str = "image", size: int = 640, overlap: int = 64) -> DataFrame:
    """A row per tile: left, top, right, bottom, and `image` cut to the tile, padded to `size` below and to the right."""
    grid = G.tiles(F.col(image)["width"], F.col(image)["height"], size, overlap)
    out = rows.select("*", F.explode(grid).alias("__t"))
    cut = lambda x, *at: raster.padded(raster.cropped(x, *at), size, size)
    sides = [F.col(f"__t.{k}") for k in ("left", "top", "right", "bottom")]
    return out.withColumns({image: mapped(cut, F.col(image), *sides), **{k: F.col(f"__t.{k}") for k in ("left", "top", "right", "bottom")}}).drop("__t")


def stitched_tiles(tiles: DataFrame, keys: list[str], mask: float = 0.3) -> DataFrame:
    """(…keys, left, top, right, bottom, tile_width, probs array<float>) -> (…keys, height, width, probs): at each pixel the number of tiles
    whose probability is over `mask`. An image's tiles are few, and come to one task; keys may be null."""

    def add(table: pa.Table) -> pa.Table:
        at = {k: table[k].to_numpy() for k in ("left", "top", "right", "bottom", "tile_width")}
        h, w = int(at["bottom"].max()), int(at["right"].max())
        total = np.zeros((h, w), np.float32)
        for i, probs in enumerate(table["probs"]):
            left, top, right, bottom, wide = (int(at[k][i]) for k in ("left", "top", "right", "bottom", "tile_width"))
            values = probs.values.to_numpy(zero_copy_only=False).reshape(-1, wide)
            total[top:bottom, left:right] += values[: bottom - top, : right - left] > mask
        return pa.table([*[table[k].slice(0, 1).combine_chunks() for k in keys], pa.array([h], pa.int32()), pa.array([w], pa.int32()), pa.array([total.ravel()], pa.list_(pa.float32()))], [*keys, "height", "width", "probs"])

    rows = tiles.select(*keys, "left", "top", "right", "bottom", "tile_width", F.col("probs").cast("array<float>").alias("probs"))
    return rows.groupBy(*keys).applyInArrow(add, f"{_key_schema(tiles, keys)}, height int, width int, probs array<float>")


def map_boxes(maps: DataFrame, to_height: Column, to_width: Column, mask: float = 0.3, least_score: float = 0.6, unclip: float = 1.5, most: int = 1000, least_side: float = 3, exact: bool = False) -> DataFrame:
    """(…, height, width, probs array<float>) -> (…, box_idx, quad, det_score): a row per text region of each probability map; see
    raster.map_boxes. Maps that are null or of another size than they say give no rows."""

    @F.arrow_udf("array<struct<quad:array<struct<x:double,y:double>>,score:double>>")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("quad", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), ("score", pa.float64())]))
        for probs, heights, widths, to_h, to_w in batches:
            out = []
            for p, *sizes in zip(probs, heights.to_pylist(), widths.to_pylist(), to_h.to_pylist(), to_w.to_pylist(), strict=True):
                found = []
                if p.is_valid and None not in sizes and len(p) == sizes[0] * sizes[1] > 0:
                    prob = p.values.to_numpy(zero_copy_only=False).reshape(sizes[0], sizes[1])
                    found = raster.map_boxes(prob, sizes[2], sizes[3], mask, least_score, unclip, most, least_side, exact)
                out.append([{"quad": [{"x": x, "y": y} for x, y in q.tolist()], "score": s} for q, s in found])
            yield pa.array(out, kind)

    keys = [c for c in maps.columns if c not in ("height", "width", "probs")]
    found = run(F.col("probs").cast("array<float>"), F.col("height"), F.col("width"), to_height, to_width)
    rows = maps.select(*keys, F.posexplode(found).alias("box_idx", "__b"))
    return rows.select(*keys, "box_idx", F.col("__b.quad").alias("quad"), F.col("__b.score").alias("det_score"))
