"""Detection and recognition as pluggable stages over Arrow batches. Weights are no part of this engine; a model is any object with
the methods below, made once per Python worker by a factory."""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..functions import geometry as G
from ..functions import raster
from ..operators import folds, pictures

_POINT = StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])


class Detector(Protocol):
    def detect(self, images: list[bytes]) -> list[list[tuple[list[tuple[float, float]], float]]]:
        """Quads with scores of each image; an unreadable image has none."""


class Recognizer(Protocol):
    def recognize(self, images: list[bytes], quads: list[list[tuple[float, float]]]) -> list[tuple[str, float]]:
        """Text and score of each quad of its image."""


class StubModel:
    """Deterministic boxes and texts from a digest of the image, for tests and dry runs."""

    def detect(self, images):
        out = []
        for image in images:
            h = hashlib.sha256(image).digest()
            out.append([([(x, y), (x + w, y), (x + w, y + 30.0), (x, y + 30.0)], 0.5 + h[i] / 512) for i in range(h[0] % 4) for x, y, w in [(float(h[i + 1] * 2), float(h[i + 2] * 2), 40.0 + h[i + 3])]])
        return out

    def recognize(self, images, quads):
        return [(f"text{hashlib.sha256(image).digest()[0] % 7}", 0.8 + (sum(int(x) for x, _ in q) % 20) / 100) for image, q in zip(images, quads, strict=True)]


_MODELS: dict = {}


def _model(factory: Callable):
    key = f"{factory.__module__}.{factory.__qualname__}"
    if key not in _MODELS:
        _MODELS[key] = factory()
    return _MODELS[key]


def _boxes_type() -> ArrayType:
    return ArrayType(StructType([StructField("quad", ArrayType(_POINT)), StructField("score", DoubleType())]))


def apart(column: Column) -> Column:
    """The column, kept out of other expressions by the planner: arguments of Python columns must hold no lambda functions, as those are
    not always told apart when calls are taken out of the plan, which then fails."""
    return F.when(F.spark_partition_id() >= 0, column)


def found(image: Column, factory: Callable[[], Detector] = StubModel) -> Column:
    """array<struct<quad, score>>: the boxes of each picture. As all columns of models it counts as not deterministic, so that the planner
    never copies a call into a filter or a second projection: a model sees a picture once."""

    @F.arrow_udf(_boxes_type())
    def run(images: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in images:
            boxes = _model(factory).detect([x or b"" for x in batch.to_pylist()])
            yield pa.array([[{"quad": [{"x": x, "y": y} for x, y in q], "score": s} for q, s in one] for one in boxes], to_arrow_type(_boxes_type()))

    return run.asNondeterministic()(image)


def by_aspect(quads: list[list[tuple[float, float]]], most: int) -> list[list[int]]:
    """Places of quads in batches of `most`, in the order of their width over their height, so that a batch pads little."""

    def aspect(q: list[tuple[float, float]]) -> float:
        (x, y), (u, v), (s, t) = q[0], q[1], q[2]
        return math.hypot(u - x, v - y) / max(math.hypot(s - u, t - v), 1e-6)

    order = sorted(range(len(quads)), key=lambda i: aspect(quads[i]))
    return [order[i : i + most] for i in range(0, len(order), most)]


def texts_of(image: Column, quads: Column, factory: Callable[[], Recognizer] = StubModel, most: int = 64) -> Column:
    """array<struct<text, score, elapse>>: the text of each of a picture's quads.

    The quads of all pictures of an Arrow batch go through the model in batches of `most` by aspect ratio, and back to their places.
    """
    kind = ArrayType(StructType([StructField("text", StringType()), StructField("score", DoubleType()), StructField("elapse", DoubleType())]))

    @F.arrow_udf(kind)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        from pyspark.sql.pandas.types import to_arrow_type

        for images, lists in batches:
            pictures = [x or b"" for x in images.to_pylist()]
            rows = [[[(p["x"], p["y"]) for p in q] for q in one or []] for one in lists.to_pylist()]
            flat = [(i, q) for i, one in enumerate(rows) for q in one]
            got: list = [None] * len(flat)
            for part in by_aspect([q for _, q in flat], most):
                began = time.perf_counter()
                texts = _model(factory).recognize([pictures[flat[k][0]] for k in part], [flat[k][1] for k in part])
                each = (time.perf_counter() - began) / len(part)
                for k, (text, score) in zip(part, texts, strict=True):
                    got[k] = {"text": text, "score": score, "elapse": each}
            back = iter(got)
            yield pa.array([[next(back) for _ in one] for one in rows], to_arrow_type(kind))

    return run.asNondeterministic()(image, quads)


def detect(frames: DataFrame, factory: Callable[[], Detector] = StubModel) -> DataFrame:
    """(…keys, image) -> (…keys, box_idx, quad, det_score, image): one row per box."""
    rows = frames.withColumn("__found", found(F.col("image"), factory)).select(*frames.columns, F.posexplode("__found").alias("box_idx", "__b"))
    return rows.select(*frames.columns, "box_idx", F.col("__b.quad").alias("quad"), F.col("__b.score").alias("det_score"))


def recognize(boxes: DataFrame, factory: Callable[[], Recognizer] = StubModel, most: int = 64) -> DataFrame:
    """(…, image, quad) -> (…, text, score, elapse): batches cross images, and no join is needed as keys stay with their rows."""
    rows = boxes.withColumn("__r", texts_of(F.col("image"), F.array("quad"), factory, most))
    return rows.withColumns({k: F.get("__r", F.lit(0))[k] for k in ("text", "score", "elapse")}).drop("__r")


def lines_of(boxes: Column, y_share: float = 0.5, gap_share: float = 0.3) -> Column:
    """array<struct<x, y, w, h>> of a picture's boxes -> that of its text lines."""
    kind = "array<struct<x:double,y:double,w:double,h:double>>"

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [[(b["x"], b["y"], b["w"], b["h"]) for b in one or []] for one in batch.to_pylist()]
            out = [[dict(zip("xywh", folds.box_around([b[i] for i in of]), strict=True)) for of in folds.merge_lines(b, y_share, gap_share)] for b in rows]
            yield pa.array(out, pa.list_(pa.struct([(k, pa.float64()) for k in "xywh"])))

    return run.asNondeterministic()(boxes)


def reading_places(points: Column) -> Column:
    """array<struct<x, y>> -> array<int>: places of the points in reading order, by swaps."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([folds.reading_swaps([(p["x"], p["y"]) for p in one or []]) for one in batch.to_pylist()], pa.list_(pa.int32()))

    return run(points)


def fetched(spark: SparkSession, path: str) -> Callable[[], str]:
    """Sends a model's file to each executor once; what is returned gives its local path there, for a factory to load."""
    spark.sparkContext.addFile(path)
    name = path.rstrip("/").rsplit("/", 1)[-1]

    def local() -> str:
        from pyspark import SparkFiles

        return SparkFiles.get(name)

    return local


class MapModel(Protocol):
    def maps(self, images: list[np.ndarray]) -> list[np.ndarray]:
        """The text probability of each pixel of each picture, in a map of the picture's height and width."""


class BrightnessModel:
    """Brightness as probability, for tests and dry runs."""

    def maps(self, images):
        return [(x.max(axis=2) / 255).astype(np.float32) for x in images]


def probability_maps(rows: DataFrame, factory: Callable[[], MapModel] = BrightnessModel, image: str = "image") -> DataFrame:
    """(…, image struct) -> (…, height, width, probs): pictures give way to their maps; null where a picture is unreadable."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            seen = [pictures.pixels(v.as_py()) for v in batch]
            maps = iter(_model(factory).maps([x for x in seen if x is not None]))
            yield pa.array([None if x is None else next(maps).astype(np.float32).ravel() for x in seen], pa.list_(pa.float32()))

    size = {"height": F.col(image)["height"], "width": F.col(image)["width"]}
    return rows.select(*[c for c in rows.columns if c not in (image, *size)], *[v.alias(k) for k, v in size.items()], run.asNondeterministic()(F.col(image)).alias("probs"))


def detect_tiled(frames: DataFrame, keys: list[str], factory: Callable[[], MapModel] = BrightnessModel, size: int = 640, overlap: int = 64, mask: float = 0.3, most_tiles: int = 8, **limits) -> DataFrame:
    """(…keys, image struct) -> (…keys, box_idx, quad, det_score) in the picture's coordinates, by way of overlapping tiles.

    The picture is scaled so that its long side spans two tiles. Its tiles go through the model `most_tiles` at a time and into one map in
    the task that holds the picture, so neither pictures nor maps are shuffled. `limits` are those of raster.map_boxes.
    """
    kind = "array<struct<quad:array<struct<x:double,y:double>>,score:double>>"

    @F.arrow_udf(kind)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for images, sizes, grids in batches:
            out = []
            for image, to, grid in zip(images, sizes.to_pylist(), grids.to_pylist(), strict=True):
                x = raster.resized(pictures.pixels(image.as_py()), to["h"], to["w"])
                total = np.zeros(x.shape[:2], np.float32)
                for i in range(0, len(grid), most_tiles):
                    part = grid[i : i + most_tiles]
                    cut = [raster.padded(raster.cropped(x, t["left"], t["top"], t["right"], t["bottom"]), size, size) for t in part]
                    for t, probs in zip(part, _model(factory).maps(cut), strict=True):
                        total[t["top"] : t["bottom"], t["left"] : t["right"]] += probs[: t["bottom"] - t["top"], : t["right"] - t["left"]] > mask
                boxes = raster.map_boxes(total, image["height"].as_py(), image["width"].as_py(), mask, **limits)
                out.append([{"quad": [{"x": x, "y": y} for x, y in q.tolist()], "score": s} for q, s in boxes])
            yield pa.array(out, pa.list_(pa.struct([("quad", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), ("score", pa.float64())])))

    to = G.two_tile_size(F.col("image.width"), F.col("image.height"), size, overlap)
    rows = frames.where("image.height > 0").select(*keys, "image", to.alias("__to"))
    rows = rows.withColumn("__tiles", apart(G.tiles(F.col("__to.w"), F.col("__to.h"), size, overlap)))
    rows = rows.select(*keys, run.asNondeterministic()(F.col("image"), F.col("__to"), F.col("__tiles")).alias("__found"))
    return rows.select(*keys, F.posexplode("__found").alias("box_idx", "__b")).select(*keys, "box_idx", F.col("__b.quad").alias("quad"), F.col("__b.score").alias("det_score"))
