"""The engine's three ways from pictures to text: video to segments, images to texts, end to end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import filters, folds
from ..sources import sampling
from . import models
from .config import Settings


def sample(videos: DataFrame, settings: Settings) -> DataFrame:
    if settings.sampler == "modulo":
        return sampling.modulo(videos, settings.sec_skip)
    if settings.sampler == "sequential":
        return sampling.sequential(videos, settings.sec_skip)
    if settings.sampler == "segmented":
        return sampling.segmented(videos, settings.sec_skip, settings.segment_sec)
    raise ValueError(f"no sampler {settings.sampler}")


def read_texts(texts: DataFrame, settings: Settings) -> DataFrame:
    """Recognised lines that count: scored high enough, not blank, no logo."""
    out = filters.not_blank(filters.by_score(texts, settings.drop_score))
    return filters.not_logo(out) if settings.skip_logos else out


def texts_to_segments(texts: DataFrame, settings: Settings | None = None) -> DataFrame:
    settings = settings or Settings()
    return folds.track(read_texts(texts, settings), settings.overlap, settings.alike)


def lines_read(pictures: DataFrame, width, height, detector: Callable, recognizer: Callable, settings: Settings) -> DataFrame:
    """(…, image) -> (…, lines array<struct<line_idx, text, score, elapse, box>>), without the picture.

    A picture's boxes are filtered by size and region, merged to lines and read in its own row: each model is called once, and nothing is
    shuffled, joined or exploded.
    """
    keys = [c for c in pictures.columns if c != "image"]
    roi = None if settings.roi is None else G.parse_roi(F.lit(settings.roi))
    boxes = F.transform("__found", lambda b: G.bounding_box(b["quad"]))
    boxes = F.filter(boxes, lambda b: G.size_fits(b, width, height, settings.size_least, settings.size_most) & G.in_roi(b, roi, width, height))
    rows = pictures.withColumn("__found", models.found(F.col("image"), detector))
    rows = rows.withColumn("__boxes", models.apart(boxes)).withColumn("__lines", models.lines_of(F.col("__boxes"), settings.line_y, settings.line_gap))
    rows = rows.withColumn("__quads", models.apart(F.transform("__lines", G.quad_of)))
    rows = rows.withColumn("__texts", models.texts_of(F.col("image"), F.col("__quads"), recognizer))
    item = lambda t, i: F.struct(i.alias("line_idx"), t["text"].alias("text"), t["score"].alias("score"), t["elapse"].alias("elapse"), F.get("__lines", i).alias("box"))
    return rows.select(*keys, F.transform("__texts", item).alias("lines"))


def frames_to_segments(frames: DataFrame, width, height, detector: Callable = models.StubModel, recognizer: Callable = models.StubModel, settings: Settings | None = None) -> DataFrame:
    """(video_id, frame_idx, ts, image) -> segments. The only shuffle is that of texts by video."""
    settings, keys = settings or Settings(), ["video_id", "frame_idx", "ts"]
    rows = lines_read(frames.select(*keys, "image"), width, height, detector, recognizer, settings).select(*keys, F.inline("lines"))
    return texts_to_segments(rows, settings)


def images_to_texts(images: DataFrame, width, height, detector: Callable = models.StubModel, recognizer: Callable = models.StubModel, settings: Settings | None = None) -> DataFrame:
    """(image_idx, filename, image) -> (image_idx, filename, texts) from top to bottom, an empty array for a picture without any."""
    settings = settings or Settings(roi=None, skip_logos=False)
    rows = lines_read(images, width, height, detector, recognizer, settings)
    counts = lambda t: (t["score"] >= settings.drop_score) & ~T.is_blank(t["text"]) & (~T.is_logo(t["text"]) if settings.skip_logos else F.lit(True))
    sortable = F.transform(F.filter("lines", counts), lambda t: F.struct(t["box"]["y"].alias("y"), t["line_idx"].alias("i"), F.struct(*[t[c].alias(c) for c in ("text", "score", "box")]).alias("item")))
    return rows.withColumn("texts", F.transform(F.array_sort(sortable), lambda t: t["item"])).drop("lines")


def end_to_end(images: DataFrame, detector: Callable = models.StubModel, recognizer: Callable = models.StubModel, drop_score: float = 0.5) -> DataFrame:
    """(file, page, image) -> (file, page, items): quads in reading order, without size, region or line steps. A picture stays one row."""
    rows = images.withColumn("__found", models.found(F.col("image"), detector))
    rows = rows.withColumn("__texts", models.texts_of(F.col("image"), F.col("__found.quad"), recognizer))
    item = lambda t, i: F.struct(t["text"].alias("transcription"), F.get("__found", i)["quad"].alias("points"), t["score"].alias("score"))
    items = F.filter(F.transform("__texts", item), lambda t: t["score"] >= drop_score)
    rows = rows.select("file", "page", items.alias("items"))
    rows = rows.withColumn("__first", models.apart(F.transform("items", lambda t: t["points"][0]))).withColumn("__order", models.reading_places(F.col("__first")))
    return rows.select("file", "page", F.transform("__order", lambda i: F.get("items", i)).alias("items"))
