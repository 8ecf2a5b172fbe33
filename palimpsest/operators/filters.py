"""Row filters. Those on sizes and regions belong between detection and recognition, where they spare model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T


def by_size(boxes: DataFrame, width, height, least=(0.01, 0.01), most=(0.9, 0.15), box: str = "box") -> DataFrame:
    return boxes.where(G.size_fits(F.col(box), width, height, least, most))


def by_roi(boxes: DataFrame, roi: str | None, width, height, box: str = "box") -> DataFrame:
    """Keeps boxes wholly inside 'x1,y1,x2,y2' (shares or per cent); all if it is no such text."""
    return boxes if roi is None else boxes.where(G.in_roi(F.col(box), G.parse_roi(F.lit(roi)), width, height))


def by_score(texts: DataFrame, least: float = 0.9) -> DataFrame:
    return texts.where(F.col("score") >= least)


def not_blank(texts: DataFrame) -> DataFrame:
    return texts.where(~T.is_blank(F.col("text")))


def not_logo(texts: DataFrame) -> DataFrame:
    return texts.where(~T.is_logo(F.col("text")))


def first_candidates(boxes: DataFrame, group: list[str], order: str, most: int) -> DataFrame:
    """The first `most` boxes of each group."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(*group).orderBy(order))
    return boxes.withColumn("__n", n).where(F.col("__n") <= most).drop("__n")


def frame_texts(texts: DataFrame, keys=("video_id", "ts"), order: str = "line_idx") -> DataFrame:
    """One row per frame that has a text, with its texts in line order. A frame's texts are few: those of one image."""
    item = F.struct(order, F.struct("text", "score", "box").alias("item"))
    lists = texts.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("l"))
    return lists.select(*keys, F.transform("l", lambda x: x["item"]).alias("texts"))


def with_all_images(images: DataFrame, texts: DataFrame, key: str = "image_idx") -> DataFrame:
    """Every image with its texts, top to bottom; an empty array where there are none."""
    item = F.struct(F.col("box")["y"].alias("y"), "line_idx", F.struct("text", "score", "box").alias("item"))
    lists = texts.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("l")).select(key, F.transform("l", lambda x: x["item"]).alias("texts"))
    return images.join(lists, key, "left").withColumn("texts", F.coalesce("texts", F.array().cast(lists.schema["texts"].dataType)))


def long_enough(rows: DataFrame, least: int = 2) -> DataFrame:
    """Rows whose decoded text has `least` characters or more; a null text has none."""
    return rows.where(F.length("text") >= least)
