"""Results as JSON, subtitles, CSV and TSV, and their summaries."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def _sorted_lines(texts: Column) -> Column:
    """A segment's texts from top to bottom; the earlier of equals first."""
    keyed = F.transform(texts, lambda t, i: F.struct(t["box"]["y"].alias("y"), i.alias("i"), t["text"].alias("text")))
    return F.transform(F.array_sort(keyed), lambda k: k["text"])


def cues(segments: DataFrame, least: float = 1.0, extension: float = 1.0) -> DataFrame:
    """segments -> (video_id, idx, start, end, text): each `least` seconds at least, then longer by `extension`; lines joined by ` | `.
    Numbered per video, which is one subtitle file."""
    end = F.when(F.col("end_time") - F.col("start_time") < least, F.col("start_time") + least).otherwise(F.col("end_time"))
    rows = segments.select("video_id", "segment_id", F.col("start_time").alias("start"), (F.coalesce(end, F.col("start_time") + least) + extension).alias("end"), F.array_join(_sorted_lines(F.col("texts")), " | ").alias("text"))
    idx = F.row_number().over(Window.partitionBy("video_id").orderBy("start", "segment_id"))
    return rows.select("video_id", idx.alias("idx"), "start", "end", "text")


def srt_blocks(cue_rows: DataFrame) -> DataFrame:
    """cues -> (video_id, idx, block)."""
    times = F.concat(T.srt_time(F.col("start")), F.lit(" --> "), T.srt_time(F.col("end")))
    return cue_rows.select("video_id", "idx", F.concat_ws("\n", F.col("idx").cast("string"), times, "text").alias("block"))


def write_srt(segments: DataFrame, path: str) -> None:
    """A folder of text files by video, in cue order; nothing for a video without segments."""
    blocks = srt_blocks(cues(segments)).repartition("video_id").sortWithinPartitions("video_id", "idx")
    blocks.select("video_id", F.concat("block", F.lit("\n")).alias("value")).write.partitionBy("video_id").text(path)


def json_results(segments: DataFrame) -> DataFrame:
    """One JSON text per segment; boxes as four numbers."""
    texts = F.transform("texts", lambda t: F.struct(t["text"].alias("text"), t["score"].alias("score"), F.array(*[t["box"][k] for k in "xywh"]).alias("box")))
    return segments.select("video_id", "segment_id", F.to_json(F.struct("start_time", "end_time", "timestamp", texts.alias("texts"))).alias("json"))


def write_json(segments: DataFrame, path: str) -> None:
    json_results(segments).select(F.col("json").alias("value")).write.text(path)


def write_json_file(segments: DataFrame, path: str) -> int:
    """One video's segments as one pretty-printed local file, row by row."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for row in json_results(segments).orderBy("segment_id").toLocalIterator():
            f.write((",\n" if n else "\n") + json.dumps(json.loads(row["json"]), ensure_ascii=False, indent=2))
            n += 1
        f.write("\n]\n")
    return n


def recognition_csv(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("filename").alias("image_file_name"), F.col("text").alias("ocr"), "score")


def detection_tsv(boxes: DataFrame, order: str = "box_idx") -> DataFrame:
    """(file, order, quad) -> (line): the file, a tab, and its boxes' points as JSON."""
    item = F.struct(order, F.struct(F.transform("quad", lambda p: F.array(p["x"].cast("int"), p["y"].cast("int"))).alias("points")).alias("item"))
    rows = boxes.groupBy("file").agg(F.array_sort(F.collect_list(item)).alias("l"))
    return rows.select(F.concat_ws("\t", "file", F.to_json(F.transform("l", lambda x: x["item"]))).alias("line"))


def recognition_tsv(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat(F.col("file"), F.lit("\t"), "text", F.lit(" | "), F.col("score").cast("string")).alias("line"))


def end_to_end_tsv(rows: DataFrame, keep_empty: bool = False) -> DataFrame:
    """(file, page or null, items) -> (line). A single image without text is left out unless `keep_empty`; pages always stay."""
    name = F.concat(T.stem(F.col("file")), F.coalesce(F.concat(F.lit("_"), F.col("page").cast("string")), F.lit("")))
    rows = rows if keep_empty else rows.where((F.size("items") > 0) | F.col("page").isNotNull())
    return rows.select(F.concat_ws("\t", name, F.to_json("items")).alias("line"))


def segment_summary(segments: DataFrame) -> DataFrame:
    return segments.agg(F.count(F.lit(1)).alias("segments"), F.coalesce(F.sum(F.size("texts")), F.lit(0)).alias("texts"))


def image_summary(images: DataFrame) -> DataFrame:
    """(images, with_text, percent, boxes) of (…, texts)."""
    n, some = F.count(F.lit(1)), F.count_if(F.size("texts") > 0)
    return images.agg(n.alias("images"), some.alias("with_text"), F.coalesce(F.try_divide(some * 100.0, n), F.lit(0.0)).alias("percent"), F.coalesce(F.sum(F.size("texts")), F.lit(0)).alias("boxes"))


def first_samples(images: DataFrame, n: int = 3, order: str = "image_idx") -> DataFrame:
    return images.where(F.size("texts") > 0).orderBy(order).limit(n)
