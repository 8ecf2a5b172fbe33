"""Images, charsets and labels from files, with Spark's readers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ..functions import containers
from ..functions import text as T

DEFAULT_CHARSET = "0123456789abcdefghijklmnopqrstuvwxyz"


def images(spark: SparkSession, folder: str, recursive: bool = True, pattern: str = r"(?i)\.(png|jpg|jpeg|bmp|tiff|webp)$", most: int = 100_000) -> DataFrame:
    """(image_idx, path, filename, length, content): image_idx counts files in the order of their paths; the content is opaque until a model
    stage reads it. The numbers come from a scan of the paths alone; with up to `most` files they are broadcast to where contents
    are read, beyond that both are shuffled by path. An empty folder gives no rows."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).where(F.col("path").rlike(pattern))
    paths = rows.select(F.col("path").alias("__path"), (F.row_number().over(Window.orderBy("path")) - 1).alias("image_idx"))
    paths = F.broadcast(paths) if paths.count() <= most else paths
    return rows.join(paths, F.col("path") == F.col("__path")).select("image_idx", "path", T.file_name(F.col("path")).alias("filename"), "length", "content")


def image_list(spark: SparkSession, path: str) -> DataFrame:
    """(image_idx, path) of a picture or of the pictures right in a folder, by path; an error if there are none."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).where(F.col("path").rlike(r"(?i)(jpg|bmp|png|jpeg|rgb|tif|tiff|gif|pdf)$"))
    rows = rows.select((F.row_number().over(Window.orderBy("path")) - 1).alias("image_idx"), "path")
    if rows.isEmpty():
        raise FileNotFoundError(f"no picture in {path}")
    return rows


def pictures(spark: SparkSession, folder: str, pattern: str = r"(?i)\.(png|jpg|jpeg|bmp|gif|tif|tiff)$") -> DataFrame:
    """(path, filename, image): Spark's image struct of each file, a GIF's first frame; null where the file can't be decoded."""
    rows = spark.read.format("image").option("recursiveFileLookup", "true").load(folder).where(F.col("image.origin").rlike(pattern))
    path = F.col("image.origin")
    return rows.select(path.alias("path"), T.file_name(path).alias("filename"), F.when(F.col("image.height") > 0, F.col("image")).alias("image"))


def videos(spark: SparkSession, folder: str) -> DataFrame:
    """(video_id, path, fps, total_frames, width, height) of the MP4, MOV and AVI files below a folder, from their headers; files without
    a readable video track give no row. Files are read whole by Spark's reader, one at a time in a task."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("path").rlike(r"(?i)\.(mp4|m4v|mov|avi)$"))
    rows = rows.select(T.file_name(F.col("path")).alias("video_id"), "path", _headers(F.col("content")).alias("v"))
    return rows.where("v is not null").select("video_id", "path", "v.*")


@F.arrow_udf(StructType([StructField("fps", DoubleType()), StructField("total_frames", LongType()), StructField("width", IntegerType()), StructField("height", IntegerType())]))
def _headers(contents: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("fps", pa.float64()), ("total_frames", pa.int64()), ("width", pa.int32()), ("height", pa.int32())])
    for batch in contents:
        yield pa.array([containers.video_header(x.as_py()) if x.is_valid else None for x in batch], kind)


def matrices(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, values array<array<double>>) of the real matrices in the MAT files (version 5) below a folder, cells included."""

    @F.arrow_udf("array<struct<name:string,values:array<array<double>>>>")
    def read(contents: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("name", pa.string()), ("values", pa.list_(pa.list_(pa.float64())))]))
        for batch in contents:
            yield pa.array([[{"name": n, "values": v.tolist()} for n, v in containers.matrices(x.as_py())] if x.is_valid else [] for x in batch], kind)

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("path").rlike(r"(?i)\.mat$"))
    return rows.select("path", F.explode(read(F.col("content"))).alias("m")).select("path", "m.*")


def listed(spark: SparkSession, text: str) -> DataFrame:
    """(image_idx, path) of a comma-separated list."""
    return spark.sql("SELECT :t AS t", args={"t": text}).select(F.posexplode(F.transform(F.split("t", ","), lambda x: F.trim(x))).alias("image_idx", "path")).where("path <> ''")


def charset(spark: SparkSession, path: str | None = None, space: bool = False) -> list[str]:
    """Symbols in file order, one a line; digits and small letters without a file. Read whole: a charset has thousands at most."""
    if path is None:
        found = list(DEFAULT_CHARSET)
    else:
        body = spark.read.text(path, wholetext=True).first()[0]
        found = [x.rstrip("\r") for x in body.removesuffix("\n").split("\n")]
    return [*found, " "] if space else found


def charset_table(spark: SparkSession, symbols: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(symbols)), "id int, symbol string")


def recognition_labels(lines: DataFrame) -> DataFrame:
    """Lines `image, "label"` of column value -> (img_path, label): spaces and quotes removed."""
    parts = F.split(T.without_spaces(F.col("value")), ",")
    return lines.select(F.get(parts, F.lit(0)).alias("img_path"), F.replace(F.get(parts, F.lit(1)), F.lit('"'), F.lit("")).alias("label"))


def detection_labels(files: DataFrame, root: str) -> DataFrame:
    """(path, value whole text) of ICDAR label files -> (img_path, label): a JSON array of transcriptions and four points a line."""
    rows = files.select("path", F.posexplode(F.split(F.regexp_replace(F.col("value"), "﻿", ""), "\r?\n")).alias("n", "line")).where("line <> ''")
    parts = F.split("line", ",")
    point = lambda i: F.transform(F.slice(parts, 2 * i + 1, 2), lambda x: F.trim(x).cast("int"))
    item = F.struct(F.get(parts, F.lit(8)).alias("transcription"), F.array(*[point(i) for i in range(4)]).alias("points"))
    rows = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("n", item.alias("item")))).alias("l"))
    name = F.regexp_extract(T.file_name(F.col("path")), r"^.{3}(.*).{4}$", 1)
    return rows.select(F.concat(F.lit(root.rstrip("/") + "/"), name, F.lit(".jpg")).alias("img_path"), F.to_json(F.transform("l", lambda x: x["item"])).alias("label"))


def entity_labels(lines: DataFrame, order: str = "n") -> DataFrame:
    """(n, value) -> (id, label): O, then B- and I- of each label in order; labels for other things are left out."""
    rows = lines.where(~F.upper(F.trim("value")).isin("OTHER", "OTHERS", "IGNORE")).agg(F.array_sort(F.collect_list(F.struct(order, F.upper(F.trim("value")).alias("v")))).alias("l"))
    labels = F.concat(F.array(F.lit("O")), F.flatten(F.transform("l", lambda x: F.array(F.concat(F.lit("B-"), x["v"]), F.concat(F.lit("I-"), x["v"])))))
    return rows.select(F.posexplode(labels).alias("id", "label"))
