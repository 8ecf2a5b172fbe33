"""What several operators of this subpackage share: written intermediate tables, bounded broadcasts, ranks without a single task."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Where intermediate tables go if a session on one machine names no shared folder, as in tests.
LOCAL_DIR = "/tmp/checkpoints"
#: A side is broadcast only if it has been counted and has at most this many rows of fixed width.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, LOCAL_DIR on a local master, else an error:
    a folder of one machine would be another one on each executor."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or LOCAL_DIR).rstrip("/")


def _files(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _files(spark, path)
    return fs.exists(at)


def until_exit(spark: SparkSession, path: str) -> str:
    """The path, to be deleted when the application ends if it is still there."""
    fs, at = _files(spark, path)
    fs.deleteOnExit(at)
    return path


class Written:
    """A table written to the shared folder: .df reads it, .drop() deletes its files; what a result still reads goes when the
    application ends."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/palimpsest-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        until_exit(self.spark, self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def add(self, df: DataFrame) -> None:
        """More rows; .df reads them too."""
        df.write.mode("append").parquet(self.path)
        self.df = self.spark.read.schema(self.df.schema).parquet(self.path)

    def drop(self) -> None:
        fs, at = _files(self.spark, self.path)
        fs.delete(at, True)


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a written table; it outlives lost executors and is read, not computed, by each later use."""
    return Written(df).df


def bounded(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a written, fixed-width table for broadcast if its counted size is within the bound; else the planner joins by shuffle."""
    return F.broadcast(small) if small.count() <= rows else small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def ranked(df: DataFrame, group: list[str], order: list[Column], out: str, buckets: int = 1024) -> DataFrame:
    """Adds `out`: 0, 1, ... within each group, without one task per group.

    Rows of a group fall into `buckets` by a hash of all `order` columns; a row's rank is the count of rows in the group's earlier
    buckets (from a table of at most `buckets` rows per group) plus its number within its bucket. A group of any size is
    numbered by up to `buckets` tasks. The order is by hash, then by `order`; ties are between equal keys only.
    """
    b, n, before = f"__{out}_b", f"__{out}_n", f"__{out}_before"
    df = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    per = df.groupBy(*group, b).agg(F.count(F.lit(1)).alias(n))
    per = per.withColumn(before, F.sum(n).over(Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)))
    per = per.select(*[F.col(c).alias(f"__r_{c}") for c in group], F.col(b).alias(f"__r_{b}"), F.coalesce(before, F.lit(0)).alias(before))
    df = df.withColumn(n, F.row_number().over(Window.partitionBy(*group, b).orderBy(*order)))
    on = df[b] == per[f"__r_{b}"]
    for c in group:
        on = on & same(df[c], per[f"__r_{c}"])
    return df.join(per, on).withColumn(out, F.col(before) + F.col(n) - 1).drop(b, n, before, f"__r_{b}", *[f"__r_{c}" for c in group])


def survivors(docs: DataFrame, groups: DataFrame, text_hash: Column) -> DataFrame:
    """One row of docs per label of groups (doc_id, h, label): that of the smallest doc_id, then of the smallest h = text_hash.

    A label follows from the text alone, so (doc_id, h) names a row, or several that are alike, of one label only. Null doc_ids
    come last. Only rows that repeat are brought together to drop the others.
    """
    per = groups.groupBy("label", "doc_id", "h").agg(F.count(F.lit(1)).alias("n"))
    least = per.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "n")).alias("k"))
    keep = written(least.select(F.col("k.doc_id").alias("__keep"), F.col("k.h").alias("__h"), F.col("k.n").alias("__n")))
    rows = docs.withColumn("__text", text_hash)
    kept = rows.join(keep, same(rows["doc_id"], keep["__keep"]) & (rows["__text"] == keep["__h"])).drop("__text", "__keep")
    out = kept.where("__n = 1")
    if not keep.where("__n > 1").isEmpty():
        more = kept.where("__n > 1").withColumn("__id", F.col("doc_id"))
        out = out.unionByName(more.dropDuplicates(["__id", "__h"]).drop("__id"))
    return out.drop("__h", "__n")
