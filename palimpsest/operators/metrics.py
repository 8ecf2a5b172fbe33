"""Recognition and latency metrics as conditional sums: partial aggregates in map tasks, one row or one per bucket after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

SMOOTH = 1e-5


def compared(pairs: DataFrame, ignore_space: bool = True, filtered: bool = True, lower: bool = True) -> DataFrame:
    """pairs with the staged comparisons of (pred, target): real, lower, space, space_lower, symbol, final, dist and lengths."""
    p, t = F.col("pred"), F.col("target")
    out = {"real": p == t, "lower": F.lower(p) == F.lower(t)}
    if ignore_space:
        p, t = T.without_spaces(p), T.without_spaces(t)
    out |= {"space": p == t, "space_lower": F.lower(p) == F.lower(t)}
    if filtered:
        p, t = T.alphanumeric(p), T.alphanumeric(t)
    out["symbol"] = p == t
    if lower:
        p, t = F.lower(p), F.lower(t)
    out |= {"final": p == t, "dist": T.edit_distance(p, t), "len": F.length(t)}
    return pairs.withColumns(out)


def _share(hit: Column, n: Column) -> Column:
    return F.count_if(hit) / (n + F.lit(SMOOTH))


def accuracies(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All accuracies and the mean of one less the edit distance, from compared() rows."""
    n = F.count(F.lit(1))
    named = {"acc": "final", "acc_real": "real", "acc_lower": "lower", "acc_ignore_space": "space", "acc_ignore_space_lower": "space_lower", "acc_ignore_space_symbol": "symbol"}
    aggs = [_share(F.col(c), n).alias(k) for k, c in named.items()]
    return rows.groupBy(*(by or [])).agg(*aggs, (F.lit(1.0) - F.sum("dist") / (n + F.lit(SMOOTH))).alias("norm_edit_dis"), n.alias("all_num"))


def length_bucket(most: int = 25) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(most), F.col("len")) - 1)


def ratio_bucket(most: int = 4) -> Column:
    return F.when(F.col("ratio") < most, F.col("ratio") - 1).otherwise(most - 1)


def by_bucket(spark: SparkSession, rows: DataFrame, bucket: Column, size: int) -> DataFrame:
    """(bucket, num, correct, dist) for every bucket from 0; those without rows have zeros."""
    got = rows.groupBy(bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("num"), F.count_if("final").alias("correct"), F.sum("dist").alias("dist"))
    every = spark.range(size).select(F.col("id").cast("int").alias("bucket"))
    return every.join(got, "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("num", "correct", "dist")])


def long_accuracies(rows: DataFrame) -> DataFrame:
    """Accuracy, prefix, first-and-last-character and length accuracies of long texts."""
    p, t, n = T.without_spaces(F.col("pred")), T.without_spaces(F.col("target")), F.count(F.lit(1))
    ends = (F.length(p) >= 1) & (F.length(t) >= 1) & (F.substring(p, 1, 1) == F.substring(t, 1, 1)) & (F.substring(p, -1, 1) == F.substring(t, -1, 1))
    named = {"acc": p == t, "acc_slice": F.startswith(t, p), "f_l_acc": ends, "len_acc": F.length(p) == F.length(t)}
    return rows.agg(*[_share(c, n).alias(k) for k, c in named.items()], (F.lit(1.0) - F.sum(T.edit_distance(p, t)) / (n + F.lit(SMOOTH))).alias("norm_edit_dis"))


def long_by_length(spark: SparkSession, rows: DataFrame, size: int = 201) -> DataFrame:
    """(bucket, num, acc, norm_edit_dis) for each length of the target from 0 to size - 1; longer targets are an error of the data and left out."""
    p, t = T.without_spaces(F.col("pred")), T.without_spaces(F.col("target"))
    got = by_bucket(spark, rows.select(F.length(t).alias("len"), (p == t).alias("final"), T.edit_distance(p, t).alias("dist")), F.col("len"), size)
    n = F.col("num") + F.lit(SMOOTH)
    return got.select("bucket", "num", (F.col("correct") / n).alias("acc"), (F.lit(1.0) - F.col("dist") / n).alias("norm_edit_dis"))


def by_head(rows: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """One row with acc and norm_edit_dis of each head under its prefix, from compared() rows with a column head."""
    n = lambda h: F.count_if(F.col("head") == h)
    out = []
    for head, prefix in prefixes.items():
        own = F.col("head") == head
        out.append((F.count_if(own & F.col("final")) / (n(head) + F.lit(SMOOTH))).alias(f"{prefix}acc"))
        out.append((F.lit(1.0) - F.sum(F.when(own, F.col("dist")).otherwise(0.0)) / (n(head) + F.lit(SMOOTH))).alias(f"{prefix}norm_edit_dis"))
    return rows.agg(*out)


def latency_by_length(rows: DataFrame, most: int = 25) -> DataFrame:
    """(bucket, n, avg_time) of (text, elapse), by length up to most - 1."""
    return rows.groupBy(F.least(F.lit(most - 1), F.length("text")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("elapse").alias("avg_time"))


def latency_means(rows: DataFrame, most: int = 25) -> DataFrame:
    """Mean of the buckets' means, and the mean over all rows."""
    return latency_by_length(rows, most).agg(F.avg("avg_time").alias("avg"), (F.sum(F.col("avg_time") * F.col("n")) / F.sum("n")).alias("weighted_avg"))


def mean_time(rows: DataFrame, by: list[str]) -> DataFrame:
    """Total and mean of elapse; 0 where there is none."""
    return rows.groupBy(*by).agg(F.coalesce(F.sum("elapse"), F.lit(0.0)).alias("total"), F.coalesce(F.try_divide(F.sum("elapse"), F.count("elapse")), F.lit(0.0)).alias("mean"))


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)


def rolling_median(rows: DataFrame, value: str, by: list[str], order: list[str], size: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - size, 0)
    return rows.withColumn("median", F.round(F.percentile(F.col(value), F.lit(0.5)).over(w), 6))
