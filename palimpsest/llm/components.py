"""Connected components of an edge table, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)"))).first())


def _ordered(pairs: DataFrame, a, b) -> DataFrame:
    return pairs.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a long, b long) edges, any order, repeats and loops allowed -> (node, label): the least node of each component.

    Only nodes with an edge to another node come out. Each step is a map-side-combined minimum and a join by node; the number of
    steps grows with the logarithm of the longest path. Each step's edges are a written table, and the one before is deleted.
    No edge or label reaches the driver, only a count and two checksums per step.
    """
    held = Written(_ordered(edges, F.col("a"), F.col("b")))
    before, now = None, _state(held.df)
    while now != before and now[0]:
        e = held.df
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _ordered(both.where("v > u").join(least, "u"), F.col("v"), F.col("m"))
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        step = Written(_ordered(small.select(F.col("lo").alias("x"), "m").union(small.select(F.col("hi").alias("x"), "m")), F.col("x"), F.col("m")))
        held.drop()
        held, before, now = step, now, _state(step.df)
    stars = held.df
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("label")).union(stars.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())
