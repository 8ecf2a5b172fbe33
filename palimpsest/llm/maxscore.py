"""Exact top-k inner products by MaxScore over per-dimension postings, shard by shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Written

#: Queries of a broadcast block; rows of a shard's posting block; dimensions probed between two checks.
QUERIES, ROWS, PROBES = 8_192, 4_096, 8
_LONG = np.iinfo(np.int64)


def _dense(vectors: list, dims: int) -> np.ndarray:
    """Rows padded with zeros to `dims`: float64 if exact for any inner product below, else Python integers."""
    out = np.zeros((len(vectors), dims), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


class Shard:
    """The k best of the rows seen so far for each query: greatest score, then least id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, queries, k
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        top = int(np.abs(self.q.astype(float)).max(initial=0)) * int(np.abs(rows.astype(float)).max(initial=0)) * max(rows.shape[1], 1)
        kind = np.float64 if top < 2**53 else object
        postings, q = np.ascontiguousarray(rows.T).astype(kind), self.q.astype(kind)
        high, low = postings.max(axis=1), postings.min(axis=1)
        for i in range(len(q)):
            self._one(i, q[i], ids, postings, high, low)

    def _one(self, i: int, q: np.ndarray, ids: np.ndarray, postings: np.ndarray, high: np.ndarray, low: np.ndarray) -> None:
        bound = np.maximum(q * high, q * low)  # of each term's score in this block
        order = np.argsort(-bound, kind="stable")
        rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])  # of the terms from here on
        have, at = self.best[i]
        full = len(have) >= self.k
        theta = have[-1] if full else None
        if full and rest[0] < theta:
            return
        # essential terms: without them no row can reach theta, not even at the bounds of all the others
        essential = int(np.argmax(rest < theta)) if full and (rest < theta).any() else len(order)
        score = q[order[:essential]] @ postings[order[:essential]] if essential else np.zeros(len(ids), q.dtype)
        alive = np.arange(len(ids))
        for j in range(essential, len(order), PROBES):
            fit = score + rest[j] >= theta
            alive, score = alive[fit], score[fit]
            if not len(alive):
                return
            probe = order[j : j + PROBES]
            score = score + q[probe] @ postings[np.ix_(probe, alive)]
        if score.dtype == object:
            score = np.array([min(max(int(x), _LONG.min), _LONG.max) for x in score], np.int64)
        s, v = np.concatenate([have, score.astype(np.int64)]), np.concatenate([at, ids[alive]])
        if len(s) > 4 * self.k:  # all of the k-th score stay for the tie on ids
            kth = np.partition(s, len(s) - self.k)[len(s) - self.k]
            s, v = s[s >= kth], v[s >= kth]
        pick = np.lexsort((v, -s))[: self.k]
        self.best[i] = s[pick], v[pick]


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<long>): floor(1024 * x) of each component as double; rows that take no part are left out."""
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(good & ~F.coalesce(odd, F.lit(True))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024).cast("long")).alias("v"))


def top_k(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """(vec_id, embedding, ...) -> (query_id, rank, vec_id, score): each query row's k greatest integer inner products.

    `is_query` is a condition on vec_id. Candidates are all rows but the query's own: others with its id are candidates too. Ties go
    to the smaller vec_id. Vectors that are null or hold a null or non-finite component, and rows with a null vec_id, take no part;
    shorter vectors count as padded with zeros; rows that repeat a vec_id are candidates each, and queries each; scores beyond a
    long are the nearest long; an empty table gives an empty result; other columns are not used.

    Queries that are alike in id and vector are searched once, with the number of their rows, so that no id fills a block; they
    are counted, and dealt by hash of both into blocks of about QUERIES. Blocks go one after the other: a block is sent to all tasks,
    every partition of the table is a shard that runs MaxScore and gives k + 1 rows a query, which are merged by query, of which
    one row that is the query itself is left out, and written. The driver holds one block, whatever the number of queries.
    """
    rows = integers(vectors)
    spark = vectors.sparkSession
    queries = Written(rows.where(is_query).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("times")))
    n, most = queries.df.agg(F.count(F.lit(1)), F.max("times")).first()
    dims = rows.agg(F.max(F.size("v"))).first()[0]
    blocks, out = -(-n // QUERIES), None
    for b in range(blocks):
        block = queries.df.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b).toArrow()
        if not block.num_rows:
            continue
        sent = spark.sparkContext.broadcast((block["vec_id"].to_numpy(), _dense(block["v"].to_pylist(), dims), block["times"].to_numpy()))
        got = _merged(rows.mapInArrow(_search(sent, k + 1, dims), "q int, times long, query_id long, vec_id long, score long, own long"), k)
        if out is None:
            out = Written(got)
        else:
            out.add(got)
        sent.destroy()
    queries.drop()
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = out.df
    if most > 1:
        found = found.withColumn("row", F.explode(F.expr("sequence(1L, times)")))
    return found.select("query_id", "rank", "vec_id", "score")


def _merged(found: DataFrame, k: int) -> DataFrame:
    """Shards' rows of a block -> (times, query_id, rank, vec_id, score): the k best of each query, without one row of its id and its own score."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("place", place).where(F.col("place") <= k + 1)
    itself = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    at = F.min(F.when(itself, F.col("place"))).over(Window.partitionBy("q"))
    found = found.withColumn("at", F.coalesce(at, F.lit(k + 1))).where("place <> at")
    return found.select("times", "query_id", F.when(F.col("place") > F.col("at"), F.col("place") - 1).otherwise(F.col("place")).alias("rank"), "vec_id", "score")


def _search(sent, k: int, dims: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, times = sent.value
        shard = Shard(ids, q, k)
        own = np.array([min(sum(x * x for x in row), _LONG.max) for row in q.tolist()], np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                lists = part.column(1)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                rows = flat.reshape(-1, dims) if (sizes == dims).all() and dims else _dense(lists.to_pylist(), dims)
                shard.add(part.column(0).to_numpy(), rows)
        n = [len(s) for s, _ in shard.best]
        if sum(n):
            who = np.repeat(np.arange(len(n)), n).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(who), pa.array(times[who]), pa.array(ids[who]), pa.array(np.concatenate([v for _, v in shard.best])), pa.array(np.concatenate([s for s, _ in shard.best])), pa.array(own[who])],
                ["q", "times", "query_id", "vec_id", "score", "own"],
            )

    return search
