"""Exact Jaccard similarity of word shingles for the near-dedup of simhash.py: bands of least hashes propose what fingerprints of 64 bits
cannot (texts of similarity 0.8 differ in about ten), whole sets decide, components group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Written, bounded, written

#: 20 bands of 4 least values: a pair of similarity 0.8 shares none of them with probability 0.00003, one of 0.9 with 5e-10.
BANDS, ROWS = 20, 4
#: Shingles of a text that are permuted at a time.
BLOCK = 512
#: Texts of a group of candidates that come into one task; a larger group goes in pairs of halves of this.
MOST = 1000
_RNG = np.random.default_rng(42)
_ODD, _XOR = _RNG.integers(0, 2**63, (BANDS * ROWS, 1), np.uint64) * 2 + 1, _RNG.integers(0, 2**63, (BANDS * ROWS, 1), np.uint64) * 2


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The set of a text's shingles as sorted XXH64 hashes; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode().lower().split()  # as in simhash: A-Z only, and only \x20 and \x09-\x0D separate
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    last = ends[min(shingle, len(words)) - 1 :]
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(joined[a:b]) for a, b in zip((ends - size)[: len(last)].tolist(), last.tolist(), strict=True)), np.uint64, len(last)))


def bands(h: np.ndarray) -> np.ndarray:
    """A signed 64-bit key for each band of the least values of a text's shingles under BANDS * ROWS permutations."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(h), BLOCK):
        v = (h[None, i : i + BLOCK] ^ _XOR) * _ODD
        least = np.minimum(least, (v ^ (v >> np.uint64(29))).min(axis=1))
    raw = least.tobytes()
    step = 8 * ROWS
    return np.array([xxhash.xxh64_intdigest(raw[i * step : (i + 1) * step], i) for i in range(BANDS)], np.uint64).view(np.int64)


def fingerprint(h: np.ndarray) -> int:
    """The SimHash of a set of shingles: bit set if set in over half of the hashes; 0 without any."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 32 * BLOCK):
        counts += np.unpackbits(h[i : i + 32 * BLOCK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h)).view("<i8")[0])


def signatures(shingle: int):
    @F.arrow_udf("struct<fp:long,bands:array<long>>")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            flat, prints = np.empty((len(batch), BANDS), np.int64), np.empty(len(batch), np.int64)
            for i, x in enumerate(batch):
                h = shingles(x.as_py(), shingle)
                flat[i], prints[i] = bands(h), fingerprint(h)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * BANDS), pa.array(flat.ravel()))
            yield pa.StructArray.from_arrays([pa.array(prints), lists], ["fp", "bands"])

    return of


def forest(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of places whose components are those of all pairs of sets with 100 |A and B| >= percent |A or B|; two empty sets are alike."""
    size = np.array([len(x) for x in sets])
    empty = np.flatnonzero(size == 0)
    out = [(int(empty[0]), int(i)) for i in empty[1:]]
    left = np.flatnonzero(size)
    values, ids = np.unique(np.concatenate([sets[i] for i in left]) if len(left) else np.empty(0, np.uint64), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size[left])])
    own = {int(i): ids[start[k] : start[k + 1]] for k, i in enumerate(left)}
    mark = np.zeros(len(values), bool)
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            u = queue.pop()
            fits = left[(100 * size[left] >= percent * size[u]) & (100 * size[u] >= percent * size[left])]
            if not len(fits):
                continue
            mark[own[u]] = True
            both = np.array([np.count_nonzero(mark[own[int(i)]]) for i in fits])
            mark[own[u]] = False
            near = fits[100 * both >= percent * (size[u] + size[fits] - both)]
            out.extend((u, int(i)) for i in near)
            queue.extend(near.tolist())
            left = left[~np.isin(left, near)]
    return out


def _verifier(shingle: int, percent: int):
    """mapInArrow function over (group, node, text) rows sorted by group within the partition: the verified edges of each group.
    Holds the shingles of one group and one Arrow batch at a time."""

    def edges(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        found = forest(sets, percent)
        return pa.RecordBatch.from_arrays([pa.array([nodes[p[k]] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets = None, [], []
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                group, node, text = (x.as_py() for x in row)
                if group != now:
                    if len(nodes) > 1:
                        yield edges(nodes, sets)
                    now, nodes, sets = group, [], []
                nodes.append(node)
                sets.append(shingles(text, shingle))
        if len(nodes) > 1:
            yield edges(nodes, sets)

    return verify


def node() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def labels(docs: DataFrame, nodes: DataFrame, proposed: DataFrame, shingle: int, percent: int, most: int) -> DataFrame:
    """(node, bands) distinct texts and (a, b) edges between nodes -> (node, label) of those near to another.

    Candidates share a band or a proposed edge, directly or through others; links are decided on whole sets.
    """
    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a <> most").drop("most")
    loose = Written(keys.join(shared, "key").where("node <> a").select("a", F.col("node").alias("b")).union(proposed).distinct())
    groups = Written(components(loose.df))
    loose.drop()
    # Groups of candidates over `most` texts: every two of its parts meet in a task, so every pair does.
    parts = F.ceil(F.col("n") * 2 / most).cast("int")
    size = groups.df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.col("label").alias("__label"), F.when(F.col("n") > most, parts).otherwise(1).alias("parts"))
    member = groups.df.join(size, groups.df["label"] == size["__label"]).select(F.col("node").alias("__node"), "label", "parts")
    member = bounded(written(member))
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts"))
    texts = docs.select(node().alias("node"), "text")
    texts = texts.join(member, texts["node"] == member["__node"]).dropDuplicates(["node"])
    texts = texts.withColumn("p", part).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    texts = texts.select(F.xxhash64("label", F.least("p", "q"), F.greatest("p", "q")).alias("group"), "node", "text")
    exact = Written(texts.repartition("group").sortWithinPartitions("group", "node").mapInArrow(_verifier(shingle, percent), "a long, b long"))
    groups.drop()
    out = written(components(exact.df))
    exact.drop()
    return out
