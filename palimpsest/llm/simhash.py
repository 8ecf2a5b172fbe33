"""SimHash near-duplicates: pigeonhole blocks find close fingerprints, Hamming distance verifies them, components group them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import minhash
from .components import components
from .shared import Written, survivors, written

SEED, BITS = 42, 64
#: Shingles of a text that are hashed and counted at a time.
BLOCK = 255 * 256


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The signed 64-bit SimHash of a text: bit set if set in over half of its shingles' XXH64 hashes; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and only \x20 and \x09-\x0D separate
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    last = ends[min(shingle, len(words)) - 1 :]
    n, counts = len(last), np.zeros(BITS, np.int64)
    begin = (ends - size)[:n]
    h = xxhash.xxh64_digest
    for i in range(0, n, BLOCK):  # a text of any length takes the same memory here
        digests = b"".join([h(joined[a:b], SEED) for a, b in zip(begin[i : i + BLOCK].tolist(), last[i : i + BLOCK].tolist(), strict=True)])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        if len(bits) > 255:  # sums of 255 bits fit in a byte
            bits = np.vstack([bits, np.zeros((-len(bits) % 255, BITS), np.uint8)]).reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">i8")[0])


@F.arrow_udf(LongType())
def _fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array([fingerprint(x.as_py()) for x in batch], pa.int64())


def fingerprints(text):
    """Column of fingerprint() of a text column (4-word shingles)."""
    return _fingerprints(text)


def _masks(blocks: int, agree: int) -> list[int]:
    """Bit masks, as signed longs, of each choice of `agree` of `blocks` near-equal blocks of the 64 bits."""
    edge = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:], strict=False)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in (sum(x) for x in combinations(block, agree))]


def _forest(x: np.ndarray, far: int) -> list[tuple[int, np.ndarray]]:
    """Edges (one, several) that span the components of x under Hamming distance <= far; fewer than len(x) in all."""
    out = []
    while len(x) > 1:
        queue, x = [x[0]], x[1:]
        while queue and len(x):
            u = queue.pop()
            near = np.bitwise_count(x ^ u) <= far
            if near.any():
                out.append((u, x[near]))
                queue.extend(x[near])
                x = x[~near]
    return out


def _linker(far: int):
    """mapInArrow function over (key, fp) rows that are sorted by key within the partition: the spanning edges of each key's rows.

    Holds one key's rows and one Arrow batch at a time; keys with more rows than the caller's bound never come here.
    """

    def edges(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
        cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        start, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])
        size = end - start
        two = start[size == 2]
        near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= far
        a, b = [fps[two[near]]], [fps[two[near] + 1]]
        for s, e in zip(start[size > 2], end[size > 2], strict=True):
            for u, several in _forest(fps[s:e], far):
                a.append(np.full(len(several), u))
                b.append(several)
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"]) if len(a) else None

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            at = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if at and (out := edges(keys[:at], fps[:at])):
                yield out
            keys, fps = keys[at:], fps[at:]
        if len(keys) and (out := edges(keys, fps)):
            yield out

    return link


def _midpoints(hot: DataFrame, far: int) -> DataFrame:
    """Edges among the fingerprints of column fp, in a number of rows linear in theirs: two lie within 2r bits of each other just if
    some value lies within r bits of both, so each is tied to the least fingerprint at every value within r = 2 bits of it."""
    assert far == 4, "the radius below is half of 4"
    bit = lambda i: F.when(F.col(i) >= 0, F.expr(f"shiftleft(1L, {i})")).otherwise(F.lit(0))
    z = hot.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("i"))
    z = z.select("fp", "i", F.explode(F.when(F.col("i") < 0, F.sequence(F.lit(-1), F.lit(63))).when(F.col("i") < 63, F.expr("sequence(i + 1, 63)"))).alias("j"))
    z = z.select("fp", F.col("fp").bitwiseXOR(bit("i")).bitwiseXOR(bit("j")).alias("z"))
    least = z.groupBy("z").agg(F.min("fp").alias("a"), F.max("fp").alias("most")).where("a <> most").drop("most")
    return z.join(least, "z").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, far: int = 4, blocks: int = 7, most: int = 20_000) -> DataFrame:
    """(fp) distinct fingerprints -> (a, b) edges whose components are those of all pairs within `far` bits.

    Pigeonhole: of `blocks` blocks of bits, two fingerprints within `far` bits agree on blocks - far, so each fingerprint is keyed
    by every choice of that many (35 keys of 27 bits or more). Within a key the edges only span what is linked; not all pairs are
    emitted. A key with over `most` fingerprints is not brought into one task: its members are linked exactly through midpoints.
    """
    spread = fps.repartition(4 * fps.sparkSession.sparkContext.defaultParallelism, "fp")  # a row becomes 35: few bytes, but much work
    keys = spread.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(_masks(blocks, blocks - far))])).alias("key"))
    hot = written(keys.groupBy("key").count().where(F.col("count") > most).select("key"))
    more = None
    if not hot.isEmpty():
        more = _midpoints(keys.join(hot, "key", "left_semi").select("fp").distinct(), far)
        keys = keys.join(hot, "key", "left_anti")
    out = keys.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(_linker(far), "a long, b long")
    return out.union(more) if more is not None else out


def near_duplicates(docs: DataFrame, far: int = 4, blocks: int = 7, most: int = 20_000) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, fingerprint, component_id), a row per row of docs.

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id reachable over links of `far` bits or fewer.
    Null and empty texts have fingerprint zero and link like any other; texts are taken whole; equal texts and repeated rows fall
    into one component; a null doc_id is never the smallest, and a component of only such rows has component_id null. An empty
    table gives an empty result. Other columns of docs are not used.
    """
    return _grouped(docs, far, blocks, most).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, far: int, blocks: int, most: int, *more: Column) -> DataFrame:
    rows = written(docs.select("doc_id", fingerprints(F.col("text")).alias("fp"), *more))
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    edges = Written(links(fps.select("fp"), far, blocks, most))
    label = components(edges.df)
    edges.drop()
    labelled = fps.join(label, fps["fp"] == label["node"], "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return rows.join(labelled.join(least, "label").select("fp", "label", "component_id"), "fp")


def one_of_each(docs: DataFrame, far: int = 4, blocks: int = 7, most: int = 20_000) -> DataFrame:
    """docs with one row of each near-duplicate component: that of the smallest doc_id (any one of repeated rows); all columns stay.

    Components without any doc_id keep one row too; a doc_id on different texts stands for a row in each one's component. Null and
    empty texts are alike; an empty table gives an empty result.
    """
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    return survivors(docs, _grouped(docs, far, blocks, most, own.alias("h")).select("doc_id", "h", "label"), own)


def one_of_each_alike(docs: DataFrame, shingle: int = 5, percent: int = 80, far: int = 4, blocks: int = 7, most: int = 20_000, group: int = minhash.MOST) -> DataFrame:
    """docs with one row of each component of texts linked by a Jaccard similarity of `percent` or more of their sets of
    `shingle`-word shingles: the row of the smallest doc_id (any one of repeated rows); all columns stay.

    The pigeonhole blocks of 64-bit fingerprints over those shingles propose what is within `far` bits. That is a small part of what
    is of such similarity (README), so bands of least hashes propose the rest; whole sets decide all. Texts without words are
    alike; a text shorter than a shingle is one shingle. A component without any doc_id keeps one row too; a doc_id on different
    texts stands for a row in each one's component; an empty table gives an empty result.
    """
    rows = written(docs.select("doc_id", minhash.node().alias("h"), minhash.signatures(shingle)(F.col("text")).alias("s")).select("doc_id", "h", "s.*"))
    nodes = written(rows.groupBy(F.col("h").alias("node")).agg(F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    prints = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    close = links(prints.select("fp"), far, blocks, most)
    of = lambda c: prints.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node"))
    proposed = close.join(of("a"), "a").join(of("b"), "b").select("a_node", "b_node")
    equal = nodes.join(prints, "fp").where("node <> first").select("first", "node")
    label = minhash.labels(docs, nodes, proposed.union(equal), shingle, percent, group)
    groups = rows.join(label, rows["h"] == label["node"], "left").select("doc_id", "h", F.coalesce("label", "h").alias("label"))
    return survivors(docs, groups, minhash.node())
