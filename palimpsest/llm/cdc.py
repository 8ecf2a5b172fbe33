"""Repeated passages by content-defined chunking: gear rolling hash, digests of variable chunks, runs of repeated chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Written, written

#: Bytes that a cut depends on; least distance of cuts; mean chunk is about 2**CUT_BITS bytes; a longer chunk is cut by length.
GEAR_WINDOW, LEAST, CUT_BITS, MOST = 16, 8, 5, 16_384
#: After this many bytes without a cut, a byte whose hash is the least of the last LULL // 2 ends a chunk too.
LULL = 64
_GEAR = np.random.Generator(np.random.PCG64(2024)).integers(0, 2**32, 256, dtype=np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sorted ends of chunks within the bytes of texts that begin at `starts`, texts' own ends left out.

    The gear hash h = 2h + gear[byte] of the last GEAR_WINDOW bytes, by doubling; a byte ends a chunk if the hash's top bits are
    zero and no such byte came less than LEAST before. A cut depends on GEAR_WINDOW + LEAST bytes, so an insertion moves only the
    cuts near it. The first such bytes of a text hold no cut, as they would see the text before.
    """
    if len(data) < 2:
        return np.empty(0, np.int64)
    h = _GEAR[data]
    step = 1
    while step < GEAR_WINDOW:
        nxt = h.copy()
        nxt[step:] += h[:-step] << np.uint32(step)
        h, step = nxt, step * 2
    at = np.flatnonzero((h >> np.uint32(GEAR_WINDOW - CUT_BITS)) & np.uint32(2**CUT_BITS - 1) == 0)
    at = at[np.concatenate([[True], np.diff(at) >= LEAST])] if len(at) else at
    at = np.union1d(at, _lulls(h & np.uint32(2**GEAR_WINDOW - 1), np.concatenate([at, starts])))
    since = at - starts[np.searchsorted(starts, at, "right") - 1]
    return at[since >= GEAR_WINDOW + LEAST] + 1


def _lulls(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Cuts where the rolling hash gives none, as in a word that is repeated over and over: what recurs is cut where it recurs."""
    edge = np.union1d(cut, [0, len(h)])
    long = np.diff(edge) > LULL
    if not long.any():
        return np.empty(0, np.int64)
    least, step = h.copy(), 1
    while step < LULL // 2:
        least[step:] = np.minimum(least[step:], least[:-step])
        step *= 2
    quiet = np.zeros(len(h) + 1, np.int8)
    quiet[edge[:-1][long] + LULL] = 1
    quiet[edge[1:][long]] -= 1
    found, last = [], -LEAST
    for i in np.flatnonzero((least == h) & (np.cumsum(quiet[:-1]) > 0)).tolist():
        if i - last >= LEAST:
            found.append(i)
            last = i
    return np.array(found, np.int64)


def chunks(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, start, length, words, digest, more) of every chunk: code points within the text, words that begin in it, 96 bits of XXH3."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    valid = np.diff(offsets) > 0
    begin, end = offsets[:-1][valid], offsets[1:][valid]
    edge = np.union1d(np.concatenate([begin, end]), cuts(data, begin)) if len(begin) else np.empty(0, np.int64)
    if len(edge) and (long := np.flatnonzero(np.diff(edge) > MOST)).size:
        edge = np.union1d(edge, np.concatenate([np.arange(edge[i], edge[i + 1], MOST) for i in long]))
    a, b = edge[:-1], edge[1:]
    row_of = np.flatnonzero(valid)[np.searchsorted(begin, a, "right") - 1] if len(a) else np.empty(0, np.int64)
    point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    space = _SPACE[data]
    opens = ~space
    opens[1:] &= space[:-1]
    opens[begin] = ~space[begin]
    word = np.concatenate([[0], np.cumsum(opens)])
    view, h = data.tobytes(), xxhash.xxh3_128_digest
    digest = np.frombuffer(b"".join([h(view[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]), np.int64).reshape(-1, 2)
    first = offsets[:-1][row_of] if len(a) else a
    return row_of, point[a] - point[first], point[b] - point[a], word[b] - word[a], digest[:, 0], digest[:, 1].astype(np.int32)


_CHUNK = ("doc_id", "text_id", "pos", "digest", "more")


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            row, start, length, words, digest, more = chunks(part.column(2))
            pos = (start << 29) | (length << 14) | np.minimum(words, 2**14 - 1)
            own = [part.column(i).take(pa.array(row)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(pos, pa.int64()), pa.array(digest, pa.int64()), pa.array(more, pa.int32())], list(_CHUNK))


def _text_id():
    """Tells the texts of one doc_id apart."""
    return F.hash("text")


def repeated_passages(docs: DataFrame, least_words: int = 25) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, text_id, start, end, n_words, run_words, removed, keeper_doc): passages that several documents hold.

    A chunk is repeated if chunks with its digest lie in two documents or more; a run is a stretch of adjacent repeated chunks
    with `least_words` words or more. A row is a part of a run with one keeper: text[start:end] in code points, the words that
    begin in it, those of the whole run, the smallest doc_id that holds it, and whether this is another document, where the part
    is to be removed. Chunks lose the passage's ends up to the next cut, about ten words in all: with the default, passages of
    over 50 words are found (README has the rate of misses) and those of under 25 are not. The smallest document keeps every part,
    so no passage is lost.

    Null and empty texts have no chunks; rows with a null doc_id take no part; texts are chunked whole; rows that repeat a doc_id and
    its text count once. Rows with one doc_id and different texts are one document, whose texts keep their runs apart (text_id); what
    only they share is not repeated. An empty table gives an empty result; other columns of docs are not used. Texts are chunked
    once, into a written table. Digests are counted after a map-side combine; the repeated ones are a written table too, so that
    the join back is of two plain exchanges, which the planner splits at a hot digest. No passage's holders are gathered.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _text_id().alias("text_id"), "text")
    rows = Written(rows.mapInArrow(_chunk_rows, "doc_id long, text_id int, pos long, digest long, more int"))
    per = rows.df.groupBy("digest", "more").agg(F.min("doc_id").alias("keeper_doc"), F.max("doc_id").alias("most"))
    found = Written(per.where("keeper_doc < most").select("digest", "more", "keeper_doc"))
    hits = rows.df.join(found.df, ["digest", "more"]).select(
        "doc_id", "text_id", "keeper_doc", F.shiftright("pos", 29).alias("start"), F.shiftright("pos", 14).bitwiseAND(F.lit(2**15 - 1)).alias("len"), F.col("pos").bitwiseAND(F.lit(2**14 - 1)).alias("words")
    )
    hits = hits.groupBy("doc_id", "text_id", "start", "len").agg(F.min("keeper_doc").alias("keeper_doc"), F.max("words").alias("words"))
    doc = Window.partitionBy("doc_id", "text_id").orderBy("start", "len")
    upto = doc.rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("start") + F.col("len")
    gap = F.coalesce(F.lag(end).over(doc) != F.col("start"), F.lit(True))
    hits = hits.withColumn("gap", gap).withColumn("run", F.sum(F.col("gap").cast("long")).over(upto))
    hits = hits.withColumn("run_words", F.sum("words").over(Window.partitionBy("doc_id", "text_id", "run"))).where(F.col("run_words") >= least_words)
    other = F.col("gap") | F.coalesce(F.lag("keeper_doc").over(doc) != F.col("keeper_doc"), F.lit(True))
    hits = hits.withColumn("part", F.sum(other.cast("long")).over(upto))
    out = hits.groupBy("doc_id", "text_id", "part", "run_words", "keeper_doc").agg(F.min("start").alias("start"), F.max(end).alias("end"), F.sum("words").alias("n_words"))
    out = written(out.select("doc_id", "text_id", "start", "end", "n_words", "run_words", (F.col("doc_id") != F.col("keeper_doc")).alias("removed"), "keeper_doc"))
    rows.drop()
    found.drop()
    return out


def without_repeats(docs: DataFrame, least_words: int = 25) -> DataFrame:
    """docs with text cut at the removed passages (and n_chars, if there, counted anew where it changed); every row stays, and is cut
    by the passages of its own text. Nulls, repeated rows and empty tables as in repeated_passages()."""
    parts = repeated_passages(docs, least_words).where("removed")
    lists = parts.groupBy(F.col("doc_id").alias("__doc"), F.col("text_id").alias("__text_id")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__parts"))
    step = lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))).alias("out"))
    text = F.aggregate("__parts", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    rows = docs.withColumn("__own", _text_id())
    rows = rows.join(lists, (rows["doc_id"] == lists["__doc"]) & (rows["__own"] == lists["__text_id"]), "left").withColumn("text", F.when(F.col("__doc").isNotNull(), text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("__doc").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
