"""Best-fit packing of tokenised documents into sequences, after Martello-Toth dominance reduction, on the histogram of lengths."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Written, bounded, ranked, written
from .tokens import CACHE, LONGEST, encoded, tokenizer

END_ID = 1
#: A full stop or comma that is no pre-token by itself, as another mark may come before it.
_ODD = re.compile(r"[.,](?<![^\W_].) ")
_PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"


def words(text: str) -> list[str]:
    """Parts of a text between white space; but for texts with one of two capitals whose small letters are not theirs alone, in small
    letters, and with full stops and commas as parts unless other marks come before some."""
    text = text.replace("\n", " ")
    if "\u03a3" not in text and "\u0130" not in text:
        text = text.lower()
        if not _ODD.search(text):
            text = text.replace(". ", " . ").replace(", ", " , ")
    return text.split(" ")


class Ids:
    """Token ids, as little-endian unsigned 32-bit bytes, of texts whose tokenizer drops white space and case and never looks
    across white space; cached by word."""

    def __init__(self, path: str):
        self.path, self.seen = path, {"": b""}
        self.added = {t.content for t in tokenizer(path).get_added_tokens_decoder().values()}
        self.mark = commonprefix(sorted(self.added))
        self.odd = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or "(?!)", re.IGNORECASE)

    def of(self, texts: list[str | None]) -> list[bytes]:
        parts = [words(x) if x else [] for x in texts]
        new = list(set().union(*parts).difference(self.seen))
        if new:
            self.seen.update(zip(new, encoded(self.path, new, fold=True), strict=True))
        get = self.seen.__getitem__
        out = [b"".join(map(get, x)) for x in parts]
        # Added tokens are matched on the raw text, so one in other letters is no token, but its small letters are.
        for i, x in enumerate(texts):
            if x and self.mark in x and any(m.group() not in self.added for m in self.odd.finditer(x)):
                out[i] = np.array(tokenizer(self.path).encode(x, add_special_tokens=False).ids, "<u4").tobytes()
        for x in new:
            if len(x) > LONGEST:
                del self.seen[x]
        if len(self.seen) > CACHE:
            self.seen = {"": b""}
        return out


_WORKER: dict = {}


def pieces(docs: DataFrame, path: str, size: int, *more: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, *more): documents' ids and END_ID, cut every `size` ids."""
    end = np.array([END_ID], "<u4").tobytes()

    @F.arrow_udf(_PIECES)
    def cut(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _WORKER.setdefault(path, Ids(path))
        for batch in texts:
            out: list[list[dict]] = []
            for k in range(0, len(batch), 512):
                for ids in own.of(batch.slice(k, 512).to_pylist()):
                    ids += end
                    out.append([{"piece": i // size, "start": i, "length": min(size, len(ids) // 4 - i), "ids_crc32": zlib.crc32(ids[4 * i : 4 * (i + size)])} for i in range(0, len(ids) // 4, size)])
            yield pa.array(out, pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])))

    return docs.select("doc_id", *more, F.explode(cut(F.col("text"))).alias("p")).select("doc_id", "p.*", *more)


class Plan:
    """Placements of a histogram's items: runs of equal lengths into runs of alike sequences, so its size follows the number of
    lengths, not of items. Columns: length, first item's rank, first sequence, items a sequence, offset of the first in it."""

    def __init__(self, counts: dict[int, int], size: int):
        self.size, self.left, self.bins, self.rows = size, {k: v for k, v in counts.items() if v}, 0, []
        self.used = dict.fromkeys(counts, 0)
        self.fixed = self._reduce()
        self._best_fit()

    def _take(self, length: int, n: int, first: int, each: int, offset: int) -> None:
        self.rows.append((length, self.used[length], first, each, offset))
        self.used[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def _fix(self, *lengths: int, times: int) -> None:
        at = 0
        for x in lengths:
            self._take(x, times, self.bins, 1, at)
            at += x
        self.bins += times

    def _reduce(self) -> int:
        """Martello and Toth: an item with a set of others that dominates every alternative is fixed with it for good.

        From the longest item on: alone if nothing fits beside it; with an item that fills the sequence; with the longest that
        fits, if no two others fit, or if no three fit and no two sum to more than it. An item without such a set is left to
        best-fit: its alternatives would be sets of more than three.
        """
        before = self.bins
        for x in sorted(self.left, reverse=True):
            while (n := self.left.get(x, 0)) and self._dominant(x, n):
                pass
        return self.bins - before

    def _dominant(self, x: int, n: int) -> bool:
        room = self.size - x
        others = dict(self.left)
        others[x] -= 1
        keys = np.array(sorted(k for k, v in others.items() if v and k <= room))
        if not len(keys):
            self._fix(x, times=n if x * 2 > self.size or not others[x] else 1)
            return True
        best = int(keys[-1])
        pair = lambda: self._fix(x, best, times=n // 2 if best == x else min(n, self.left[best]))
        if best == room:
            pair()
            return True
        # as long as four of x and of best are left, no count below is another one after a fixing, so that the next is the same
        alike = max(1, (n - 4) // 2 if best == x else min(n, self.left[best]) - 4)
        small = [int(k) for k in keys[:3] for _ in range(min(3, others[int(k)]))][:3]
        if len(small) < 2 or sum(small[:2]) > room:
            self._fix(x, best, times=alike) if best == x or 2 * x <= self.size else pair()
            return True
        if len(small) < 3 or sum(small) > room:
            mate = keys[np.maximum(np.searchsorted(keys, room - keys, "right") - 1, 0)]
            own = (mate == keys) & np.array([others[int(k)] < 2 for k in keys])
            sums = np.where((keys + mate <= room) & ~own, keys + mate, 0)
            if best >= int(sums.max()) and not own.any():
                self._fix(x, best, times=alike)
                return True
        return False

    def _best_fit(self) -> None:
        """Best-fit decreasing: each item, longest first, goes where the least room is left that holds it."""
        rooms: list[int] = []
        runs: dict[int, list[tuple[int, int]]] = {}

        def add(room: int, first: int, n: int) -> None:
            if room and n:
                if room not in runs:
                    insort(rooms, room)
                    runs[room] = []
                runs[room].append((first, n))

        for x in sorted(self.left, reverse=True):
            while n := self.left.get(x, 0):
                i = bisect_left(rooms, x)
                if i < len(rooms):
                    room = rooms[i]
                    first, have = runs[room].pop()
                    if not runs[room]:
                        del runs[room], rooms[i]
                else:
                    room, first = self.size, self.bins
                    have = -(-n // (self.size // x))
                    self.bins += have
                each = room // x
                whole = min(have, n // each)
                if whole:
                    self._take(x, whole * each, first, each, self.size - room)
                    add(room - each * x, first, whole)
                    add(room, first + whole, have - whole)
                else:
                    self._take(x, n, first, n, self.size - room)
                    add(room - n * x, first, 1)
                    add(room, first + 1, have - 1)

    def table(self) -> np.ndarray:
        """Rows sorted by length and first rank."""
        return np.array(sorted(self.rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str, size: int = 4096) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row per piece of a document.

    `path` is a tokenizer file that every worker can read, of a tokenizer that drops white space. Null and empty texts are one id
    long. Whole texts are tokenised; repeated rows and null doc_ids are documents of their own; an empty table gives an empty
    result; other columns of docs are not used.

    The driver sees the histogram of lengths (at most `size` rows) and plans on it; the plan, whose rows follow the number of
    lengths, goes to all tasks, and each piece finds its place by its rank among pieces of its length.
    """
    cut = written(pieces(docs, path, size))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    full = counts.pop(size, 0)
    done = Plan(counts, size)
    rows = done.table()
    if full:
        rows = np.vstack([rows, [[size, 0, done.bins, 1, 0]]])
    sent = docs.sparkSession.sparkContext.broadcast(rows)

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        table = sent.value
        keys = (table[:, 0] << 48) + table[:, 1]
        for a, b in length:
            x, rank = a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(keys, (x << 48) + rank, "right") - 1] if len(x) else table[:0]
            nth = rank - row[:, 1]
            yield pa.StructArray.from_arrays([pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * x)], ["sequence_id", "offset"])

    got = ranked(cut, ["length"], [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "__rank")
    return got.select("doc_id", "piece", "start", "length", "ids_crc32", place(F.col("length"), F.col("__rank")).alias("p")).select("doc_id", "piece", "start", "length", "ids_crc32", "p.sequence_id", "p.offset")


def _pack_window(rows: pa.Table, size: int) -> pa.Table:
    """(window, place, piece, length, ...) of one window -> the same with `seq`, from 0, and `offset`.

    Pieces of a length are dealt in the order of the window, and sequences are numbered by their earliest piece.
    """
    rows = rows.sort_by([("place", "ascending"), ("piece", "ascending")])
    length = rows["length"].to_numpy()
    lengths, counts = np.unique(length, return_counts=True)
    counts = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    full = counts.pop(size, 0)
    done = Plan(counts, size)
    table = np.vstack([done.table(), [[size, 0, done.bins, 1, 0]]]) if full else done.table()
    order = np.argsort(length, kind="stable")
    rank = np.empty(len(length), np.int64)
    rank[order] = np.arange(len(length)) - np.searchsorted(length[order], length[order])
    row = table[np.searchsorted((table[:, 0] << 48) + table[:, 1], (length << 48) + rank, "right") - 1]
    nth = rank - row[:, 1]
    seq = row[:, 2] + nth // row[:, 3]
    _, first, back = np.unique(seq, return_index=True, return_inverse=True)
    number = np.empty(len(first), np.int64)
    number[np.argsort(first)] = np.arange(len(first))
    return rows.append_column("seq", pa.array(number[back])).append_column("offset", pa.array(row[:, 4] + nth % row[:, 3] * length))


def pack_in_order(docs: DataFrame, path: str, size: int = 4096, window_docs: int = 4096) -> DataFrame:
    """pack() for docs read from files: the order of rows in the files (by name, then row) is kept window by window.

    Each `window_docs` consecutive documents are packed by themselves; sequences are numbered window after window and, within
    one, by their earliest piece. So a sequence holds documents of one window only, and for every window the first sequences hold
    just the documents up to its end: what the order decides over the whole it decides over the sequences, to within a window.

    A window is planned in one task, from the lengths of its pieces; the driver sees none. The price of windows is at
    most about one part-filled sequence each.
    """
    docs = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    cut = Written(pieces(docs, path, size, "file", "at"))
    files = cut.df.where("piece = 0").groupBy(F.col("file").alias("__file")).agg(F.count(F.lit(1)).alias("n"))
    files = bounded(written(files.select("__file", F.coalesce(F.sum("n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))))
    rows = cut.df.join(files, cut.df["file"] == files["__file"]).withColumn("place", F.col("__before") + F.col("at"))
    rows = rows.select(F.expr(f"place div {window_docs}").alias("window"), "place", "doc_id", "piece", "start", "length", "ids_crc32")
    schema = f"window bigint, place bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, seq bigint, offset bigint"
    packed = Written(rows.groupBy("window").applyInArrow(lambda one: _pack_window(one, size), schema))
    cut.drop()
    windows = packed.df.groupBy(F.col("window").alias("__window")).agg((F.max("seq") + 1).alias("n"))
    windows = bounded(written(windows.select("__window", F.coalesce(F.sum("n").over(Window.orderBy("__window").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))))
    got = packed.df.join(windows, packed.df["window"] == windows["__window"])
    return got.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("__before") + F.col("seq")).alias("sequence_id"), "offset")
