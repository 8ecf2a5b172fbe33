"""Order-dependent folds over a video's frames or a frame's boxes. Each is a plain state machine that batch and streaming share, and
a DataFrame operator that runs it per video or per frame."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, groupby, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.polygon import area, overlap_ratio
from ..schema import SEGMENTS


def similarity(a: str, b: str) -> float:
    """2 LCS / (|a| + |b|) of lower-cased texts without spaces, by a bit-parallel LCS: one big-integer step per character of b."""
    a, b = a.replace(" ", "").lower(), b.replace(" ", "").lower()
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        m = at.get(c, 0)
        u = v & m
        v = ((v + u) | (v - u)) & full
    return 2.0 * (len(a) - v.bit_count()) / (len(a) + len(b))


def box_iou(a: tuple, b: tuple) -> float:
    w = max(0.0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h + 1e-6)


class Tracker:
    """Segments of one video from its frames in time order: push() each frame with texts, then finish().

    A frame belongs to the live segment that holds three quarters of the larger one's texts: equal text with an overlap over
    0.7 times `overlap`, or alike by more than `alike` with more than `overlap`. A segment keeps its first frame's texts; a later
    equal text with a higher score replaces score and box. Frames without texts are not pushed, so silence alone closes nothing,
    unless `max_gap` seconds are given. The last segments last `least` seconds if they have one moment only.
    """

    SHARE = 0.75

    def __init__(self, overlap: float = 0.5, alike: float = 0.8, least: float = 0.5, max_gap: float | None = None, live: list | None = None):
        self.overlap, self.alike, self.least, self.max_gap = overlap, alike, least, max_gap
        self.live: list[dict] = live or []

    def _same(self, x: tuple, y: tuple) -> bool:
        shared = box_iou(x[2], y[2])
        return (x[0] == y[0] and shared > 0.7 * self.overlap) or (shared > self.overlap and similarity(x[0], y[0]) > self.alike)

    def _share(self, texts: list[tuple], segment: dict) -> float:
        found = sum(any(self._same(x, y) for y in segment["texts"]) for x in texts)
        return found / max(len(texts), len(segment["texts"]))

    def push(self, t: float, texts: list[tuple]) -> list[dict]:
        """texts: (text, score, (x, y, w, h)). Returns the segments that this frame closes."""
        closed = []
        if self.max_gap is not None:
            closed = [s for s in self.live if t - s["end"] > self.max_gap]
            self.live = [s for s in self.live if t - s["end"] <= self.max_gap]
        shares = [self._share(texts, s) for s in self.live]
        top = max(shares, default=0.0)
        if top >= self.SHARE:
            best = self.live[shares.index(top)]
            best["end"] = t
            for x in texts:
                for i, y in enumerate(best["texts"]):
                    if x[0] == y[0] and x[1] > y[1]:
                        best["texts"][i] = x
                        break
        else:
            self.live.append({"start": t, "end": t, "texts": list(texts)})
        closed += [s for s in self.live if s["end"] < t]
        self.live = [s for s in self.live if s["end"] >= t]
        return closed

    def finish(self) -> list[dict]:
        out, self.live = self.live, []
        return [s | {"end": s["end"] + self.least if s["start"] == s["end"] else s["end"]} for s in out]


def _frames(rows: Iterable[tuple]) -> Iterator[tuple[float, list[tuple]]]:
    """(ts, text, score, x, y, w, h) rows in order of time -> (ts, texts of the frame)."""
    held: list[tuple] = []
    now = None
    for t, text, score, *b in rows:
        if held and t != now:
            yield now, held
            held = []
        now = t
        held.append((text, score, tuple(b)))
    if held:
        yield now, held


def _in_time(pdf: pd.DataFrame) -> Iterator[tuple]:
    pdf = pdf.sort_values(["ts", "line_idx"], kind="stable")
    return zip(*(pdf[c] for c in ("ts", "text", "score", "x", "y", "w", "h")), strict=True)


def segment_rows(video_id, segments: list[dict]) -> pd.DataFrame:
    texts = [[{"text": x, "score": s, "box": dict(zip("xywh", b, strict=True))} for x, s, b in g["texts"]] for g in segments]
    return pd.DataFrame(
        {"video_id": video_id, "segment_id": range(len(segments)), "start_time": [g["start"] for g in segments], "end_time": [g["end"] for g in segments], "timestamp": [g["start"] for g in segments], "texts": texts}
    )


def flat_texts(texts: DataFrame) -> DataFrame:
    return texts.select("video_id", "ts", "line_idx", "text", "score", *[F.col("box")[k].alias(k) for k in "xywh"])


def track(texts: DataFrame, overlap: float = 0.5, alike: float = 0.8, least: float = 0.5, max_gap: float | None = None) -> DataFrame:
    """(video_id, ts, line_idx, text, score, box) -> segments, numbered by start.

    One exchange by video, in which rows are sorted by time; a task folds its videos one after the other as rows come in, and gives out
    segments as they close. It holds one frame, the live segments and a batch, whatever the length of a video.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = chain.from_iterable(pdf.itertuples(index=False, name=None) for pdf in batches)
        for video, own in groupby(rows, key=lambda r: (r[0] is None, r[0])):
            tracker, n = Tracker(overlap, alike, least, max_gap), 0
            closed = chain.from_iterable(tracker.push(t, frame) for t, frame in _frames((r[1], *r[3:]) for r in own))
            for some in _several(chain(closed, _late(tracker)), 1000):
                out = segment_rows(video[1], some)
                out["segment_id"] += n
                n += len(some)
                yield out

    flat = flat_texts(texts).repartition("video_id").sortWithinPartitions("video_id", "ts", "line_idx")
    return flat.mapInPandas(fold, SEGMENTS)


def _late(tracker: Tracker) -> Iterator[dict]:
    """What is live when all before has been taken."""
    yield from tracker.finish()


def _several(items: Iterable, most: int) -> Iterator[list]:
    items = iter(items)
    while some := list(islice(items, most)):
        yield some


def exact_runs(texts: DataFrame) -> DataFrame:
    """(video_id, ts, text) -> runs of consecutive equal texts, as gaps and islands: the part of tracking that windows can say."""
    from pyspark.sql import Window

    w = Window.partitionBy("video_id").orderBy("ts")
    new = F.coalesce((F.lag("text").over(w) != F.col("text")).cast("long"), F.lit(1).cast("long"))
    rows = texts.select("video_id", "ts", "text", new.alias("new")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("video_id", "run", "text").agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count(F.lit(1)).alias("frames"))


def merge_lines(boxes: list[tuple], y_share: float = 0.5, gap_share: float = 0.3) -> list[list[int]]:
    """Members of each text line, in order of the lines' first boxes. boxes: (x, y, w, h), taken by y (stable).

    A box joins the first line whose mean centre is within y_share of its mean height, and whose last box to the right ends less
    than gap_share of its mean width before the box.
    """
    lines: list[dict] = []
    for i in sorted(range(len(boxes)), key=lambda k: boxes[k][1]):
        x, y, w, h = boxes[i]
        centre = y + h / 2
        for line in lines:
            n = len(line["of"])
            if abs(centre - line["cy"] / n) <= y_share * line["h"] / n and x - line["edge"][1] < gap_share * line["w"] / n:
                break
        else:
            line = {"of": [], "cy": 0.0, "h": 0.0, "w": 0.0, "edge": (-np.inf, 0.0)}
            lines.append(line)
        line["of"].append(i)
        line["cy"], line["h"], line["w"] = line["cy"] + centre, line["h"] + h, line["w"] + w
        if x > line["edge"][0]:
            line["edge"] = (x, x + w)
    return [line["of"] for line in lines]


def box_around(boxes: list[tuple]) -> tuple:
    """(x, y, w, h) of the least upright box that holds all."""
    x, y = min(b[0] for b in boxes), min(b[1] for b in boxes)
    return x, y, max(b[0] + b[2] for b in boxes) - x, max(b[1] + b[3] for b in boxes) - y


def reading_rows(points: list[tuple], tolerance: float = 10) -> list[int]:
    """Order by rows: by y, a new row where y is `tolerance` or more from the row's first; each row by x."""
    order, row, first = [], [], None
    for i in sorted(range(len(points)), key=lambda k: points[k][1]):
        if row and abs(points[i][1] - first) >= tolerance:
            order += sorted(row, key=lambda k: points[k][0])
            row = []
        if not row:
            first = points[i][1]
        row.append(i)
    return order + sorted(row, key=lambda k: points[k][0])


def reading_swaps(points: list[tuple], tolerance: float = 10) -> list[int]:
    """Order by (y, x), then each moved before those above it by less than `tolerance` that are further right."""
    order: list[int] = []
    for i in sorted(range(len(points)), key=lambda k: (points[k][1], points[k][0])):
        at = len(order)
        while at and abs(points[i][1] - points[order[at - 1]][1]) < tolerance and points[i][0] < points[order[at - 1]][0]:
            at -= 1
        order.insert(at, i)
    return order


def _per_frame(boxes: DataFrame, keys: list[str], order: str, fold, schema: str) -> DataFrame:
    flat = boxes.select(*keys, order, *[F.col("box")[k].alias(k) for k in "xywh"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return fold(key, pdf.sort_values(order, kind="stable"))

    return flat.groupBy(*keys).applyInPandas(run, schema)


def _key_schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def line_merge(boxes: DataFrame, keys: list[str], order: str = "box_idx", y_share: float = 0.5, gap_share: float = 0.3) -> DataFrame:
    """(…keys, order, box) -> (…keys, line_idx, members, x, y, w, h): text lines with the boxes around them."""

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        b = list(zip(*(pdf[k] for k in "xywh"), strict=True))
        out = []
        for n, of in enumerate(merge_lines(b, y_share, gap_share)):
            out.append((*key, n, len(of), *box_around([b[i] for i in of])))
        return pd.DataFrame(out, columns=[*keys, "line_idx", "members", *"xywh"])

    return _per_frame(boxes, keys, order, fold, f"{_key_schema(boxes, keys)}, line_idx int, members int, x double, y double, w double, h double")


def reading_order(boxes: DataFrame, keys: list[str], order: str = "box_idx", swaps: bool = False) -> DataFrame:
    """(…keys, order, box) -> (…keys, order, place): the box's place in reading order, by rows or by swaps."""

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids = list(pdf[order])
        found = (reading_swaps if swaps else reading_rows)(list(zip(pdf["x"], pdf["y"], strict=True)))
        return pd.DataFrame([(*key, ids[i], n) for n, i in enumerate(found)], columns=[*keys, order, "place"])

    return _per_frame(boxes, keys, order, fold, f"{_key_schema(boxes, keys)}, {order} {boxes.schema[order].dataType.simpleString()}, place int")


def suppressed(polygons: list[np.ndarray], scores: list[float], threshold: float) -> list[int]:
    """Non-maximum suppression: indices kept, best score first (the later of equals), each dropping those that overlap it more."""
    left = np.array(sorted(range(len(scores)), key=lambda i: scores[i]), int)
    low, high = (np.array([f(p, axis=0) for p in polygons]).reshape(-1, 2) for f in (np.min, np.max))
    size = np.array([abs(area(p)) for p in polygons])
    kept = []
    while len(left):
        top, left = int(left[-1]), left[:-1]
        kept.append(top)
        side = np.maximum(0, np.minimum(high[left], high[top]) - np.maximum(low[left], low[top]))
        most = side.prod(axis=1)  # no polygons share more than their bounding boxes do
        near = most > threshold * (size[left] + size[top] - most)
        near[near] = [overlap_ratio(polygons[top], polygons[i]) > threshold for i in left[near]]
        left = left[~near]
    return kept


def nms(boxes: DataFrame, keys: list[str], order: str = "box_idx", threshold: float = 0.3) -> DataFrame:
    """(…keys, order, quad, score) -> (…keys, order, score, place) of the boxes that non-maximum suppression keeps."""

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        polys = [np.array([(p["x"], p["y"]) for p in q], float) for q in pdf["quad"]]
        kept = suppressed(polys, list(pdf["score"]), threshold)
        return pd.DataFrame([(*key, pdf[order].iloc[i], pdf["score"].iloc[i], n) for n, i in enumerate(kept)], columns=[*keys, order, "score", "place"])

    schema = f"{_key_schema(boxes, keys)}, {order} {boxes.schema[order].dataType.simpleString()}, score double, place int"
    return boxes.select(*keys, order, "quad", "score").groupBy(*keys).applyInPandas(fold, schema)


def stitched(chunks: list[str]) -> str:
    """Texts of overlapping slices as one: each slice loses the longest end of what the one before added that it begins with."""
    out, last = "", ""
    for i, s in enumerate(chunks):
        body = s[(1 if i else 0) : (len(s) if i and i == len(chunks) - 1 else max(len(s) - 1, 0))]
        if i:
            cut = next((len(last) - c for c in range(len(last)) if body[: len(last) - c] == last[c:]), 0)
            body = body[cut:]
        out, last = out + body, body
    return out


def stitch(chunks: DataFrame, key: str, order: str = "chunk_idx") -> DataFrame:
    """(key, order, text, conf) -> (key, text, conf): slices stitched in order; the mean of their confidences."""

    def fold(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pd.DataFrame({key: [k[0]], "text": [stitched(list(pdf["text"]))], "conf": [float(pdf["conf"].mean())]})

    return chunks.select(key, order, "text", "conf").groupBy(key).applyInPandas(fold, f"{_key_schema(chunks, [key])}, text string, conf double")
