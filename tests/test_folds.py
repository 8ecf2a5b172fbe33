"""State machines against plain restatements of their rules, and batch against stream."""

import random
from datetime import datetime, timedelta
from functools import lru_cache

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import polygon
from palimpsest.functions import text as T
from palimpsest.operators import folds, matching
from palimpsest.streaming.tracker import track_stream

B = (0.0, 0.0, 100.0, 20.0)


def run(frames, **kw):
    t, out = folds.Tracker(**kw), []
    for at, texts in frames:
        out += t.push(at, texts)
    return [(s["start"], s["end"], [x[0] for x in s["texts"]]) for s in out + t.finish()]


def test_single_frame_lasts_half_a_second_only_at_the_end():
    assert run([(1.0, [("a", 0.9, B)])]) == [(1.0, 1.5, ["a"])]
    assert run([(1.0, [("a", 0.9, B)]), (2.0, [("b", 0.9, B)])]) == [(1.0, 1.0, ["a"]), (2.0, 2.5, ["b"])]


def test_silence_closes_nothing_but_another_text_does():
    assert run([(1.0, [("a", 0.9, B)]), (60.0, [("a", 0.9, B)])]) == [(1.0, 60.0, ["a"])]
    assert run([(1.0, [("a", 0.9, B)]), (60.0, [("a", 0.9, B)])], max_gap=5.0) == [(1.0, 1.0, ["a"]), (60.0, 60.5, ["a"])]
    assert [s[:2] for s in run([(1.0, [("a", 0.9, B)]), (2.0, [("b", 0.9, B)]), (3.0, [("a", 0.9, B)])])] == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.5)]


def test_moved_text_splits_and_share_is_inclusive():
    far = (500.0, 0.0, 100.0, 20.0)
    assert len(run([(1.0, [("a", 0.9, B)]), (2.0, [("a", 0.9, far)])])) == 2
    four = [(c, 0.9, (0.0, 30.0 * i, 100.0, 20.0)) for i, c in enumerate("abcd")]
    assert len(run([(1.0, four), (2.0, four[:3])])) == 1 and len(run([(1.0, four), (2.0, four[:2])])) == 2


def test_a_higher_score_takes_over_an_equal_one_does_not():
    t = folds.Tracker()
    t.push(1.0, [("a", 0.5, B)])
    t.push(2.0, [("a", 0.5, (5.0, 0.0, 100.0, 20.0))])
    assert t.live[0]["texts"] == [("a", 0.5, B)]
    t.push(3.0, [("a", 0.6, (5.0, 0.0, 100.0, 20.0))])
    assert t.live[0]["texts"] == [("a", 0.6, (5.0, 0.0, 100.0, 20.0))]


@lru_cache(maxsize=None)
def lcs(a, b):
    return 0 if not a or not b else lcs(a[:-1], b[:-1]) + 1 if a[-1] == b[-1] else max(lcs(a[:-1], b), lcs(a, b[:-1]))


def test_similarity(spark):
    rng = random.Random(1)
    pairs = [("", ""), (" ", "   "), ("kitten", "sitting"), ("Á b", "áb")] + [("".join(rng.choice("abcé ") for _ in range(rng.randrange(9))), "".join(rng.choice("abcé ") for _ in range(rng.randrange(9)))) for _ in range(60)]
    for a, b in pairs:
        x, y = a.replace(" ", "").lower(), b.replace(" ", "").lower()
        assert folds.similarity(a, b) == pytest.approx(2 * lcs(x, y) / (len(x) + len(y)) if x or y else 1.0)
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.ratio(F.col("a"), F.col("b")).alias("r"))
    assert all(r.r == pytest.approx(folds.similarity(r.a, r.b)) for r in df.collect())


def test_line_merge_and_reading_orders():
    boxes = [(0, 0, 10, 10), (12, 1, 10, 10), (40, 0, 10, 10), (0, 30, 10, 10)]
    assert folds.merge_lines(boxes) == [[0, 1], [2], [3]]
    assert folds.reading_rows([(50, 0), (0, 9), (10, 10), (5, 30)]) == [1, 0, 2, 3]
    assert folds.reading_swaps([(50, 0), (0, 9), (10, 18)]) == [1, 0, 2]


def test_stitch():
    assert folds.stitched(["abcd"]) == "abc"
    assert folds.stitched(["abcX", "Ycde", "Zdef"]) == "abcdef"


def test_polygons_and_suppression():
    square = np.array([(0, 0), (10, 0), (10, 10), (0, 10)], float)
    tilted = np.array([(5, -2), (12, 5), (5, 12), (-2, 5)], float)
    assert polygon.intersection(square, square[::-1]) == pytest.approx(100)
    assert polygon.intersection(square, tilted) == pytest.approx(polygon.intersection(tilted, square))
    assert polygon.intersection(square, square + 20) == 0 and polygon.overlap_ratio(square[:1], square[:1]) == 0
    assert folds.suppressed([square, square + 1, square + 30], [0.5, 0.9, 0.1], 0.3) == [1, 2]


def test_matching_of_splits_and_merges():
    assert matching.scores(np.array([[0.9]]), np.array([[0.9]]))[:2] == (1.0, 1.0)
    r, p, _ = matching.scores(np.array([[0.4, 0.5]]), np.array([[0.9, 0.9]]))
    assert (r, p) == (0.8, 1.6)
    r, p, _ = matching.scores(np.array([[0.9], [0.9]]), np.array([[0.4], [0.5]]))
    assert (r, p) == (1.6, 0.8)
    assert matching.scores(np.zeros((2, 2)), np.zeros((2, 2)))[:2] == (0.0, 0.0)


def test_partitions_and_order_do_not_matter(spark):
    rng = random.Random(2)
    rows = [(f"v{v}", float(t), i, rng.choice("abc"), rng.random(), (rng.randrange(3) * 5.0, 0.0, 100.0, 20.0)) for v in range(5) for t in range(30) for i in range(rng.randrange(3))]
    schema = "video_id string, ts double, line_idx int, text string, score double, box struct<x:double,y:double,w:double,h:double>"
    a = folds.track(spark.createDataFrame(rows, schema)).orderBy("video_id", "segment_id").collect()
    rng.shuffle(rows)
    assert a == folds.track(spark.createDataFrame(rows, schema).repartition(7)).orderBy("video_id", "segment_id").collect()
    assert folds.track(spark.createDataFrame([], schema)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    schema = "video_id string, ts double, line_idx int, text string, score double, box struct<x:double,y:double,w:double,h:double>, last boolean"
    rows = [(f"v{v}", float(t), 0, rng.choice("ab"), rng.random(), B, False) for v in range(4) for t in range(20)]
    for k in range(4):
        part = [r for r in rows if k * 5 <= r[1] < k * 5 + 5] + ([(f"v{v}", 99.0, 0, None, None, None, True) for v in range(4)] if k == 3 else [])
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    for k in range(4):
        next((tmp_path / "in" / str(k)).glob("*.parquet")).rename(tmp_path / f"{k}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*.parquet")
    q = track_stream(stream).writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = pd.DataFrame([r.asDict() for r in spark.table("tracked").select("video_id", "segment_id", "start_time", "end_time").collect()])
    want = folds.track(spark.createDataFrame(rows, schema).drop("last")).select("video_id", "segment_id", "start_time", "end_time").toPandas()
    key = ["video_id", "segment_id"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True))


def test_a_silent_video_ends_by_the_watermark(spark, tmp_path):
    schema = "video_id string, ts double, line_idx int, text string, score double, box struct<x:double,y:double,w:double,h:double>, last boolean, arrived timestamp"
    at = lambda minute: datetime(2024, 1, 1) + timedelta(minutes=minute)
    parts = [[("v", 0.0, 0, "a", 0.9, B, False, at(0)), ("w", 0.0, 0, "b", 0.9, B, False, at(0))], [("w", 1.0, 0, "c", 0.9, B, False, at(30))], [("w", 2.0, 0, "d", 0.9, B, False, at(60))], [("w", 3.0, 0, "e", 0.9, B, False, at(61))]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        next((tmp_path / "in" / str(k)).glob("*.parquet")).rename(tmp_path / f"{k}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/*.parquet").withWatermark("arrived", "1 minute")
    q = track_stream(stream, idle=600).writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.video_id, r.segment_id): (r.start_time, r.end_time) for r in spark.table("silent").collect()}
    assert got[("v", 0)] == (0.0, 0.5)  # ended by silence: nothing marks its last row
    assert {k: v for k, v in got.items() if k[0] == "w"}.keys() >= {("w", 0)}


def test_long_videos_are_folded_as_rows_come(spark):
    rows = [("v", float(t), 0, f"text number {t % 7} {t}", 0.9, B) for t in range(3000)] + [(None, float(t), 0, "x", 0.9, B) for t in range(5)]
    schema = "video_id string, ts double, line_idx int, text string, score double, box struct<x:double,y:double,w:double,h:double>"
    got = folds.track(spark.createDataFrame(rows, schema).repartition(5), alike=0.999).orderBy("video_id", "segment_id").collect()
    assert [(r.segment_id, r.start_time) for r in got if r.video_id] == [(i, float(i)) for i in range(3000)]
    assert [(r.segment_id, r.start_time, r.end_time) for r in got if r.video_id is None] == [(0, 0.0, 4.0)]


def test_polygons_that_are_not_convex():
    bars = lambda x, y: np.array([(x, y), (x + 10, y), (x + 10, y + 2), (x + 3, y + 2), (x + 3, y + 9), (x, y + 9)], float)
    a = bars(0, 0)
    assert not polygon.is_convex(a) and polygon.is_convex(a[:3]) and polygon.intersection(a, a) == pytest.approx(20 + 21)
    assert polygon.intersection(a, bars(5, 0)[::-1]) == pytest.approx(10) and polygon.intersection(a, bars(4, 3)) == 0
    star = np.array([(0, 0), (4, 4), (4, 0), (0, 4)], float)  # crosses itself: no single way around
    assert not polygon.is_convex(star)
