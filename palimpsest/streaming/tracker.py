"""Tracking of an unbounded stream of recognised lines, with the batch operator's state machine as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import Tracker, _frames, _in_time, segment_rows
from ..schema import SEGMENTS

_STATE = "live array<struct<start:double,end:double,texts:array<struct<text:string,score:double,x:double,y:double,w:double,h:double>>>>, emitted long"


def _load(state: GroupState) -> tuple[list[dict], int]:
    if not state.exists:
        return [], 0
    live, emitted = state.get
    return [{"start": s["start"], "end": s["end"], "texts": [(t["text"], t["score"], (t["x"], t["y"], t["w"], t["h"])) for t in s["texts"]]} for s in live or []], emitted


def _kept(live: list[dict]) -> list[tuple]:
    return [(s["start"], s["end"], [(x, c, *b) for x, c, b in s["texts"]]) for s in live]


def track_stream(texts: DataFrame, overlap: float = 0.5, alike: float = 0.8, least: float = 0.5, idle: float | None = None, clock: str = "arrived") -> DataFrame:
    """Stream of (video_id, ts, line_idx, text, score, box, last boolean) -> segments, as they close.

    State is the live segments of a video, one in nearly every case. A segment closes when a later frame with text does not
    continue it, never by silence; a row with last = true (its text may be null) ends the video and frees its state. A trigger's rows of
    a video are taken in time order, and frames must not come in a later trigger than newer ones.

    With `idle`, a video of which no row has come for so many seconds ends too, by the watermark that the stream has on its timestamp
    column `clock`; rows of it that come later begin it anew, with segment ids from 0.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live, emitted = _load(state)
        tracker, done, ended = Tracker(overlap, alike, least, live=live), [], state.hasTimedOut
        if not ended:
            pdf = pd.concat(list(batches))
            for t, frame in _frames(_in_time(pdf[pdf["text"].notna()])):
                done += tracker.push(t, frame)
            ended = bool(pdf["last"].fillna(False).any())
        if ended:
            done += tracker.finish()
            state.remove()
        else:
            state.update((_kept(tracker.live), emitted + len(done)))
            if idle is not None:
                newest = max(int(pdf[clock].max().timestamp() * 1000), state.getCurrentWatermarkMs())
                state.setTimeoutTimestamp(newest + int(idle * 1000))
        out = segment_rows(key[0], sorted(done, key=lambda s: s["start"]))
        out["segment_id"] += emitted
        yield out

    flat = texts.select("video_id", "ts", "line_idx", "text", "score", *[F.col("box")[k].alias(k) for k in "xywh"], "last", *([clock] if idle is not None else []))
    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.EventTimeTimeout
    return flat.groupBy("video_id").applyInPandasWithState(step, SEGMENTS, _STATE, "append", timeout)
