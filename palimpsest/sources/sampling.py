"""Which frames of a video are read: strides, segments and three samplers, as plans over a table of videos (no frame is decoded)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import half_even, whole


def stride(sec_skip: float, fps: Column) -> Column:
    """Frames from one sample to the next: sec_skip * fps, halves to even, 1 at least."""
    return F.greatest(F.lit(1), half_even(F.lit(float(sec_skip)) * fps))


def modulo(videos: DataFrame, sec_skip: float) -> DataFrame:
    """Frames whose number is a multiple of the stride; generated, so that skipped frames are never rows."""
    n = F.explode(F.sequence(F.lit(0).cast("long"), F.col("total_frames") - 1, stride(sec_skip, F.col("fps"))))
    return _stamped(videos.where("total_frames > 0").select("video_id", "fps", n.alias("frame_idx")), F.col("frame_idx"))


def sequential(videos: DataFrame, sec_skip: float) -> DataFrame:
    """The last frame of each whole stride, stamped with the time after it."""
    s = stride(sec_skip, F.col("fps"))
    rows = videos.where(F.col("total_frames") >= s).select("video_id", "fps", F.explode(F.sequence(s, F.col("total_frames").cast("long"), s)).alias("n"))
    return _stamped(rows.withColumn("frame_idx", F.col("n") - 1), F.col("n"))


def segmented(videos: DataFrame, sec_skip: float, segment_sec: float) -> DataFrame:
    """Every stride from the beginning of each segment: the phase starts anew with a segment."""
    rows = time_segments(videos, segment_sec)
    n = F.explode(F.sequence(F.col("start"), F.col("end") - 1, stride(sec_skip, F.col("fps"))))
    return _stamped(rows.select("video_id", "fps", n.alias("frame_idx")), F.col("frame_idx"))


def _stamped(rows: DataFrame, n: Column) -> DataFrame:
    return rows.select("video_id", "frame_idx", (n / F.col("fps")).alias("ts"))


def time_segments(videos: DataFrame, segment_sec: float) -> DataFrame:
    """(video_id, fps, start, end) of segments of a fixed time."""
    size = F.greatest(F.lit(1), whole(F.col("fps") * segment_sec))
    rows = videos.where("total_frames > 0").select("video_id", "fps", "total_frames", size.alias("size"))
    rows = rows.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total_frames") - 1, F.col("size"))))
    return rows.select("video_id", "fps", "start", F.least(F.col("start") + F.col("size"), F.col("total_frames")).alias("end"))


def even_segments(videos: DataFrame, parts: int) -> DataFrame:
    """(video_id, part, start, end): equal parts; the last takes the remainder."""
    rows = videos.select("video_id", "total_frames", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    size = F.floor(F.col("total_frames") / parts)
    return rows.select("video_id", "part", (size * F.col("part")).alias("start"), F.when(F.col("part") == parts - 1, F.col("total_frames")).otherwise(size * (F.col("part") + 1)).alias("end"))


def segment_seconds(duration: Column, fps: Column, width: Column, height: Column, wanted: float = 120, dynamic: bool = True, memory_gb: float = 8.0) -> Column:
    """Seconds of a segment: the whole of a video under 3 minutes; for the value 60 a share of longer ones, or what memory holds."""
    if not dynamic:
        return F.lit(float(wanted))
    if wanted != 60:
        return F.when(duration < 180, duration).otherwise(float(wanted))
    mb = height * width * 3 * 4 / 1048576.0
    fits = (F.lit(memory_gb * 0.6 * 1024) / (mb * 5)) / fps
    longer = F.when(duration < 600, F.greatest(F.lit(60.0), duration / 3)).when(duration < 1800, F.greatest(F.lit(60.0), duration / 10))
    return F.when(duration < 180, duration).otherwise(longer.otherwise(F.greatest(F.lit(30.0), F.least(F.lit(300.0), fits))))


def batch_size(height: Column, width: Column, max_gb: Column, used_gb: Column, most: int = 32) -> Column:
    """Frames of a batch that fit in four fifths of free memory, five copies of four bytes a value, from 1 to `most`."""
    free = (max_gb - used_gb) * 0.8 * 1073741824.0
    return F.greatest(F.lit(1), F.least(whole(free / (height * width * 3 * 4 * 5)), F.lit(most)))


def frames_at_once(duration: Column, wanted: Column | int = 16, dynamic: bool = True, short: float = 300, most: int = 64) -> Column:
    """Frames of a batch as wanted; of a video under `short` seconds twice as many, up to `most`."""
    wanted = wanted if isinstance(wanted, Column) else F.lit(wanted)
    return F.when(duration < short, F.least(F.lit(most), wanted * 2)).otherwise(wanted) if dynamic else wanted
