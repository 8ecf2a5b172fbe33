"""Every operator as a query over the bundled tables, with the SQL for DuckDB that says the same where SQL can.

The tables hold no frames, so pictures' rows are derived from them by integer arithmetic: texts and boxes from events, prediction
pairs from part, class scores from embeddings (8 steps of 8 classes), small pictures from embeddings (4 rows of 5 pixels), truths and
detections from lineitem.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import polygon, sequence as S
from ..functions import text as T
from ..operators import filters, folds, matching, metrics, pictures
from ..sources import files, sampling, sinks

W, H = 1280, 720
CHARSET = list("abcdefghijklmnopqrstuvwxyz0123456789")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark, sf) -> DataFrame:
    e = read(spark, sf, "events")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    n = F.length("event_type")
    box = G.box(100 + n * 97 % 500 + F.col("event_id") % 11 * 4, 400 + F.ascii("event_type") * 13 % 200, 200, 40)
    return e.select(F.col("user_id").cast("string").alias("video_id"), "event_id", (micros / 1e6).alias("ts"), F.col("event_id").cast("int").alias("line_idx"), F.col("event_type").alias("text"), (F.col("value") / 500).alias("score"), box.alias("box"))


def bucketed(spark, sf) -> DataFrame:
    return texts(spark, sf).withColumn("ts", F.floor(F.col("ts") / 21600) * 21600.0)


def boxes(spark, sf) -> DataFrame:
    i = F.col("event_id")
    b = G.box(i * 37 % 1200, i * 53 % 640, 40 + i * 13 % 400, 16 + i * 7 % 48)
    return read(spark, sf, "events").select("event_id", F.col("user_id").alias("image_id"), F.col("event_id").cast("int").alias("box_idx"), b.alias("box"), (F.col("value") / 500).alias("score")).withColumn("quad", G.quad_of(F.col("box")))


def videos(spark, sf) -> DataFrame:
    k = F.col("n_nationkey")
    return read(spark, sf, "nation").select(F.col("n_name").alias("video_id"), (10 + k * 1.25).alias("fps"), (1000 + k * 37).cast("long").alias("total_frames"), (k * 80 + 320).alias("width"), (k * 45 + 180).alias("height"))


def pairs(spark, sf) -> DataFrame:
    return read(spark, sf, "part").select(F.col("p_partkey").alias("sample_id"), F.col("p_name").alias("pred"), F.col("p_type").alias("target"), (F.col("p_size") % 6 + 1).alias("ratio"), F.col("p_retailprice").alias("elapse"))


def paths(spark, sf) -> DataFrame:
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice(F.col("embedding"), t * 8 + 1, F.lit(8)))
    return read(spark, sf, "embeddings").select("vec_id", "embedding", rows.alias("probs")).withColumn("path", S.steps(F.col("probs")))


def ids(spark, sf) -> DataFrame:
    """Class ids and made-up confidences of the characters of part names, with an end symbol in the middle of some."""
    table = F.array(*[F.lit(c) for c in CHARSET])
    chars = F.filter(F.split(F.lower("p_name"), ""), lambda c: F.array_position(table, c) > 0)
    path = F.transform(chars, lambda c, i: F.struct(F.when((i == 4) & (F.col("p_partkey") % 3 == 0), F.lit(0)).otherwise(F.array_position(table, c).cast("int")).alias("id"), ((F.ascii(c) % 50 + i) / 100.0).alias("p")))
    return read(spark, sf, "part").select("p_partkey", path.alias("path"))


def truths(spark, sf, lines: DataFrame | None = None) -> DataFrame:
    a, n = F.col("l_orderkey"), F.col("l_linenumber")
    return (read(spark, sf, "lineitem") if lines is None else lines).select(a.alias("image_id"), n.alias("gt_id"), G.box(n * 150, a * 7 % 400, 100 + a % 40, 30 + n).alias("box"), F.col("l_returnflag").alias("text"), (n % 7 == 5).alias("dont_care"))


def detections(spark, sf, lines: DataFrame | None = None) -> DataFrame:
    a, n = F.col("l_orderkey"), F.col("l_linenumber")
    b = G.box(n * 150 + a % 13, a * 7 % 400 + n % 3, 100 + a % 40 - a % 5 * 8, 30 + n)
    return (read(spark, sf, "lineitem") if lines is None else lines).where("l_partkey % 10 <> 0").select(a.alias("image_id"), n.alias("det_id"), b.alias("box"), F.col("l_returnflag").alias("text"))


V_TEXTS = """t AS (SELECT CAST(user_id AS VARCHAR) AS video_id, event_id, epoch_us(ts) / 1e6 AS ts, event_type AS text, value / 500 AS score,
  CAST(100 + length(event_type) * 97 % 500 + event_id % 11 * 4 AS DOUBLE) AS x, CAST(400 + ascii(event_type) * 13 % 200 AS DOUBLE) AS y, 200.0 AS w, 40.0 AS h FROM events)"""
V_BOXES = """b AS (SELECT event_id, user_id AS image_id, CAST(event_id * 37 % 1200 AS DOUBLE) AS x, CAST(event_id * 53 % 640 AS DOUBLE) AS y,
  CAST(40 + event_id * 13 % 400 AS DOUBLE) AS w, CAST(16 + event_id * 7 % 48 AS DOUBLE) AS h, value / 500 AS score FROM events)"""
V_VIDEOS = """v AS (SELECT n_name AS video_id, CAST(10 + n_nationkey * 1.25 AS DOUBLE) AS fps, CAST(1000 + n_nationkey * 37 AS BIGINT) AS total_frames,
  n_nationkey * 80 + 320 AS width, n_nationkey * 45 + 180 AS height FROM nation),
 st AS (SELECT *, greatest(1, CAST(round_even(0.5 * fps, 0) AS BIGINT)) AS stride FROM v)"""
V_PAIRS = """p AS (SELECT p_partkey AS sample_id, p_name AS pred, p_type AS target, p_size % 6 + 1 AS ratio, p_retailprice AS elapse FROM part)"""
V_COMPARED = (
    V_PAIRS
    + """, c AS (SELECT *, replace(pred, ' ', '') AS ps, replace(target, ' ', '') AS ts, lower(regexp_replace(pred, '[^0-9A-Za-z]', '', 'g')) AS pf,
  lower(regexp_replace(target, '[^0-9A-Za-z]', '', 'g')) AS tf FROM p),
 d AS (SELECT *, CASE WHEN greatest(length(pf), length(tf)) = 0 THEN 0.0 ELSE CAST(levenshtein(pf, tf) AS DOUBLE) / greatest(length(pf), length(tf)) END AS dist FROM c)"""
)
V_PROBS = """e AS (SELECT vec_id, [embedding[t * 8 + 1:t * 8 + 8] FOR t IN range(0, 8)] AS probs FROM embeddings),
 q AS (SELECT vec_id, unnest(probs) AS row, generate_subscripts(probs, 1) - 1 AS t FROM e),
 k AS (SELECT vec_id, t, row, list_position(row, list_max(row)) - 1 AS id, CAST(list_max(row) AS DOUBLE) AS p FROM q)"""
V_GT = """g AS (SELECT l_orderkey AS image_id, l_linenumber AS gt_id, CAST(l_linenumber * 150 AS DOUBLE) AS x, CAST(l_orderkey * 7 % 400 AS DOUBLE) AS y,
  CAST(100 + l_orderkey % 40 AS DOUBLE) AS w, CAST(30 + l_linenumber AS DOUBLE) AS h, l_linenumber % 7 = 5 AS dont_care FROM lineitem),
 d AS (SELECT l_orderkey AS image_id, l_linenumber AS det_id, CAST(l_linenumber * 150 + l_orderkey % 13 AS DOUBLE) AS x, CAST(l_orderkey * 7 % 400 + l_linenumber % 3 AS DOUBLE) AS y,
  CAST(100 + l_orderkey % 40 - l_orderkey % 5 * 8 AS DOUBLE) AS w, CAST(30 + l_linenumber AS DOUBLE) AS h FROM lineitem WHERE l_partkey % 10 <> 0),
 o AS (SELECT g.image_id, gt_id, det_id, g.dont_care, greatest(0, least(g.x + g.w, d.x + d.w) - greatest(g.x, d.x)) * greatest(0, least(g.y + g.h, d.y + d.h) - greatest(g.y, d.y)) AS inter,
  g.w * g.h AS ga, d.w * d.h AS da FROM g JOIN d USING (image_id) WHERE g.x < d.x + d.w AND d.x < g.x + g.w AND g.y < d.y + d.h AND d.y < g.y + g.h),
 s AS (SELECT image_id, gt_id, det_id, round_even(inter / ga, 2) AS sigma, round_even(inter / da, 2) AS tau FROM o)"""
_IOU = lambda a, b: f"(greatest(0, least({a}x + {a}w, {b}x + {b}w) - greatest({a}x, {b}x)) * greatest(0, least({a}y + {a}h, {b}y + {b}h) - greatest({a}y, {b}y)))"


def _iou_sql(a: str, b: str) -> str:
    i = _IOU(a, b)
    return f"({i} / ({a}w * {a}h + {b}w * {b}h - {i} + 1e-6))"


# Sampling plans


@query(f"WITH {V_VIDEOS} SELECT video_id, stride, CAST(ceil(CAST(total_frames AS DOUBLE) / stride) AS BIGINT) AS samples FROM st")
def frame_stride_plan(spark, sf):
    s = sampling.stride(0.5, F.col("fps"))
    return videos(spark, sf).select("video_id", s.alias("stride"), F.ceil(F.col("total_frames") / s).alias("samples"))


@query(f"WITH {V_VIDEOS} SELECT video_id, frame_idx, frame_idx / fps AS ts FROM (SELECT video_id, fps, unnest(range(0, total_frames, stride)) AS frame_idx FROM st)")
def sample_modulo(spark, sf):
    return sampling.modulo(videos(spark, sf), 0.5)


@query(f"WITH {V_VIDEOS} SELECT video_id, n - 1 AS frame_idx, n / fps AS ts FROM (SELECT video_id, fps, unnest(range(stride, total_frames + 1, stride)) AS n FROM st)")
def sample_sequential(spark, sf):
    return sampling.sequential(videos(spark, sf), 0.5)


_SEGMENTS = f"WITH {V_VIDEOS}, sg AS (SELECT video_id, fps, stride, total_frames, CAST(trunc(fps * 7.7) AS BIGINT) AS size FROM st), ss AS (SELECT *, unnest(range(0, total_frames, size)) AS s FROM sg)"


@query(_SEGMENTS + " SELECT video_id, frame_idx, frame_idx / fps AS ts FROM (SELECT video_id, fps, unnest(range(s, least(s + size, total_frames), stride)) AS frame_idx FROM ss)")
def sample_segmented(spark, sf):
    return sampling.segmented(videos(spark, sf), 0.5, 7.7)


@query(_SEGMENTS + ' SELECT video_id, fps, s AS start, least(s + size, total_frames) AS "end" FROM ss')
def segments_by_time(spark, sf):
    return sampling.time_segments(videos(spark, sf), 7.7)


@query(f'WITH {V_VIDEOS} SELECT video_id, CAST(part AS INTEGER) AS part, total_frames // 4 * part AS start, CASE WHEN part = 3 THEN total_frames ELSE total_frames // 4 * (part + 1) END AS "end" FROM (SELECT video_id, total_frames, unnest(range(0, 4)) AS part FROM st)')
def segments_even(spark, sf):
    return sampling.even_segments(videos(spark, sf), 4)


@query(
    f"""WITH {V_VIDEOS}, u AS (SELECT video_id, total_frames / fps AS d, fps, height * width * 3 * 4 / 1048576.0 AS mb FROM v)
SELECT video_id, round(CASE WHEN d < 180 THEN d WHEN d < 600 THEN greatest(60.0, d / 3) WHEN d < 1800 THEN greatest(60.0, d / 10)
  ELSE greatest(30.0, least(300.0, 8.0 * 0.6 * 1024 / (mb * 5) / fps)) END, 6) AS seconds FROM u"""
)
def segment_policy(spark, sf):
    s = sampling.segment_seconds(F.col("total_frames") / F.col("fps"), F.col("fps"), F.col("width"), F.col("height"), 60)
    return videos(spark, sf).select("video_id", F.round(s, 6).alias("seconds"))


@query(f"WITH {V_VIDEOS} SELECT video_id, greatest(1, least(CAST(trunc((8.0 - 2.5) * 0.8 * 1073741824 / (height * width * 3 * 4 * 5)) AS BIGINT), 32)) AS frames FROM v")
def batch_size_hint(spark, sf):
    return videos(spark, sf).select("video_id", sampling.batch_size(F.col("height"), F.col("width"), F.lit(8.0), F.lit(2.5)).alias("frames"))


# Geometry


@query(
    """WITH r AS (SELECT n_nationkey AS id, n_nationkey * 2 || ',' || CASE WHEN n_nationkey % 4 = 0 THEN '0.5' WHEN n_nationkey % 4 = 1 THEN 'x' ELSE ' 60' END || ', 90,' || CASE WHEN n_nationkey % 5 = 0 THEN '1,2' ELSE '97' END AS roi FROM nation),
 a AS (SELECT id, list_transform(string_split(roi, ','), lambda p: TRY_CAST(trim(p) AS DOUBLE)) AS v FROM r),
 s AS (SELECT id, v, len(v) = 4 AND len(list_filter(v, lambda x: x IS NULL)) = 0 AS ok, CASE WHEN list_max(v) > 1 THEN 100.0 ELSE 1.0 END AS k FROM a)
SELECT id, CASE WHEN ok THEN v[1] / k END AS x1, CASE WHEN ok THEN v[2] / k END AS y1, CASE WHEN ok THEN v[3] / k END AS x2, CASE WHEN ok THEN v[4] / k END AS y2 FROM s"""
)
def roi_parse(spark, sf):
    k = F.col("n_nationkey")
    roi = F.concat((k * 2).cast("string"), F.lit(","), F.when(k % 4 == 0, "0.5").when(k % 4 == 1, "x").otherwise(" 60"), F.lit(", 90,"), F.when(k % 5 == 0, "1,2").otherwise("97"))
    return read(spark, sf, "nation").select(k.alias("id"), G.parse_roi(roi).alias("r")).select("id", "r.x1", "r.y1", "r.x2", "r.y2")


@query(f"WITH {V_BOXES} SELECT event_id, x, y, w, h FROM b")
def box_xywh(spark, sf):
    return boxes(spark, sf).select("event_id", G.bounding_box(F.col("quad")).alias("b")).select("event_id", "b.*")


@query(f"WITH {V_BOXES} SELECT event_id FROM b WHERE x >= trunc(0.1 * 1280) AND y >= trunc(0.6 * 720) AND x + w <= trunc(0.9 * 1280) AND y + h <= trunc(0.97 * 720)")
def roi_filter(spark, sf):
    return filters.by_roi(boxes(spark, sf), "10,60,90,97", W, H).select("event_id")


@query(f"WITH {V_BOXES} SELECT event_id FROM b WHERE w / 1280 BETWEEN 0.02 AND 0.9 AND h / 720 BETWEEN 0.02 AND 0.09 AND w / 1280 <= 0.3")
def size_filter(spark, sf):
    return filters.by_size(boxes(spark, sf), W, H, (0.02, 0.02), (0.3, 0.09)).select("event_id")


@query(f"WITH {V_BOXES}, l AS (SELECT *, lag(x) OVER o AS px, lag(y) OVER o AS py, lag(w) OVER o AS pw, lag(h) OVER o AS ph FROM b WINDOW o AS (PARTITION BY image_id ORDER BY event_id)) SELECT event_id, round({_iou_sql('l.', 'l.p')}, 9) AS iou FROM l WHERE px IS NOT NULL")
def iou_consecutive(spark, sf):
    w = Window.partitionBy("image_id").orderBy("event_id")
    rows = boxes(spark, sf).withColumn("prev", F.lag("box").over(w)).where("prev is not null")
    return rows.select("event_id", F.round(G.iou(F.col("box"), F.col("prev")), 9).alias("iou"))


@query(f"WITH {V_BOXES} SELECT a.event_id AS a, c.event_id AS b, round({_iou_sql('a.', 'c.')}, 9) AS iou FROM b AS a JOIN b AS c ON a.image_id = c.image_id AND a.event_id < c.event_id WHERE {_iou_sql('a.', 'c.')} > 0.2")
def iou_pairs_theta(spark, sf):
    a, b = boxes(spark, sf).alias("a"), boxes(spark, sf).alias("b")
    both = a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.event_id") < F.col("b.event_id")) & (G.iou(F.col("a.box"), F.col("b.box")) > 0.2))
    return both.select(F.col("a.event_id").alias("a"), F.col("b.event_id").alias("b"), F.round(G.iou(F.col("a.box"), F.col("b.box")), 9).alias("iou"))


@query(
    f"""WITH {V_BOXES}, c AS (SELECT event_id, greatest(0, CAST(trunc(x) AS BIGINT)) AS a, greatest(0, CAST(trunc(y) AS BIGINT)) AS o, least(1280, CAST(trunc(x + w) AS BIGINT)) AS z, least(720, CAST(trunc(y + h) AS BIGINT)) AS u FROM b),
 d AS (SELECT *, CAST(trunc((z - a) * 0.05) AS BIGINT) AS m, CAST(trunc((u - o) * 0.05) AS BIGINT) AS n FROM c)
SELECT event_id, greatest(0, a - m) AS x1, greatest(0, o - n) AS y1, least(1280, z + m) AS x2, least(720, u + n) AS y2 FROM d"""
)
def padded_crop_rect(spark, sf):
    return boxes(spark, sf).select("event_id", G.padded_crop(F.col("box"), W, H).alias("r")).select("event_id", "r.*")


def _limited_sql(ratio: str) -> str:
    return f"""WITH {V_VIDEOS}, r AS (SELECT video_id, CAST(width AS DOUBLE) AS w, CAST(height AS DOUBLE) AS h FROM v), k AS (SELECT *, {ratio} AS k FROM r),
 s AS (SELECT *, greatest(CAST(round_even(trunc(h * k) / 32, 0) AS BIGINT) * 32, 32) AS nh, greatest(CAST(round_even(trunc(w * k) / 32, 0) AS BIGINT) * 32, 32) AS nw FROM k)
SELECT video_id, nh AS h, nw AS w, nh / h AS ratio_h, nw / w AS ratio_w FROM s"""


def _limited(spark, sf, limit, kind):
    return videos(spark, sf).select("video_id", G.limited_size(F.col("width"), F.col("height"), limit, kind).alias("s")).select("video_id", "s.*")


@query(_limited_sql("CASE WHEN greatest(w, h) > 960 THEN 960 / greatest(w, h) ELSE 1.0 END"))
def det_resize_max(spark, sf):
    return _limited(spark, sf, 960, "max")


@query(_limited_sql("CASE WHEN least(w, h) < 736 THEN 736 / least(w, h) ELSE 1.0 END"))
def det_resize_min(spark, sf):
    return _limited(spark, sf, 736, "min")


@query(_limited_sql("960 / greatest(w, h)"))
def det_resize_long(spark, sf):
    return _limited(spark, sf, 960, "resize_long")


@query(f"WITH {V_VIDEOS} SELECT video_id, 736 AS h, CAST(ceil(width * 736 / CAST(height AS DOUBLE) / 32) AS BIGINT) * 32 AS w FROM v")
def det_resize_fixed(spark, sf):
    return videos(spark, sf).select("video_id", G.fixed_size(F.col("width"), F.col("height"), 736, 1280, True).alias("s")).select("video_id", F.col("s.h").cast("int").alias("h"), "s.w")


@query(f"WITH {V_VIDEOS}, r AS (SELECT video_id, width, height, 960.0 / greatest(width, height) AS k FROM v) SELECT video_id, (CAST(trunc(height * k) AS BIGINT) + 127) // 128 * 128 AS h, (CAST(trunc(width * k) AS BIGINT) + 127) // 128 * 128 AS w FROM r")
def det_resize_stride128(spark, sf):
    return videos(spark, sf).select("video_id", G.long_size(F.col("width"), F.col("height"), 960).alias("s")).select("video_id", "s.h", "s.w")


_STRIDED = lambda side: f"(CAST(trunc({side} * k) AS BIGINT) + 127) // 128 * 128"


@query(f"WITH {V_VIDEOS}, r AS (SELECT video_id, width, height, 512.0 / least(width, height) AS k FROM v) SELECT video_id, {_STRIDED('height')} AS h, {_STRIDED('width')} AS w FROM r")
def det_resize_shorter(spark, sf):
    return videos(spark, sf).select("video_id", G.strided_size(F.col("width"), F.col("height"), 512, "min").alias("s")).select("video_id", "s.h", "s.w")


@query(f"WITH {V_VIDEOS}, r AS (SELECT video_id, width, height, CASE WHEN height * 1.25 > 768 THEN CAST(768.0 AS DOUBLE) / height ELSE CAST(1.25 AS DOUBLE) END AS k FROM v) SELECT video_id, {_STRIDED('height')} AS h, {_STRIDED('width')} AS w FROM r")
def det_resize_enlarged(spark, sf):
    return videos(spark, sf).select("video_id", G.strided_size(F.col("width"), F.col("height"), 768, "enlarge").alias("s")).select("video_id", "s.h", "s.w")


@query(f"WITH {V_VIDEOS} SELECT video_id, CAST(CASE WHEN total_frames / fps < 60 THEN least(64, height % 50 * 2) ELSE height % 50 END AS BIGINT) AS frames FROM v")
def batch_of_short_videos(spark, sf):
    duration = F.col("total_frames") / F.col("fps")
    return videos(spark, sf).select("video_id", sampling.frames_at_once(duration, F.col("height") % 50, short=60).cast("long").alias("frames"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS clock FROM events")
def clock_text(spark, sf):
    return read(spark, sf, "events").select("event_id", T.clock(F.col("ts")).alias("clock"))


@query(
    f"""WITH {V_PAIRS}, c AS (SELECT replace(pred, ' ', '') AS a, replace(target, ' ', '') AS b FROM p),
 g AS (SELECT length(b) AS bucket, count(*) AS num, count(*) FILTER (a = b) AS correct, sum(CASE WHEN greatest(length(a), length(b)) = 0 THEN 0.0 ELSE CAST(levenshtein(a, b) AS DOUBLE) / greatest(length(a), length(b)) END) AS dist FROM c GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bucket, coalesce(num, 0) AS num, round(coalesce(correct, 0) / (coalesce(num, 0) + 1e-5), 9) AS acc, round(1.0 - coalesce(dist, 0) / (coalesce(num, 0) + 1e-5), 6) AS norm_edit_dis FROM range(201) AS r(i) LEFT JOIN g ON g.bucket = i"""
)
def rec_long_by_length(spark, sf):
    return metrics.long_by_length(spark, pairs(spark, sf)).select("bucket", "num", F.round("acc", 9).alias("acc"), F.round("norm_edit_dis", 6).alias("norm_edit_dis"))


@query("SELECT p_partkey, CASE WHEN w + h < 64 THEN greatest(32, h) ELSE h END AS h, CASE WHEN w + h < 64 THEN greatest(32, w) ELSE w END AS w FROM (SELECT p_partkey, p_size AS w, p_size * 2 % 50 AS h FROM part)")
def small_image_pad(spark, sf):
    return read(spark, sf, "part").select("p_partkey", G.least_padded(F.col("p_size"), F.col("p_size") * 2 % 50).alias("s")).select("p_partkey", "s.h", "s.w")


def _tiles_sql(size: int, lap: int) -> str:
    return f"""WITH {V_VIDEOS}, z AS (SELECT video_id, CAST(width AS BIGINT) AS w, CAST(height AS BIGINT) AS h FROM v), big AS (SELECT * FROM z WHERE NOT (w <= {size} AND h <= {size})),
 y AS (SELECT *, unnest(range(0, h - {lap}, {size - lap})) AS t FROM big), x AS (SELECT *, unnest(range(0, w - {lap}, {size - lap})) AS l FROM y)
SELECT video_id, CASE WHEN l + {size} >= w THEN greatest(0, w - {size}) ELSE l END AS "left", CASE WHEN t + {size} >= h THEN greatest(0, h - {size}) ELSE t END AS top,
  least(l + {size}, w) AS "right", least(t + {size}, h) AS bottom FROM x
UNION ALL SELECT video_id, 0, 0, w, h FROM z WHERE w <= {size} AND h <= {size}"""


@query(_tiles_sql(640, 64))
def tile_grid(spark, sf):
    return videos(spark, sf).select("video_id", F.explode(G.tiles(F.col("width"), F.col("height"))).alias("t")).select("video_id", "t.*")


@query(_tiles_sql(640, 320))
def tile_grid_half(spark, sf):
    return videos(spark, sf).select("video_id", F.explode(G.tiles(F.col("width"), F.col("height"), 640, 320)).alias("t")).select("video_id", "t.*")


@query(f"WITH {V_VIDEOS} SELECT video_id, CAST(CASE WHEN height > width THEN 1216 ELSE height * 1216 // width END AS BIGINT) AS h, CAST(CASE WHEN height > width THEN width * 1216 // height ELSE 1216 END AS BIGINT) AS w FROM v")
def tiled_detection_scale(spark, sf):
    return videos(spark, sf).select("video_id", G.two_tile_size(F.col("width"), F.col("height")).alias("s")).select("video_id", "s.h", "s.w")


@query(f"WITH {V_VIDEOS} SELECT video_id, CAST(trunc(width * 0.37) AS BIGINT) AS w, CAST(trunc(height * 0.37) AS BIGINT) AS h FROM v")
def frame_resize_dims(spark, sf):
    return videos(spark, sf).select("video_id", G.scaled_size(F.col("width"), F.col("height"), 0.37).alias("s")).select("video_id", "s.*")


def _slanted(b):
    """A quad whose right side hangs by a tenth of the width."""
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    d, r = b["w"] * 0.1, b["x"] + b["w"]
    return F.array(at(r, b["y"] + d), at(b["x"], b["y"]), at(b["x"], b["y"] + b["h"]), at(r, b["y"] + b["h"] + d))


_SLANT = f"WITH {V_BOXES}, q AS (SELECT event_id, x, y, x + w AS r, y + h AS u, w * 0.1 AS d, w, h FROM b)"


@query(_SLANT + " SELECT event_id, CAST(trunc(sqrt((r - x) * (r - x) + d * d)) AS BIGINT) AS w, CAST(trunc(h) AS BIGINT) AS h, trunc(h) / trunc(sqrt((r - x) * (r - x) + d * d)) >= 1.5 AS turned FROM q")
def crop_dims(spark, sf):
    return boxes(spark, sf).select("event_id", G.crop_dims(G.ordered_corners(_slanted(F.col("box")))).alias("c")).select("event_id", "c.*")


@query(_SLANT + " SELECT event_id, x AS x0, y AS y0, r AS x1, y + d AS y1, r AS x2, u + d AS y2, x AS x3, u AS y3 FROM q")
def corner_order(spark, sf):
    rows = boxes(spark, sf).select("event_id", G.ordered_corners(_slanted(F.col("box"))).alias("q"))
    return rows.select("event_id", *[F.col("q")[i][k].alias(f"{k}{i}") for i in range(4) for k in "xy"])


@query(_SLANT + " SELECT event_id, round(w * h, 6) AS area, round(w * h * 1.5 / (2 * h + 2 * sqrt(w * w + d * d)), 6) AS unclip FROM q")
def unclip_distance(spark, sf):
    q = G.ordered_corners(_slanted(F.col("box")))
    return boxes(spark, sf).select("event_id", F.round(G.polygon_area(q), 6).alias("area"), F.round(G.unclip_distance(q), 6).alias("unclip"))


@query(f"WITH {V_BOXES} SELECT event_id, least(greatest(CAST(round_even(x / 640 * 1000, 0) AS BIGINT), 0), 1000) AS x, least(greatest(CAST(round_even(y / 360 * 500, 0) AS BIGINT), 0), 500) AS y FROM b")
def rescale_clip(spark, sf):
    return boxes(spark, sf).select("event_id", G.rescaled(F.col("box.x"), 640, 1000).alias("x"), G.rescaled(F.col("box.y"), 360, 500).alias("y"))


@query(
    f"""WITH {V_BOXES}, r AS (SELECT event_id, w, h, least(CAST(trunc(w / h) AS BIGINT) + 1, 12) AS k FROM b)
SELECT event_id, CASE k WHEN 1 THEN 64 WHEN 2 THEN 96 WHEN 3 THEN 112 WHEN 4 THEN 128 ELSE 32 * k END AS w, CASE k WHEN 1 THEN 64 WHEN 2 THEN 48 WHEN 3 THEN 40 ELSE 32 END AS h,
  greatest(1, CAST(round_even(w / h, 0) AS BIGINT)) AS bucket, least(1.0, w / 320) AS valid FROM r"""
)
def rec_target_size(spark, sf):
    w, h = F.col("box.w"), F.col("box.h")
    rows = boxes(spark, sf).select("event_id", G.recognition_size(w, h).alias("s"), G.aspect_bucket(w, h).alias("bucket"), G.valid_ratio(w, 320).alias("valid"))
    return rows.select("event_id", "s.w", F.col("s.h").cast("int").alias("h"), "bucket", "valid")


_LINE_KINDS = ("stretch", "pad", "ratio", "dynamic", "steps", "thirds")


@query(
    f"""WITH {V_BOXES}, r AS (SELECT event_id, w / 3 AS w, h, least(greatest(1, CAST(round_even(w / 3 / h, 0) AS BIGINT)), 12) AS k FROM b),
 s AS (SELECT *, CASE k WHEN 1 THEN 64 WHEN 2 THEN 96 WHEN 3 THEN 112 WHEN 4 THEN 128 ELSE 32 * k END AS rw, CASE k WHEN 1 THEN 64 WHEN 2 THEN 48 WHEN 3 THEN 40 ELSE 32 END AS rh, CAST(ceil(32 * (w / h)) AS BIGINT) AS fit,
   CAST(trunc(32 * greatest(w / h, CAST(4.0 AS DOUBLE))) AS BIGINT) AS dw FROM r),
 t AS (SELECT *, greatest(48, CASE WHEN fit % 4 <> 0 THEN CAST(round_even(fit / 4, 0) AS BIGINT) * 4 ELSE fit END) AS near FROM s),
 u AS (SELECT event_id, 'stretch' AS kind, 32 AS h, 128 AS w, 128 AS resized_w, 1.0 AS valid_ratio FROM t
  UNION ALL SELECT event_id, 'pad', 32, 128, least(fit, 128), least(1.0, CAST(least(fit, 128) AS DOUBLE) / 128) FROM t
  UNION ALL SELECT event_id, 'ratio', rh, rw, least(CAST(ceil(rh * (w / h)) AS BIGINT), rw), least(1.0, CAST(least(CAST(ceil(rh * (w / h)) AS BIGINT), rw) AS DOUBLE) / rw) FROM t
  UNION ALL SELECT event_id, 'dynamic', 32, dw, least(fit, dw), least(1.0, CAST(least(fit, dw) AS DOUBLE) / dw) FROM t
  UNION ALL SELECT event_id, 'steps', 32, 160, least(160, near), least(1.0, CAST(near AS DOUBLE) / 160) FROM t
  UNION ALL SELECT event_id, 'thirds', 32, 128, z, CAST(z AS DOUBLE) / 128 FROM (SELECT event_id, CASE WHEN w <= h THEN 32 WHEN w <= h * 2 THEN 64 WHEN w <= h * 3 THEN 96 ELSE 128 END AS z FROM t))
SELECT event_id, kind, CAST(h AS BIGINT) AS h, CAST(w AS BIGINT) AS w, CAST(resized_w AS BIGINT) AS resized_w, round(CAST(valid_ratio AS DOUBLE), 9) AS valid_ratio FROM u"""
)
def line_sizes(spark, sf):
    w, h = F.col("box.w") / 3, F.col("box.h")
    sizes = F.array(*[F.struct(F.lit(k).alias("kind"), G.line_size(w, h, k).alias("s")) for k in _LINE_KINDS])
    rows = boxes(spark, sf).select("event_id", F.inline(sizes))
    return rows.select("event_id", "kind", "s.h", "s.w", "s.resized_w", F.round("s.valid_ratio", 9).alias("valid_ratio"))


@query(f"WITH {V_BOXES} SELECT image_id, event_id // 64 AS batch, round(max(w / h), 9) AS max_wh FROM b GROUP BY ALL")
def batch_max_ratio(spark, sf):
    return boxes(spark, sf).groupBy("image_id", F.floor(F.col("event_id") / 64).alias("batch")).agg(F.round(F.max(F.col("box.w") / F.col("box.h")), 9).alias("max_wh"))


@query(_SLANT + " SELECT event_id, round(x + w * 0.25, 6) AS x0, round(y + d * 0.25, 6) AS y0, round(x + w * 1.1, 6) AS x2, round(u + d * 1.1, 6) AS y2 FROM q")
def shrink_quad(spark, sf):
    q = G.shrunk_along_width(G.ordered_corners(_slanted(F.col("box"))), 0.25, 1.1)
    rows = boxes(spark, sf).select("event_id", q.alias("q"))
    return rows.select("event_id", *[F.round(F.col("q")[i][k], 6).alias(f"{k}{i}") for i in (0, 2) for k in "xy"])


@query(f"WITH {V_BOXES} SELECT event_id, [x, x + w, x + w / 2, x / 2] AS ring_x FROM b")
def ring_polygon(spark, sf):
    at = lambda x: F.struct(x.alias("x"), F.col("box.y").alias("y"))
    b = F.col("box")
    ring = G.ring(F.array(at(b["x"]), at(b["x"] + b["w"])), F.array(at(b["x"] / 2), at(b["x"] + b["w"] / 2)))
    return boxes(spark, sf).select("event_id", F.transform(ring, lambda p: p["x"]).alias("ring_x"))


@query("SELECT p_partkey, n >= 8 AND n % 2 = 0 AS plain, n >= 8 AND n % 2 = 1 AS scored FROM (SELECT p_partkey, p_size % 14 AS n FROM part)")
def boundary_valid(spark, sf):
    v = F.array_repeat(F.lit(1.0), F.col("p_size") % 14)
    return read(spark, sf, "part").select("p_partkey", G.boundary_ok(v, False).alias("plain"), G.boundary_ok(v, True).alias("scored"))


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), n AS (SELECT vec_id, v, list_max(v) AS top, lead(v) OVER (ORDER BY vec_id) AS u FROM e)
SELECT vec_id, round(sqrt(list_inner_product(v, v)), 5) AS norm, round(list_inner_product(v, u) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(u, u))), 5) AS cosine,
  round(1.0 / list_sum(list_transform(v, lambda x: exp(x - top))), 6) AS top_share FROM n"""
)
def vector_scores(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("u"))
    rows = e.join(nxt, "vec_id", "left")
    v = F.col("embedding")
    return rows.select("vec_id", F.round(G.l2_norm(v), 5).alias("norm"), F.round(G.cosine(v, F.col("u")), 5).alias("cosine"), F.round(F.array_max(G.softmax(v)), 6).alias("top_share"))


@query(_SLANT.replace("SELECT event_id, x", "SELECT event_id, image_id, score, x") + f" SELECT event_id, round({_IOU('a.', 'a.')}, 4) AS own FROM b AS a")
def polygon_self_area(spark, sf):
    q = F.col("quad")
    return boxes(spark, sf).select("event_id", F.round(polygon.polygon_intersection(q, q), 4).alias("own"))


# Texts, frames and tracking


@query(f"WITH {V_TEXTS} SELECT event_id, text FROM t WHERE score >= 0.4 AND trim(text) <> '' AND NOT regexp_full_match(trim(text), '[A-Z]{{1,2}}')")
def score_text_filter(spark, sf):
    return filters.not_logo(filters.not_blank(filters.by_score(texts(spark, sf), 0.4))).select("event_id", "text")


@query(f"WITH {V_TEXTS} SELECT video_id, floor(ts / 21600) * 21600.0 AS ts, count(*) AS n, string_agg(text, '|' ORDER BY event_id) AS lines FROM t GROUP BY ALL")
def frame_texts(spark, sf):
    rows = filters.frame_texts(bucketed(spark, sf))
    return rows.select("video_id", "ts", F.size("texts").cast("long").alias("n"), F.array_join(F.transform("texts", lambda x: x["text"]), "|").alias("lines"))


_TRACK = f"""WITH RECURSIVE {V_TEXTS}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY ts, event_id) AS rn FROM t),
 f AS (SELECT video_id, rn, 0 AS seg, ts AS start_time, ts AS end_time, text, score, x, y, w, h FROM n WHERE rn = 1
  UNION ALL SELECT video_id, rn, CASE WHEN same THEN seg ELSE seg + 1 END, CASE WHEN same THEN start_time ELSE ts END, ts, CASE WHEN same THEN text ELSE nt END,
   CASE WHEN same AND NOT better THEN score ELSE ns END, CASE WHEN same AND NOT better THEN x ELSE nx END, CASE WHEN same AND NOT better THEN y ELSE ny END, w, h
  FROM (SELECT f.video_id, n.rn, f.seg, f.start_time, n.ts, f.text, n.text AS nt, f.score, n.score AS ns, f.x, f.y, n.x AS nx, n.y AS ny, f.w, f.h, n.score > f.score AS better,
     n.text = f.text AND {_iou_sql('f.', 'n.')} > 0.7 * 0.5 AS same FROM f JOIN n ON n.video_id = f.video_id AND n.rn = f.rn + 1)),
 l AS (SELECT *, row_number() OVER (PARTITION BY video_id, seg ORDER BY rn DESC) AS last, max(seg) OVER (PARTITION BY video_id) AS top FROM f)"""


@query(_TRACK + " SELECT video_id, CAST(seg AS BIGINT) AS segment_id, start_time, CASE WHEN seg = top AND start_time = end_time THEN end_time + 0.5 ELSE end_time END AS end_time, text, round(score, 9) AS score, x FROM l WHERE last = 1")
def track_segments(spark, sf):
    rows = folds.track(texts(spark, sf))
    first = F.col("texts")[0]
    return rows.select("video_id", "segment_id", "start_time", "end_time", first["text"].alias("text"), F.round(first["score"], 9).alias("score"), first["box"]["x"].alias("x"))


#: A frame's lines against the one live segment: without a greatest gap, all others close. No two different types are alike enough.
_IN_LISTS = "(greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)))"


@query(
    f"""WITH RECURSIVE {V_TEXTS}, r AS (SELECT video_id, floor(ts / 21600) * 21600.0 AS ts, event_id, {{'text': text, 'score': score, 'x': x, 'y': y, 'w': w, 'h': h}} AS line FROM t),
 n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY ts, event_id) AS rn, row_number() OVER (PARTITION BY video_id, ts ORDER BY event_id) AS k,
   list(line) OVER (PARTITION BY video_id, ts ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lines FROM r),
 f AS (SELECT video_id, rn, 0 AS seg, ts AS start_time, ts AS end_time, lines AS held, false AS joined FROM n WHERE rn = 1
  UNION ALL SELECT video_id, rn, CASE WHEN fresh THEN seg + 1 ELSE seg END, CASE WHEN fresh THEN ts ELSE start_time END, ts,
    CASE WHEN fresh THEN lines WHEN goes AND spot IS NOT NULL THEN held[1:spot - 1] || [line] || held[spot + 1:] ELSE held END, goes
  FROM (SELECT *, k = 1 AND NOT goes AS fresh, list_min(list_filter(range(1, len(held) + 1), lambda i: held[i].text = line.text AND line.score > held[i].score)) AS spot FROM (
    SELECT f.video_id, n.rn, n.k, n.ts, n.line, n.lines, f.seg, f.start_time, f.held,
      CASE WHEN n.k > 1 THEN f.joined ELSE len(list_filter(n.lines, lambda a: len(list_filter(f.held, lambda b: a.text = b.text AND {_IN_LISTS} / (a.w * a.h + b.w * b.h - {_IN_LISTS} + 1e-6) > 0.7 * 0.5)) > 0)) / greatest(len(n.lines), len(f.held)) >= 0.75 END AS goes
    FROM f JOIN n ON n.video_id = f.video_id AND n.rn = f.rn + 1)))
SELECT video_id, CAST(seg AS BIGINT) AS segment_id, start_time, CASE WHEN seg = max(seg) OVER (PARTITION BY video_id) AND start_time = end_time THEN end_time + 0.5 ELSE end_time END AS end_time, lines
FROM (SELECT video_id, seg, any_value(start_time) AS start_time, max(end_time) AS end_time, any_value(CAST(len(held) AS INTEGER)) AS lines FROM f GROUP BY video_id, seg)"""
)
def track_frames(spark, sf):
    rows = folds.track(bucketed(spark, sf))
    return rows.select("video_id", "segment_id", "start_time", "end_time", F.size("texts").alias("lines"))


@query(
    f"""WITH {V_TEXTS}, n AS (SELECT *, CASE WHEN lag(text) OVER o = text THEN 0 ELSE 1 END AS new FROM t WINDOW o AS (PARTITION BY video_id ORDER BY ts)),
 r AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY ts) AS run FROM n)
SELECT video_id, CAST(run AS BIGINT) AS run, text, min(ts) AS start_time, max(ts) AS end_time, count(*) AS frames FROM r GROUP BY ALL"""
)
def track_exact_runs(spark, sf):
    return folds.exact_runs(texts(spark, sf))


_LINE = "{'n': 1, 'cy': y + h / 2, 'h': h, 'w': w, 'at': x, 'edge': x + w, 'x': x, 'y': y, 'r': x + w, 'b': y + h}"


@query(
    f"""WITH RECURSIVE {V_BOXES}, n AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y, event_id) AS rn FROM b),
 f AS (SELECT image_id, rn, [{_LINE}] AS lines FROM n WHERE rn = 1
  UNION ALL SELECT image_id, rn, CASE WHEN spot IS NULL THEN lines || [{_LINE}] ELSE lines[1:spot - 1] || [{{'n': l.n + 1, 'cy': l.cy + y + h / 2, 'h': l.h + h, 'w': l.w + w, 'at': greatest(l.at, x), 'edge': CASE WHEN x > l.at THEN x + w ELSE l.edge END,
     'x': least(l.x, x), 'y': least(l.y, y), 'r': greatest(l.r, x + w), 'b': greatest(l.b, y + h)}}] || lines[spot + 1:] END
  FROM (SELECT *, lines[spot] AS l FROM (SELECT n.*, f.lines, list_min(list_filter(range(1, len(f.lines) + 1), lambda i: abs(n.y + n.h / 2 - f.lines[i].cy / f.lines[i].n) <= 0.5 * f.lines[i].h / f.lines[i].n
     AND n.x - f.lines[i].edge < 0.3 * f.lines[i].w / f.lines[i].n)) AS spot FROM f JOIN n ON n.image_id = f.image_id AND n.rn = f.rn + 1))),
 z AS (SELECT image_id, arg_max(lines, rn) AS lines FROM f GROUP BY 1), u AS (SELECT image_id, unnest(lines) AS l, generate_subscripts(lines, 1) AS i FROM z)
SELECT image_id, CAST(i - 1 AS INTEGER) AS line_idx, CAST(l.n AS INTEGER) AS members, l.x AS x, l.y AS y, l.r - l.x AS w, l.b - l.y AS h FROM u"""
)
def line_merge(spark, sf):
    return folds.line_merge(boxes(spark, sf), ["image_id"])


@query(
    f"""WITH RECURSIVE {V_BOXES}, n AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y, event_id) AS rn FROM b),
 f AS (SELECT image_id, rn, event_id, x, 0 AS line, y AS first_y FROM n WHERE rn = 1
  UNION ALL SELECT n.image_id, n.rn, n.event_id, n.x, CASE WHEN abs(n.y - f.first_y) >= 10 THEN f.line + 1 ELSE f.line END, CASE WHEN abs(n.y - f.first_y) >= 10 THEN n.y ELSE f.first_y END FROM f JOIN n ON n.image_id = f.image_id AND n.rn = f.rn + 1)
SELECT image_id, CAST(event_id AS INTEGER) AS box_idx, CAST(row_number() OVER (PARTITION BY image_id ORDER BY line, x, rn) - 1 AS INTEGER) AS place FROM f"""
)
def reading_order_rows(spark, sf):
    return folds.reading_order(boxes(spark, sf), ["image_id"])


@query(
    f"""WITH RECURSIVE {V_BOXES}, n AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y, x, event_id) AS rn FROM b),
 f AS (SELECT image_id, rn, [{{'id': event_id, 'x': x, 'y': y}}] AS held FROM n WHERE rn = 1
  UNION ALL SELECT image_id, rn, held[1:spot] || [{{'id': event_id, 'x': x, 'y': y}}] || held[spot + 1:]
  FROM (SELECT n.*, f.held, coalesce(list_max(list_filter(range(1, len(f.held) + 1), lambda i: NOT (abs(n.y - f.held[i].y) < 10 AND n.x < f.held[i].x))), 0) AS spot FROM f JOIN n ON n.image_id = f.image_id AND n.rn = f.rn + 1)),
 z AS (SELECT image_id, arg_max(held, rn) AS held FROM f GROUP BY 1)
SELECT image_id, CAST(unnest(held).id AS INTEGER) AS box_idx, CAST(generate_subscripts(held, 1) - 1 AS INTEGER) AS place FROM z"""
)
def reading_order_swaps(spark, sf):
    return folds.reading_order(boxes(spark, sf), ["image_id"], swaps=True)


@query(
    f"""WITH RECURSIVE {V_BOXES}, n AS (SELECT *, {{'id': event_id, 'score': score, 'x': x, 'y': y, 'w': w, 'h': h}} AS a, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, event_id DESC) AS rn FROM b),
 f AS (SELECT image_id, rn, [a] AS kept FROM n WHERE rn = 1
  UNION ALL SELECT n.image_id, n.rn, CASE WHEN len(list_filter(f.kept, lambda b: {_IN_LISTS.replace("a.", "n.a.")} > 0.3 * (n.a.w * n.a.h + b.w * b.h - {_IN_LISTS.replace("a.", "n.a.")}))) = 0 THEN f.kept || [n.a] ELSE f.kept END FROM f JOIN n ON n.image_id = f.image_id AND n.rn = f.rn + 1),
 z AS (SELECT image_id, arg_max(kept, rn) AS kept FROM f GROUP BY 1), u AS (SELECT image_id, unnest(kept) AS k, generate_subscripts(kept, 1) AS i FROM z)
SELECT image_id, CAST(k.id AS INTEGER) AS box_idx, k.score AS score, CAST(i - 1 AS INTEGER) AS place FROM u"""
)
def nms(spark, sf):
    return folds.nms(boxes(spark, sf), ["image_id"])


@query(
    """WITH RECURSIVE p AS (SELECT doc_id, text, (greatest(length(text), 1) - 1) // 12 AS top FROM documents),
 s AS (SELECT doc_id, top, i, substr(text, i * 12 + 1, 18) AS s, i % 5 / 10 + 0.5 AS conf FROM (SELECT *, unnest(range(0, top + 1)) AS i FROM p)),
 b AS (SELECT doc_id, top, i, conf, CASE WHEN i = 0 THEN left(s, length(s) - 1) WHEN i = top THEN substr(s, 2) ELSE substr(s, 2, greatest(length(s) - 2, 0)) END AS body FROM s),
 f AS (SELECT doc_id, i, body FROM b WHERE i = 0
  UNION ALL SELECT b.doc_id, b.i, substr(b.body, 1 + coalesce(list_max(list_filter(range(1, length(f.body) + 1), lambda k: left(b.body, k) = right(f.body, k))), 0)) FROM f JOIN b ON b.doc_id = f.doc_id AND b.i = f.i + 1)
SELECT f.doc_id, string_agg(f.body, '' ORDER BY i) AS text, round(any_value(m.conf), 9) AS conf FROM f JOIN (SELECT doc_id, avg(conf) AS conf FROM b GROUP BY 1) AS m USING (doc_id) GROUP BY f.doc_id"""
)
def stream_stitch(spark, sf):
    docs = read(spark, sf, "documents")
    chunk = F.posexplode(F.sequence(F.lit(0), F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / 12).cast("int"))).alias("chunk_idx", "i")
    rows = docs.select("doc_id", "text", chunk).select("doc_id", "chunk_idx", F.substring(F.col("text"), F.col("i") * 12 + 1, F.lit(18)).alias("text"), (F.col("i") % 5 / 10 + 0.5).alias("conf"))
    return folds.stitch(rows, "doc_id").withColumn("conf", F.round("conf", 9))


_CUES = "s AS (SELECT conv_id AS video_id, turn AS segment_id, turn * 1.75 + conv_id % 7 AS a, turn * 1.75 + conv_id % 7 + (turn % 3) * 0.7 AS z, text FROM conversations), c AS (SELECT video_id, segment_id, a, CASE WHEN z - a < 1.0 THEN a + 1.0 ELSE z END + 1.0 AS z, text FROM s)"


def _conversation_segments(spark, sf) -> DataFrame:
    c = read(spark, sf, "conversations")
    start = F.col("turn") * 1.75 + F.col("conv_id") % 7
    item = F.struct(F.col("text").alias("text"), F.lit(1.0).alias("score"), G.box(0, 0, 1, 1).alias("box"))
    return c.select(F.col("conv_id").alias("video_id"), F.col("turn").alias("segment_id"), start.alias("start_time"), (start + F.col("turn") % 3 * 0.7).alias("end_time"), start.alias("timestamp"), F.array(item).alias("texts"))


_TC = lambda x: f"printf('%02d:%02d:%02d,%03d', CAST(floor({x} / 3600) AS BIGINT), CAST(floor(fmod({x}, 3600) / 60) AS BIGINT), CAST(floor(fmod({x}, 60)) AS BIGINT), CAST(floor((fmod({x}, 60) - floor(fmod({x}, 60))) * 1000) AS BIGINT))"


@query(
    f"WITH {_CUES.replace('turn * 1.75', 'CAST(turn AS DOUBLE) * 1.75')}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY a, segment_id) AS idx FROM c) SELECT video_id, CAST(idx AS INTEGER) AS idx, idx || chr(10) || {_TC('a')} || ' --> ' || {_TC('z')} || chr(10) || text AS block FROM n"
)
def srt_cues(spark, sf):
    return sinks.srt_blocks(sinks.cues(_conversation_segments(spark, sf)))


@query(f"WITH {_CUES.replace('turn * 1.75', 'CAST(turn AS DOUBLE) * 1.75').replace('z - a < 1.0 THEN a + 1.0', 'z - a < 2.0 THEN a + 2.0').replace('ELSE z END + 1.0', 'ELSE z END + 0.25')} SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY a, segment_id) AS INTEGER) AS idx, a AS start, z AS end, text FROM c")
def cues_of_two_seconds(spark, sf):
    return sinks.cues(_conversation_segments(spark, sf), least=2.0, extension=0.25)


@query("SELECT line, keep FROM (SELECT page_id || '_' || page_id % 3 || chr(9) || '[]' AS line, true AS keep FROM pages UNION ALL SELECT 'p' || page_id || chr(9) || '[]', true FROM pages)")
def e2e_tsv_keeps_empty(spark, sf):
    name = F.when(F.col("n") == 0, F.concat(F.lit("p"), F.col("page_id").cast("string"))).otherwise(F.col("page_id").cast("string"))
    rows = read(spark, sf, "pages").select("page_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    rows = rows.select(F.concat(name, F.lit(".png")).alias("file"), F.when(F.col("n") == 1, F.col("page_id") % 3).alias("page"), F.expr("cast(array() as array<struct<transcription:string>>)").alias("items"))
    return sinks.end_to_end_tsv(rows, keep_empty=True).withColumn("keep", F.lit(True))


@query(f"WITH {V_TEXTS}, f AS (SELECT video_id, floor(ts / 21600) AS b, count(*) AS n FROM t GROUP BY ALL) SELECT count(*) AS segments, CAST(sum(n) AS BIGINT) AS texts FROM f")
def ocr_summary(spark, sf):
    return sinks.segment_summary(filters.frame_texts(bucketed(spark, sf)))


def _images(spark, sf) -> DataFrame:
    """Orders as images; the events of the same number as their texts, where there are any."""
    images = read(spark, sf, "orders").select((F.col("o_orderkey") % 400).alias("image_idx")).distinct()
    found = texts(spark, sf).where("score >= 0.6").withColumn("image_idx", F.col("event_id") % 700)
    return filters.with_all_images(images, found)


_IMAGES = f"WITH {V_TEXTS}, i AS (SELECT DISTINCT o_orderkey % 400 AS image_idx FROM orders), m AS (SELECT event_id % 700 AS image_idx, count(*) AS n, string_agg(text, '|' ORDER BY y, event_id) AS lines FROM t WHERE score >= 0.6 GROUP BY 1), j AS (SELECT i.image_idx, coalesce(n, 0) AS n, coalesce(lines, '') AS lines FROM i LEFT JOIN m USING (image_idx))"


@query(_IMAGES + " SELECT image_idx, n, lines FROM j")
def images_left_join(spark, sf):
    return _images(spark, sf).select("image_idx", F.size("texts").cast("long").alias("n"), F.array_join(F.transform("texts", lambda x: x["text"]), "|").alias("lines"))


@query(_IMAGES + " SELECT count(*) AS images, count(*) FILTER (n > 0) AS with_text, count(*) FILTER (n > 0) * 100.0 / count(*) AS percent, CAST(sum(n) AS BIGINT) AS boxes FROM j")
def image_summary(spark, sf):
    return sinks.image_summary(_images(spark, sf))


@query(_IMAGES + " SELECT image_idx FROM j WHERE n > 0 ORDER BY image_idx LIMIT 3")
def first_samples(spark, sf):
    return sinks.first_samples(_images(spark, sf)).select("image_idx")


@query(f"WITH {V_TEXTS} SELECT event_id || '.png' AS image_file_name, text AS ocr, score FROM t")
def rec_csv(spark, sf):
    return sinks.recognition_csv(texts(spark, sf).withColumn("filename", F.concat(F.col("event_id").cast("string"), F.lit(".png"))))


@query(f"WITH {V_TEXTS} SELECT 'im/' || event_id || '.png' || chr(9) || text || ' | ' || CAST(event_id AS VARCHAR) AS line FROM t")
def rec_tsv(spark, sf):
    file = F.concat(F.lit("im/"), F.col("event_id").cast("string"), F.lit(".png"))
    return sinks.recognition_tsv(texts(spark, sf).select(file.alias("file"), "text", F.col("event_id").alias("score")))


@query(
    f"""WITH {V_BOXES}, k AS (SELECT image_id, event_id, '{{"points":[[' || CAST(x AS INTEGER) || ',' || CAST(y AS INTEGER) || '],[' || CAST(x + w AS INTEGER) || ',' || CAST(y AS INTEGER) || '],[' || CAST(x + w AS INTEGER) || ',' || CAST(y + h AS INTEGER) || '],[' || CAST(x AS INTEGER) || ',' || CAST(y + h AS INTEGER) || ']]}}' AS item FROM b)
SELECT image_id || chr(9) || '[' || string_agg(item, ',' ORDER BY event_id) || ']' AS line FROM k GROUP BY image_id"""
)
def det_tsv(spark, sf):
    return sinks.detection_tsv(boxes(spark, sf).withColumn("file", F.col("image_id").cast("string")))


@query(
    f"""WITH {V_TEXTS}, g AS (SELECT video_id, count(*) FILTER (score >= 0.9) AS n, string_agg('{{"transcription":"' || text || '"}}', ',' ORDER BY event_id) FILTER (score >= 0.9) AS l FROM t GROUP BY ALL)
SELECT 'v' || video_id || CASE WHEN CAST(video_id AS BIGINT) % 3 = 0 THEN '_1' ELSE '' END || chr(9) || '[' || coalesce(l, '') || ']' AS line FROM g WHERE n > 0 OR CAST(video_id AS BIGINT) % 3 = 0"""
)
def e2e_tsv(spark, sf):
    rows = texts(spark, sf).groupBy("video_id").agg(F.array_sort(F.collect_list(F.when(F.col("score") >= 0.9, F.struct("event_id", F.struct(F.col("text").alias("transcription")).alias("item"))))).alias("l"))
    rows = rows.select(F.concat(F.lit("in/v"), "video_id", F.lit(".jpg")).alias("file"), F.when(F.col("video_id").cast("long") % 3 == 0, 1).alias("page"), F.transform("l", lambda x: x["item"]).alias("items"))
    return sinks.end_to_end_tsv(rows)


@query(
    f"""WITH {V_TEXTS}, f AS (SELECT video_id, min(ts) AS a, max(ts) AS z, count(*) AS n FROM t GROUP BY ALL) SELECT video_id, '{{"n":' || n || ',"text":"' || video_id || '"}}' AS json FROM f"""
)
def json_rows(spark, sf):
    rows = texts(spark, sf).groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("video_id", F.to_json(F.struct("n", F.col("video_id").alias("text"))).alias("json"))


# Text functions and recognition metrics


@query(f"WITH {V_PAIRS} SELECT sample_id, round(CASE WHEN greatest(length(pred), length(target)) = 0 THEN 0.0 ELSE CAST(levenshtein(pred, target) AS DOUBLE) / greatest(length(pred), length(target)) END, 9) AS dist FROM p")
def norm_edit_distance(spark, sf):
    return pairs(spark, sf).select("sample_id", F.round(T.edit_distance(F.col("pred"), F.col("target")), 9).alias("dist"))


@query(
    """WITH RECURSIVE p AS (SELECT p_partkey AS id, lower(replace(p_name, ' ', '')) AS a, lower(replace(p_type, ' ', '')) AS b FROM part),
 l AS (SELECT id, a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda x: 0) AS r FROM p
  UNION ALL SELECT id, a, b, i + 1, list_reduce(list_transform(range(1, length(b) + 1), lambda j: [j]), lambda acc, y: list_append(acc, CASE WHEN substr(a, i + 1, 1) = substr(b, y[1], 1) THEN r[y[1]] + 1 ELSE greatest(r[y[1] + 1], acc[-1]) END), [0]) FROM l WHERE i < length(a))
SELECT id AS sample_id, round(2.0 * r[-1] / (length(a) + length(b)), 9) AS ratio FROM l WHERE i = length(a)"""
)
def text_ratio(spark, sf):
    return read(spark, sf, "part").select(F.col("p_partkey").alias("sample_id"), F.round(T.ratio(F.col("p_name"), F.col("p_type")), 9).alias("ratio"))


@query(
    f"""WITH {V_COMPARED} SELECT round(count(*) FILTER (pf = tf) / (count(*) + 1e-5), 9) AS acc, round(count(*) FILTER (pred = target) / (count(*) + 1e-5), 9) AS acc_real,
  round(count(*) FILTER (lower(pred) = lower(target)) / (count(*) + 1e-5), 9) AS acc_lower, round(count(*) FILTER (ps = ts) / (count(*) + 1e-5), 9) AS acc_ignore_space,
  round(count(*) FILTER (lower(ps) = lower(ts)) / (count(*) + 1e-5), 9) AS acc_ignore_space_lower,
  round(count(*) FILTER (regexp_replace(ps, '[^0-9A-Za-z]', '', 'g') = regexp_replace(ts, '[^0-9A-Za-z]', '', 'g')) / (count(*) + 1e-5), 9) AS acc_ignore_space_symbol,
  round(1.0 - sum(dist) / (count(*) + 1e-5), 6) AS norm_edit_dis, count(*) AS all_num FROM d"""
)
def rec_accuracy(spark, sf):
    rows = metrics.accuracies(metrics.compared(pairs(spark, sf)))
    return rows.select(*[F.round(c, 6 if c == "norm_edit_dis" else 9).alias(c) for c in rows.columns if c != "all_num"], "all_num")


@query(f"WITH {V_COMPARED}, k AS (SELECT greatest(0, least(25, length(tf)) - 1) AS bucket, pf = tf AS ok, dist FROM d), g AS (SELECT bucket, count(*) AS num, count(*) FILTER (ok) AS correct, sum(dist) AS dist FROM k GROUP BY 1) SELECT CAST(i AS INTEGER) AS bucket, coalesce(num, 0) AS num, coalesce(correct, 0) AS correct, round(coalesce(dist, 0), 6) AS dist FROM range(25) AS r(i) LEFT JOIN g ON g.bucket = i")
def rec_by_length(spark, sf):
    return metrics.by_bucket(spark, metrics.compared(pairs(spark, sf)), metrics.length_bucket(), 25).withColumn("dist", F.round("dist", 6))


@query(f"WITH {V_COMPARED}, k AS (SELECT CASE WHEN ratio < 4 THEN ratio - 1 ELSE 3 END AS bucket, pf = tf AS ok, dist FROM d), g AS (SELECT bucket, count(*) AS num, count(*) FILTER (ok) AS correct, sum(dist) AS dist FROM k GROUP BY 1) SELECT CAST(i AS INTEGER) AS bucket, coalesce(num, 0) AS num, coalesce(correct, 0) AS correct, round(coalesce(dist, 0), 6) AS dist FROM range(4) AS r(i) LEFT JOIN g ON g.bucket = i")
def rec_by_ratio(spark, sf):
    return metrics.by_bucket(spark, metrics.compared(pairs(spark, sf)), metrics.ratio_bucket(), 4).withColumn("dist", F.round("dist", 6))


@query(
    f"""WITH {V_PAIRS}, c AS (SELECT replace(pred, ' ', '') AS a, replace(target, ' ', '') AS b FROM p)
SELECT round(count(*) FILTER (a = b) / (count(*) + 1e-5), 9) AS acc, round(count(*) FILTER (starts_with(b, a)) / (count(*) + 1e-5), 9) AS acc_slice,
  round(count(*) FILTER (length(a) >= 1 AND length(b) >= 1 AND a[1] = b[1] AND a[-1] = b[-1]) / (count(*) + 1e-5), 9) AS f_l_acc, round(count(*) FILTER (length(a) = length(b)) / (count(*) + 1e-5), 9) AS len_acc,
  round(1.0 - sum(CASE WHEN greatest(length(a), length(b)) = 0 THEN 0.0 ELSE CAST(levenshtein(a, b) AS DOUBLE) / greatest(length(a), length(b)) END) / (count(*) + 1e-5), 6) AS norm_edit_dis FROM c"""
)
def rec_long(spark, sf):
    rows = metrics.long_accuracies(pairs(spark, sf))
    return rows.select(*[F.round(c, 6 if c == "norm_edit_dis" else 9).alias(c) for c in rows.columns])


@query(
    f"WITH {V_COMPARED} SELECT "
    + ", ".join(f"round(count(*) FILTER (sample_id % 3 = {i} AND pf = tf) / (count(*) FILTER (sample_id % 3 = {i}) + 1e-5), 9) AS {p}acc, round(1.0 - sum(CASE WHEN sample_id % 3 = {i} THEN dist ELSE 0.0 END) / (count(*) FILTER (sample_id % 3 = {i}) + 1e-5), 6) AS {p}norm_edit_dis" for i, p in enumerate(("char_", "bpe_", "wp_")))
    + " FROM d"
)
def rec_by_head(spark, sf):
    rows = pairs(spark, sf).withColumn("head", F.element_at(F.array(F.lit("char"), F.lit("bpe"), F.lit("wp")), (F.col("sample_id") % 3 + 1).cast("int")))
    out = metrics.by_head(metrics.compared(rows), {"char": "char_", "bpe": "bpe_", "wp": "wp_"})
    return out.select(*[F.round(c, 6 if "dis" in c else 9).alias(c) for c in out.columns])


@query(f"WITH {V_PAIRS}, b AS (SELECT least(24, length(pred)) AS bucket, avg(elapse) AS m, count(*) AS n FROM p GROUP BY 1) SELECT round(avg(m), 4) AS avg, round(sum(m * n) / sum(n), 4) AS weighted_avg FROM b")
def len_histogram_latency(spark, sf):
    rows = metrics.latency_means(pairs(spark, sf).select(F.col("pred").alias("text"), "elapse"))
    return rows.select(*[F.round(c, 4).alias(c) for c in rows.columns])


@query(f"WITH {V_PAIRS} SELECT ratio, round(sum(elapse), 3) AS total, round(avg(elapse), 4) AS mean, round(sum(elapse * sample_id) / sum(sample_id), 4) AS weighted FROM p GROUP BY 1")
def mean_times(spark, sf):
    rows = pairs(spark, sf)
    both = metrics.mean_time(rows, ["ratio"]).join(rows.groupBy(F.col("ratio").alias("r")).agg(metrics.weighted_mean("elapse", "sample_id").alias("weighted")), F.col("ratio") == F.col("r"))
    return both.select("ratio", F.round("total", 3).alias("total"), F.round("mean", 4).alias("mean"), F.round("weighted", 4).alias("weighted"))


@query("SELECT event_id, round(median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS median FROM events")
def rolling_median(spark, sf):
    return metrics.rolling_median(read(spark, sf, "events"), "value", ["user_id"], ["ts", "event_id"], 20).select("event_id", "median")


@query("SELECT p_partkey, CAST(length(p_name) - ceil((length(p_name) - length(regexp_replace(p_name, '[A-Za-z0-9\\s]', '', 'g'))) / 2.0) AS BIGINT) AS width, lower(p_brand) IN ('true', 't', '1') AS truth FROM part")
def display_width(spark, sf):
    return read(spark, sf, "part").select("p_partkey", T.display_width(F.col("p_name")).alias("width"), T.truth(F.col("p_brand")).alias("truth"))


@query(r"SELECT doc_id, array_to_string(list_reverse(regexp_extract_all(text, '(?s)[a-zA-Z0-9 :*./%+\-]+|[^a-zA-Z0-9 :*./%+\-]')), '') AS reversed FROM documents")
def rtl_reverse(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.reversed_runs(F.col("text")).alias("reversed"))


@query("SELECT page_id, string_split(url, '/')[-1] AS name, regexp_replace(string_split(url, '/')[-1], '(.)\\.[^.]*$', '\\1') AS stem FROM pages")
def path_parts(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.file_name(F.col("url")).alias("name"), T.stem(F.col("url")).alias("stem"))


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^a-m0-5]', '', 'g') AS kept FROM part")
def charset_strip(spark, sf):
    return read(spark, sf, "part").select("p_partkey", T.within_charset(F.col("p_name"), "abcdefghijklm012345").alias("kept"))


# Decoders and encoders


@query(f"WITH {V_PROBS}, c AS (SELECT *, lag(id) OVER (PARTITION BY vec_id ORDER BY t) AS prev FROM k) SELECT vec_id, t, id FROM c WHERE (prev IS NULL OR id <> prev) AND id <> 0")
def ctc_collapse(spark, sf):
    step = F.filter(F.transform("path", lambda s, i: F.struct(i.cast("long").alias("t"), s["id"].alias("id"))), lambda s: (s["id"] != 0) & ((s["t"] == 0) | (s["id"] != F.get(F.col("path"), (s["t"] - 1).cast("int"))["id"])))
    return paths(spark, sf).select("vec_id", F.inline(step))


_CTC = f"WITH {V_PROBS}, c AS (SELECT *, lag(id) OVER (PARTITION BY vec_id ORDER BY t) AS prev FROM k), m AS (SELECT vec_id, string_agg(substr('abcdefg', CAST(id AS INTEGER), 1), '' ORDER BY t) FILTER (kept) AS text, avg(p) FILTER (kept) AS conf FROM (SELECT *, (prev IS NULL OR id <> prev) AND id <> 0 AS kept FROM c) GROUP BY 1)"


@query(_CTC + " SELECT vec_id, coalesce(text, '') AS text, round(coalesce(conf, 0), 6) AS conf FROM m")
def ctc_decode(spark, sf):
    d = S.decoded(F.col("path"), list("abcdefg"), S.LAYOUTS["ctc"])
    return paths(spark, sf).select("vec_id", d.alias("d")).select("vec_id", "d.text", F.round("d.conf", 6).alias("conf"))


_IDS = """c AS (SELECT p_partkey, list_filter(string_split(lower(p_name), ''), lambda x: x <> '' AND contains('abcdefghijklmnopqrstuvwxyz0123456789', x)) AS l FROM part),
 u AS (SELECT p_partkey, unnest(l) AS ch, generate_subscripts(l, 1) - 1 AS i FROM c),
 x AS (SELECT p_partkey, i, CASE WHEN i = 4 AND p_partkey % 3 = 0 THEN 0 ELSE instr('abcdefghijklmnopqrstuvwxyz0123456789', ch) END AS id, (ascii(ch) % 50 + i) / 100.0 AS p FROM u),
 y AS (SELECT *, max(CASE WHEN id = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY p_partkey ORDER BY i) AS over, min(CASE WHEN id = 0 THEN i END) OVER (PARTITION BY p_partkey) AS stop FROM x)"""


@query(f"WITH {_IDS} SELECT p_partkey, coalesce(string_agg(substr('abcdefghijklmnopqrstuvwxyz0123456789', CAST(id AS INTEGER), 1), '' ORDER BY i) FILTER (over = 0), '') AS text, round(coalesce(avg(p) FILTER (over = 0), 0), 6) AS conf FROM y GROUP BY 1")
def eos_decode(spark, sf):
    d = S.decoded(F.col("path"), CHARSET, S.LAYOUTS["ar"])
    return ids(spark, sf).select("p_partkey", d.alias("d")).select("p_partkey", "d.text", F.round("d.conf", 6).alias("conf"))


@query(f"WITH {_IDS} SELECT p_partkey, round(coalesce(product(p) FILTER (stop IS NULL OR i <= stop), 1), 9) AS product, round(coalesce(exp(sum(ln(p)) / (count(*) + 1e-6)), 1), 6) AS geometric FROM y GROUP BY 1")
def confidence_kinds(spark, sf):
    d = S.decoded(F.col("path"), CHARSET, S.Layout(before=("end",), stop="end", stop_counts=True, confidence="product"))
    g = S.confidence(F.transform("path", lambda s: s["p"]), "geometric")
    return ids(spark, sf).select("p_partkey", F.round(d["conf"], 9).alias("product"), F.round(g, 6).alias("geometric"))


def marked(spark, sf) -> DataFrame:
    """ids(), with special symbols at the beginning, in the middle and beyond the charset's end."""
    k, table = F.col("p_partkey"), F.array(*[F.lit(c) for c in CHARSET])
    chars = F.filter(F.split(F.lower("p_name"), ""), lambda c: F.array_position(table, c) > 0)
    special = lambda i: F.coalesce(*[F.when((i == at) & (k % m == r), F.lit(x)) for at, m, r, x in _SPECIAL])
    path = F.transform(chars, lambda c, i: F.struct(F.coalesce(special(i), F.array_position(table, c).cast("int")).alias("id"), ((F.ascii(c) % 50 + i + 1) / 100.0).alias("p")))
    return read(spark, sf, "part").select("p_partkey", path.alias("path"))


#: place, modulus and remainder of the key, id
_SPECIAL = [(0, 2, 0, 2), (0, 3, 1, 0), (1, 13, 0, 0), (3, 5, 1, 1), (4, 3, 0, 0), (5, 6, 1, 99), (6, 4, 1, 37), (7, 7, 3, 38), (8, 11, 5, 39), (9, 2, 1, 40), (10, 3, 1, 3)]
_MARKED = """c AS (SELECT p_partkey, list_filter(string_split(lower(p_name), ''), lambda x: x <> '' AND contains('abcdefghijklmnopqrstuvwxyz0123456789', x)) AS l FROM part),
 u AS (SELECT p_partkey, unnest(l) AS ch, generate_subscripts(l, 1) - 1 AS i FROM c),
 x AS (SELECT p_partkey, i, CASE """ + " ".join(f"WHEN i = {at} AND p_partkey % {m} = {r} THEN {x}" for at, m, r, x in _SPECIAL) + """
  ELSE instr('abcdefghijklmnopqrstuvwxyz0123456789', ch) END AS id, (ascii(ch) % 50 + i + 1) / 100.0 AS p FROM u),
 a AS (SELECT *, lag(id) OVER (PARTITION BY p_partkey ORDER BY i) AS prev FROM x)"""
_MEANS = {
    "mean": "coalesce(avg(p) FILTER ({scored}), 0)",
    "product": "coalesce(product(p) FILTER ({scored}), 1)",
    "geometric": "coalesce(exp(sum(ln(p)) FILTER ({scored}) / (count(*) FILTER ({scored}) + 1e-6)), 1)",
}


def _decoder_sql(before="", after="", stop=None, skip=(), hide=(), first=None, collapse=False, stop_counts=False, mean="mean", back=False) -> str:
    """`first`: a condition on the steps that are read."""
    names = [x for x in before.split(",") if x] + CHARSET + [x for x in after.split(",") if x]
    at = {n: i for i, n in enumerate(names)}
    no = lambda some: "".join(f" AND id <> {at[n]}" for n in some)
    kept = "stop IS NULL OR i < stop" if stop else "i IS NOT NULL"
    scored = "stop IS NULL OR i <= stop" if stop_counts else kept
    read = f"id < {len(names)}" + (" AND (prev IS NULL OR id <> prev)" if collapse else "") + (f" AND ({first})" if first else "")
    return f"""WITH {_MARKED}, r AS (SELECT * FROM a WHERE {read}), s AS (SELECT *, {f"min(i) FILTER (id = {at[stop]}) OVER (PARTITION BY p_partkey)" if stop else "NULL"} AS stop FROM r)
SELECT part.p_partkey, coalesce(string_agg([{", ".join(f"'{n}'" for n in names)}][id + 1], '' ORDER BY i{" DESC" if back else ""}) FILTER (({kept}){no((*skip, *hide))}), '') AS text,
  round({_MEANS[mean].format(scored=f"({scored}) AND i IS NOT NULL{no(skip)}")}, 9) AS conf FROM part LEFT JOIN s USING (p_partkey) GROUP BY part.p_partkey"""


_START = "NOT (i = 0 AND id = 2)"
_DECODERS = {
    "ctc": _decoder_sql("blank", skip=("blank",), collapse=True),
    "ctc_label": _decoder_sql("blank", skip=("blank",)),
    "ar": _decoder_sql("</s>", "<s>,<pad>", "</s>", ("<s>", "<pad>")),
    "ce": _decoder_sql(first="i = 0"),
    "char": _decoder_sql("blank,<unk>,<s>,</s>", "", "</s>", first=_START),
    "cppd": _decoder_sql("</s>", "", "</s>"),
    "nrtr": _decoder_sql("blank,<unk>,<s>,</s>", "", "</s>", first=_START),
    "abinet": _decoder_sql("</s>", "", "</s>"),
    "visionlan": f"""WITH {_MARKED} SELECT part.p_partkey, coalesce(string_agg(substr('abcdefghijklmnopqrstuvwxyz0123456789', CAST(id AS INTEGER), 1), '' ORDER BY i) FILTER (id > 0 AND id <= 36), '') AS text,
  round(coalesce(exp(sum(ln(p)) / (count(i) + 1e-6)), 1), 9) AS conf FROM part LEFT JOIN a USING (p_partkey) GROUP BY part.p_partkey""",
    "lister": _decoder_sql("</s>", "<pad>", "</s>", ("<pad>",)),
    "smtr": _decoder_sql("</s>", "<s>,<INF>,<INB>,<pad>", "</s>", ("<s>", "<pad>")),
    "smtr_back": _decoder_sql("</s>", "<s>,<INF>,<INB>,<pad>", "</s>", ("<s>", "<pad>"), back=True),
    "srn": _decoder_sql("", "<BOS>,<EOS>", skip=("<BOS>", "<EOS>")),
    "igtr": _decoder_sql("</s>", "<s>,<pad>", "</s>", ("<s>", "<pad>")),
    "mgp": _decoder_sql("[GO],[s]", "", "[s]", hide=("[GO]",), first="i > 0", stop_counts=True, mean="product"),
    "pg": _decoder_sql("", "blank", skip=("blank",), collapse=True),
    "dptr": _decoder_sql("[E]", "[B],[P]", "[E]", stop_counts=True),
}


def _decoder(kind: str, sql: str):
    def run(spark, sf):
        d = S.decoded(F.col("path"), CHARSET, S.LAYOUTS[kind])
        return marked(spark, sf).select("p_partkey", d.alias("d")).select("p_partkey", "d.text", F.round("d.conf", 9).alias("conf"))

    run.__name__ = f"decode_{kind}"
    QUERIES[run.__name__], ORACLE[run.__name__] = run, sql


for _kind, _sql in _DECODERS.items():
    _decoder(_kind, _sql)


@query(f"WITH d AS ({_DECODERS['pg']}) SELECT p_partkey, text FROM d WHERE length(text) >= 2 AND p_partkey % 2 = 0 UNION ALL SELECT p_partkey, text[1:2] FROM d WHERE length(text[1:2]) >= 2 AND p_partkey % 2 = 1")
def min_decoded_length(spark, sf):
    d = S.decoded(F.col("path"), CHARSET, S.LAYOUTS["pg"])["text"]
    rows = marked(spark, sf).select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, d).otherwise(F.left(d, F.lit(2))).alias("text"))
    return filters.long_enough(rows)


_PATHS = [[(0, 0), (0, 3), (3, 3)], [(3, 0), (1, 1), (1, 3)], [(0, 0)], [(2, 2), (2, 2), (0, 1)]]
#: What the paths come to with the points between.
_DENSE = [[(0, 0), (0, 1), (0, 2), (0, 3), (1, 3), (2, 3), (3, 3)], [(3, 0), (2, 0), (1, 1), (1, 2), (1, 3)], None, [(2, 2), (2, 2), (1, 1), (0, 1)]]


@query(
    "WITH d AS (SELECT * FROM (VALUES "
    + ", ".join(f"({k}, {i}, {y}, {x})" for k, path in enumerate(_DENSE) for i, (y, x) in enumerate(path or []))
    + """) AS v (k, i, y, x)),
 l AS (SELECT vec_id, k, i, y, x, embedding[(y * 4 + x) * 4 + 1:(y * 4 + x) * 4 + 4] AS row FROM embeddings, d), m AS (SELECT *, list_position(row, list_max(row)) AS id FROM l),
 r AS (SELECT *, lag(id) OVER (PARTITION BY vec_id, k ORDER BY i) AS prev, count(*) OVER (PARTITION BY vec_id, k) AS n FROM m)
SELECT vec_id, CAST(k AS INTEGER) AS path, string_agg(substr('abc', CAST(id AS INTEGER), 1), '' ORDER BY i) FILTER (id < 4 AND (prev IS NULL OR id <> prev)) AS text,
  string_agg(y || ' ' || x, ',' ORDER BY i) FILTER (i = 0 OR i = n // 2 OR i = n - 1) AS points FROM r GROUP BY vec_id, k HAVING length(text) >= 2"""
)
def pg_strings(spark, sf):
    cell = lambda y: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda x: F.slice("embedding", (y * 4 + x) * 4 + 1, F.lit(4)))
    probs = F.transform(F.sequence(F.lit(0), F.lit(3)), cell)
    path = lambda k: F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in _PATHS[k]])
    rows = read(spark, sf, "embeddings").select("vec_id", probs.alias("probs"))
    each = [rows.select("vec_id", F.lit(k).alias("path"), F.inline(S.read_along(F.col("probs"), F.array(path(k)), list("abc"), 3, dense=True))) for k in range(len(_PATHS))]
    out = reduce(DataFrame.unionByName, each)
    return out.select("vec_id", "path", "text", F.array_join(F.transform("points", lambda p: F.concat_ws(" ", p["y"], p["x"])), ",").alias("points"))


@query(
    f"""WITH {_MARKED}, h AS (SELECT p_partkey, max(CASE WHEN i = 0 AND id = 2 THEN 1 ELSE 0 END) AS lead FROM x GROUP BY 1),
 b AS (SELECT x.p_partkey, x.i - lead AS i, x.id, x.p FROM x JOIN h USING (p_partkey) WHERE x.i >= lead),
 r AS (SELECT b.p_partkey, b.i, b.id, b.p, (o.id * 7 + o.i) % 37 + 4 AS box, o.p / 2 AS q FROM b JOIN x AS o ON o.p_partkey = b.p_partkey AND o.i = b.i WHERE b.id < 40 AND (o.id * 7 + o.i) % 37 + 4 < 40),
 s AS (SELECT *, min(i) FILTER (id = 3) OVER (PARTITION BY p_partkey) AS stop FROM r),
 n AS (SELECT ['blank', '<unk>', '<s>', '</s>'] || string_split('a,b,c,d,e,f,g,h,i,j,k,l,m,n,o,p,q,r,s,t,u,v,w,x,y,z,0,1,2,3,4,5,6,7,8,9', ',') AS names)
SELECT part.p_partkey, coalesce(string_agg((SELECT names FROM n)[id + 1], '' ORDER BY i), '') AS text, round(coalesce(avg(p), 0), 9) AS conf,
  coalesce(string_agg((SELECT names FROM n)[box + 1], '' ORDER BY i), '') AS box_text, round(coalesce(avg(q), 0), 9) AS box_conf
FROM part LEFT JOIN (SELECT * FROM s WHERE stop IS NULL OR i < stop) AS k USING (p_partkey) GROUP BY part.p_partkey"""
)
def decode_char_boxes(spark, sf):
    other = F.transform("path", lambda s, i: F.struct(((s["id"] * 7 + i) % 37).alias("id"), (s["p"] / 2).alias("p")))
    d = S.decoded_with_boxes(F.col("path"), other, CHARSET)
    rows = marked(spark, sf).select("p_partkey", d.alias("d")).select("p_partkey", "d.*")
    return rows.select("p_partkey", "text", F.round("conf", 9).alias("conf"), "box_text", F.round("box_conf", 9).alias("box_conf"))


@query(f"WITH g AS ({_DECODERS['ar']}), k AS ({_DECODERS['ctc']}) SELECT g.p_partkey, g.text AS gtc_text, g.conf AS gtc_conf, k.text AS ctc_text, k.conf AS ctc_conf FROM g JOIN k USING (p_partkey)")
def decode_gtc(spark, sf):
    rows = marked(spark, sf).select("p_partkey", S.decoded_guided(F.col("path"), F.col("path"), CHARSET).alias("d"))
    return rows.select("p_partkey", *[(F.round(F.col(f"d.{h}.{c}"), 9) if c == "conf" else F.col(f"d.{h}.{c}")).alias(f"{h}_{c}") for h in ("gtc", "ctc") for c in ("text", "conf")])


@query(f"WITH {V_PROBS}, z AS (SELECT vec_id, t, unnest(row) AS p, generate_subscripts(row, 1) - 1 AS id FROM q), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, t ORDER BY p DESC, id DESC) AS n FROM z) SELECT vec_id, t, string_agg(id, ',' ORDER BY n DESC) AS classes FROM r WHERE n <= 5 GROUP BY ALL")
def topk_classes(spark, sf):
    rows = paths(spark, sf).select("vec_id", F.posexplode("probs").alias("t", "row"))
    return rows.select("vec_id", F.col("t").cast("long").alias("t"), F.array_join(F.transform(S.top_classes(F.col("row")), lambda i: i.cast("string")), ",").alias("classes"))


@query(
    f"WITH {V_PROBS}, h AS (SELECT vec_id, avg(p) FILTER (t < 4) AS a, avg(p) FILTER (t >= 4) AS b, avg(p) AS c FROM k GROUP BY 1) SELECT vec_id, CASE WHEN a >= b AND a >= c THEN 'char' WHEN b >= c THEN 'bpe' ELSE 'wp' END AS head, round(greatest(a, b, c), 6) AS conf FROM h"
)
def best_head(spark, sf):
    part = lambda a, n: F.struct(F.lit("").alias("text"), S.confidence(F.transform(F.slice("path", a, n), lambda s: s["p"]), "mean").alias("conf"))
    rows = paths(spark, sf).select("vec_id", S.best_head({"char": part(1, 4), "bpe": part(5, 4), "wp": part(1, 8)}).alias("b"))
    return rows.select("vec_id", "b.head", F.round("b.conf", 6).alias("conf"))


@query(
    f"WITH {V_PROBS}, c AS (SELECT *, CASE WHEN lag(id) OVER (PARTITION BY vec_id ORDER BY t) = id THEN 0 ELSE 1 END AS new FROM k), r AS (SELECT *, sum(new) OVER (PARTITION BY vec_id ORDER BY t) AS run FROM c) SELECT vec_id, CAST(id AS INTEGER) AS id, CAST(min(t) + count(*) // 2 AS INTEGER) AS mid FROM r GROUP BY vec_id, run, id"
)
def run_length_groups(spark, sf):
    return paths(spark, sf).select("vec_id", F.inline(S.runs(F.col("path"))))


def _encoder_sql(prefix: str, suffix: str, pad: int, size: int, offset: int) -> str:
    return f"""WITH c AS (SELECT p_partkey, list_filter(string_split(lower(p_name), ''), lambda x: x <> '' AND contains('abcdefghijklmnopqrstuvwxyz0123456789', x)) AS l FROM part),
 i AS (SELECT p_partkey, list_transform(l, lambda x: CAST(instr('abcdefghijklmnopqrstuvwxyz0123456789', x) - 1 + {offset} AS INTEGER)) AS ids FROM c),
 f AS (SELECT p_partkey, ids, CAST({prefix} AS INTEGER[]) || ids || CAST({suffix} AS INTEGER[]) AS e FROM i)
SELECT p_partkey, CASE WHEN len(ids) BETWEEN 1 AND 25 THEN array_to_string(e || list_transform(range(0, greatest(0, {size} - len(e))), lambda x: {pad}), ',') END AS label FROM f"""


def _encoder(kind: str, sql: str | None):
    def run(spark, sf):
        label = S.encoded(F.col("p_name"), CHARSET, kind, 25, lower=True)
        return read(spark, sf, "part").select("p_partkey", F.array_join(F.transform(label, lambda i: i.cast("string")), ",").alias("label"))

    run.__name__ = f"encode_{kind}"
    QUERIES[run.__name__] = run
    ORACLE[run.__name__] = sql


_encoder("ctc", _encoder_sql("[]", "[]", 0, 25, 1))
_encoder("ar", _encoder_sql("[37]", "[0]", 38, 27, 1))
_encoder("ep", _encoder_sql("[]", "[0]", 38, 26, 1))
_encoder("char", _encoder_sql("[2]", "[3]", 0, 27, 4))
_encoder("nrtr", _encoder_sql("[2]", "[3]", 0, 27, 4))
_encoder("abinet", _encoder_sql("[]", "[0]", 100, 26, 1))
_encoder("srn", _encoder_sql("[]", "[]", 37, 25, 0))
_encoder("char_head", _encoder_sql("[]", "[]", 104, 26, 4))
_encoder("visionlan", _encoder_sql("[]", "[]", 0, 26, 1))
_encoder("mgp", _encoder_sql("[0]", "[1]", 0, 27, 2))
_encoder("cppd", _encoder_sql("[]", "[0]", 100, 26, 1))
_encoder("dptr", _encoder_sql("[37]", "[0]", 38, 27, 1))
_encoder("ce", _encoder_sql("[]", "[]", 0, 0, 0).replace("WHEN len(ids) BETWEEN 1 AND 25", "WHEN len(ids) > 0 AND (SELECT length(p_name) FROM part AS o WHERE o.p_partkey = f.p_partkey) <= 25"))


_said = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",")
_rows_said = lambda c, f: F.array_join(F.transform(c, lambda w: F.array_join(F.transform(w, f), " ")), ",")
_KNOWN = """c AS (SELECT p_partkey, p_name, list_filter(string_split(lower(p_name), ''), lambda x: x <> '' AND contains('abcdefghijklmnopqrstuvwxyz0123456789', x)) AS l FROM part),
 k AS (SELECT p_partkey, p_name, list_transform(l, lambda x: CAST(instr('abcdefghijklmnopqrstuvwxyz0123456789', x) AS INTEGER)) AS ids FROM c)"""
_fill = lambda e, size, x: f"({e}) || list_transform(range(0, greatest(0, {size} - len({e}))), lambda z: {x})"


@query(
    f"""WITH {_KNOWN}, w AS (SELECT p_partkey, ids, len(ids) AS n, [38, 38, 38, 38, 38] || ids || [39, 39, 39, 39, 39] AS f FROM k),
 v AS (SELECT *, list_transform(range(0, n + 1), lambda i: array_to_string(f[i + 1:i + 5], ' ')) AS subs, ids || [0] AS nxt,
   list_transform(range(0, n + 1), lambda i: array_to_string(f[n + 6 - i:n + 10 - i], ' ')) AS back, list_reverse(ids) || [0] AS prv FROM w)
SELECT p_partkey, CASE WHEN ok THEN array_to_string({_fill("[37] || ids || [0]", 27, 40)}, ',') END AS label, CASE WHEN ok THEN array_to_string({_fill("subs", 52, "'40 40 40 40 40'")}, ',') END AS subs,
  CASE WHEN ok THEN array_to_string({_fill("nxt", 52, 40)}, ',') END AS next, CASE WHEN ok THEN n + 1 END AS n_subs, CASE WHEN ok THEN array_to_string({_fill("back", 52, "'40 40 40 40 40'")}, ',') END AS subs_back,
  CASE WHEN ok THEN array_to_string({_fill("prv", 52, 40)}, ',') END AS next_back, CASE WHEN ok THEN n + 1 END AS n_subs_back FROM (SELECT *, n BETWEEN 1 AND 25 AS ok FROM v)"""
)
def encode_smtr(spark, sf):
    rows = read(spark, sf, "part").select("p_partkey", S.window_label(F.col("p_name"), CHARSET, lower=True).alias("x")).select("p_partkey", "x.*")
    own = lambda c: _rows_said(F.col(c), lambda i: i.cast("string"))
    null = F.col("label").isNotNull()
    return rows.select("p_partkey", _said("label").alias("label"), *[F.when(null, own(c)).alias(c) for c in ("subs", "subs_back")], *[_said(c).alias(c) for c in ("next", "next_back")], "n_subs", "n_subs_back")


_TRIPLES = "list_transform(range(1, len(ids) + 1), lambda i: i || ' ' || ids[i] || ' ' || len(list_filter(ids[1:i - 1], lambda y: y = ids[i])))"


@query(
    f"""WITH {_KNOWN}, q AS (SELECT *, {_TRIPLES} AS told, [(len(ids) + 1) || ' 0 0'] AS stop, len(ids) BETWEEN 1 AND 25 AS ok FROM k)
SELECT p_partkey, CASE WHEN ok THEN array_to_string({_fill("[37] || ids || [0]", 27, 38)}, ',') END AS label,
  CASE WHEN ok THEN array_to_string(list_transform(range(0, 37), lambda x: len(list_filter([0] || ids, lambda y: y = x))), ',') END AS counts,
  CASE WHEN ok THEN array_to_string({_fill("['0 37 0'] || told", 26, "'27 38 0'")}, ',') END AS prompt, CASE WHEN ok THEN array_to_string({_fill("['0 37 0']", 26, "'27 38 0'")}, ',') END AS no_prompt,
  CASE WHEN ok THEN array_to_string({_fill("told || stop", 26, "'27 38 0'")}, ',') END AS questions, CASE WHEN ok THEN array_to_string({_fill("stop", 26, "'27 38 0'")}, ',') END AS question FROM q"""
)
def encode_igtr(spark, sf):
    rows = read(spark, sf, "part").select("p_partkey", S.prompt_label(F.col("p_name"), CHARSET, lower=True).alias("x")).select("p_partkey", "x.*")
    said = lambda c, i: F.array_join(F.transform(F.get(c, F.lit(i)), lambda t: F.concat_ws(" ", t["pos"], t["id"], t["nth"])), ",")
    return rows.select("p_partkey", _said("label").alias("label"), _said("counts").alias("counts"), said("prompts", 1).alias("prompt"), said("prompts", 0).alias("no_prompt"), said("questions", 0).alias("questions"), said("questions", 1).alias("question"))


@query(
    f"""WITH {_KNOWN}, n AS (SELECT *, len(ids) BETWEEN 1 AND 25 AS ok, list_transform(range(0, 37), lambda x: len(list_filter([0] || ids, lambda y: y = x))) AS counts FROM k)
SELECT p_partkey, CASE WHEN ok THEN array_to_string(counts || list_transform(range(0, 26), lambda i: CASE WHEN i <= len(ids) THEN 1 ELSE 0 END), ',') END AS nodes,
  CASE WHEN ok THEN array_to_string(counts || list_transform(range(0, 26), lambda i: CASE WHEN i <= len(ids) THEN len(ids) - i ELSE 100 END), ',') END AS left_nodes FROM n"""
)
def encode_cppd_nodes(spark, sf):
    rows = read(spark, sf, "part").select("p_partkey", *[S.node_label(F.col("p_name"), CHARSET, lower=True, count_down=d)["nodes"].alias(n) for n, d in (("nodes", False), ("left_nodes", True))])
    return rows.select("p_partkey", _said("nodes").alias("nodes"), _said("left_nodes").alias("left_nodes"))


_IDS_OF = lambda t: f"list_transform(list_filter(string_split(lower({t}), ''), lambda x: x <> '' AND contains('abcdefghijklmnopqrstuvwxyz0123456789', x)), lambda x: CAST(instr('abcdefghijklmnopqrstuvwxyz0123456789', x) AS INTEGER))"


@query(
    f"""WITH c AS (SELECT p_partkey, p_name, p_partkey % length(p_name) AS nth FROM part), k AS (SELECT p_partkey, {_IDS_OF("p_name")} AS ids, {_IDS_OF("left(p_name, nth) || substr(p_name, nth + 2)")} AS res, {_IDS_OF("substr(p_name, nth + 1, 1)")} AS sub FROM c)
SELECT p_partkey, CASE WHEN ok THEN array_to_string({_fill("res", 25, 0)}, ',') END AS label_res, CASE WHEN ok THEN len(res) END AS length_res,
  CASE WHEN ok THEN array_to_string({_fill("sub", 25, 0)}, ',') END AS label_sub, CASE WHEN ok THEN len(sub) END AS length_sub FROM (SELECT *, len(ids) BETWEEN 1 AND 25 AS ok FROM k)"""
)
def encode_occluded(spark, sf):
    x = S.occluded_label(F.col("p_name"), (F.col("p_partkey") % F.length("p_name")).cast("int"), CHARSET, lower=True)
    rows = read(spark, sf, "part").select("p_partkey", x.alias("x")).select("p_partkey", "x.*")
    return rows.select("p_partkey", _said("label_res").alias("label_res"), "length_res", _said("label_sub").alias("label_sub"), "length_sub")


@query(
    f"""WITH {_KNOWN} SELECT p_partkey, CASE WHEN ok THEN array_to_string({_fill("[37] || ids || [0]", 27, 38)}, ',') END AS label, CASE WHEN ok THEN array_to_string({_fill("ids", 25, 0)}, ',') END AS ctc_label, CASE WHEN ok THEN len(ids) END AS ctc_length
FROM (SELECT *, len(ids) BETWEEN 1 AND 25 AS ok FROM k)"""
)
def encode_gtc(spark, sf):
    rows = read(spark, sf, "part").select("p_partkey", S.guided_label(F.col("p_name"), CHARSET, lower=True).alias("x")).select("p_partkey", "x.*")
    return rows.select("p_partkey", _said("label").alias("label"), _said("ctc_label").alias("ctc_label"), "ctc_length")


def _name_ids():
    return S.known_ids(F.col("p_name"), CHARSET, 1, lower=True)


_ID_ROWS = "c AS (SELECT p_partkey, list_filter(string_split(lower(p_name), ''), lambda x: x <> '' AND contains('abcdefghijklmnopqrstuvwxyz0123456789', x)) AS l FROM part), r AS (SELECT p_partkey, CAST(instr('abcdefghijklmnopqrstuvwxyz0123456789', unnest(l)) AS INTEGER) AS id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos FROM c)"


@query(f"WITH {_ID_ROWS} SELECT p_partkey, id, count(*) AS n FROM r GROUP BY ALL")
def char_counts(spark, sf):
    rows = read(spark, sf, "part").select("p_partkey", F.posexplode(S.class_counts(_name_ids(), 37)).alias("id", "n"))
    return rows.where("n > 0").select("p_partkey", "id", F.col("n").cast("long").alias("n"))


@query(f"WITH {_ID_ROWS} SELECT p_partkey, pos, id, CAST(row_number() OVER (PARTITION BY p_partkey, id ORDER BY pos) AS INTEGER) AS nth FROM r")
def char_occurrences(spark, sf):
    return read(spark, sf, "part").select("p_partkey", F.inline(S.occurrences(_name_ids())))


@query(f"WITH {_ID_ROWS}, d AS (SELECT p_partkey, count(DISTINCT id) AS k FROM r GROUP BY 1) SELECT p_partkey, CAST(37 - k AS INTEGER) AS absent FROM d")
def absent_classes(spark, sf):
    return read(spark, sf, "part").where(F.size(_name_ids()) > 0).select("p_partkey", F.size(S.absent_symbols(_name_ids(), 37)).alias("absent"))


@query(
    """WITH c AS (SELECT p_partkey, list_transform(list_filter(string_split(lower(p_name), ''), lambda x: x <> '' AND contains('abcdefghijklmnopqrstuvwxyz0123456789', x)), lambda x: CAST(instr('abcdefghijklmnopqrstuvwxyz0123456789', x) AS INTEGER)) AS l FROM part),
 p AS (SELECT p_partkey, l, [38, 38, 38] || l || [39, 39, 39] AS w, l || [0] AS n, [0] || l AS v FROM c), r AS (SELECT *, unnest(range(0, len(l) + 1)) AS i FROM p)
SELECT p_partkey, i AS pos, array_to_string(w[i + 1:i + 3], ',') AS context, n[i + 1] AS next, array_to_string(w[i + 4:i + 6], ',') AS back, v[i + 1] AS prev FROM r"""
)
def ngram_context(spark, sf):
    rows = read(spark, sf, "part").select("p_partkey", F.posexplode(S.contexts(_name_ids(), 3, 38, 39, 0)).alias("pos", "x"))
    said = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",")
    return rows.select("p_partkey", F.col("pos").cast("long").alias("pos"), said(F.col("x.context")).alias("context"), "x.next", said(F.col("x.back")).alias("back"), "x.prev")


@query("SELECT CAST(i AS INTEGER) AS id, substr('0123456789abcdefghijklmnopqrstuvwxyz ', CAST(i + 1 AS INTEGER), 1) AS symbol FROM range(37) AS r(i)")
def charset_table(spark, sf):
    return files.charset_table(spark, files.charset(spark, None, space=True))


@query(
    """WITH r AS (SELECT r_regionkey AS n, upper(r_name) AS v FROM region WHERE upper(r_name) <> 'ASIA'), l AS (SELECT n * 2 AS o, 'B-' || v AS label FROM r UNION ALL SELECT n * 2 + 1, 'I-' || v FROM r UNION ALL SELECT -1, 'O')
SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INTEGER) AS id, label FROM l"""
)
def entity_labels(spark, sf):
    lines = read(spark, sf, "region").select(F.col("r_regionkey").alias("n"), F.when(F.upper("r_name") == "ASIA", "Others").otherwise(F.col("r_name")).alias("value"))
    return files.entity_labels(lines)


@query("""SELECT replace('im ' || p_partkey || '.png', ' ', '') AS img_path, replace(replace(p_name, ' ', ''), '"', '') AS label FROM part""")
def rec_label_import(spark, sf):
    lines = read(spark, sf, "part").select(F.concat(F.lit("im "), F.col("p_partkey").cast("string"), F.lit('.png, "'), "p_name", F.lit('"')).alias("value"))
    return files.recognition_labels(lines)


@query(
    f"""WITH {V_BOXES}, k AS (SELECT image_id, event_id, '{{"transcription":"t' || event_id || '","points":[[' || CAST(x AS INTEGER) || ',' || CAST(y AS INTEGER) || '],[' || CAST(x + w AS INTEGER) || ',' || CAST(y AS INTEGER) || '],[' || CAST(x + w AS INTEGER) || ',' || CAST(y + h AS INTEGER) || '],[' || CAST(x AS INTEGER) || ',' || CAST(y + h AS INTEGER) || ']]}}' AS item FROM b)
SELECT 'root/img_' || image_id || '.jpg' AS img_path, '[' || string_agg(item, ',' ORDER BY event_id) || ']' AS label FROM k GROUP BY image_id"""
)
def det_label_import(spark, sf):
    b = F.col("box")
    at = [v.cast("int").cast("string") for v in (b["x"], b["y"], b["x"] + b["w"], b["y"], b["x"] + b["w"], b["y"] + b["h"], b["x"], b["y"] + b["h"])]
    line = F.concat_ws(",", *at, F.concat(F.lit("t"), F.col("event_id").cast("string")), F.lit("rest"))
    docs = boxes(spark, sf).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("l"))
    docs = docs.select(F.concat(F.lit("labels/gt_img_"), F.col("image_id").cast("string"), F.lit(".txt")).alias("path"), F.concat(F.lit("﻿"), F.array_join(F.transform("l", lambda x: x["line"]), "\r\n"), F.lit("\r\n")).alias("value"))
    return files.detection_labels(docs, "root")


@query("SELECT CAST(i AS INTEGER) AS image_idx, 'img' || i || '.png' AS path FROM range(5) AS r(i)")
def comma_list(spark, sf):
    return files.listed(spark, "img0.png, img1.png ,img2.png,img3.png, img4.png")


# Points along a line


def _rounded(v, digits: int):
    """Rounded as in the SQL, where a negative number that comes to zero is -0.0; F.round has no such zero."""
    return F.round(F.abs(v), digits) * F.signum(v)


@query(
    """WITH p AS (SELECT vec_id, i, CAST(embedding[4 * i + 1] AS DOUBLE) AS x, CAST(embedding[4 * i + 2] AS DOUBLE) AS y, CAST(embedding[4 * i + 3] AS DOUBLE) AS dx, CAST(embedding[4 * i + 4] AS DOUBLE) AS dy FROM embeddings, range(9) AS r(i)),
 m AS (SELECT vec_id, avg(dx) AS dx, avg(dy) AS dy FROM p GROUP BY vec_id)
SELECT vec_id, list(round(x, 6) ORDER BY p.x * m.dx + p.y * m.dy, i) AS xs FROM p JOIN m USING (vec_id) GROUP BY vec_id"""
)
def direction_sort(spark, sf):
    e = lambda i, k: F.get("embedding", i * 4 + k).cast("double")
    points = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.struct(e(i, 0).alias("x"), e(i, 1).alias("y"), e(i, 2).alias("dx"), e(i, 3).alias("dy")))
    return read(spark, sf, "embeddings").select("vec_id", F.transform(G.along_direction(points), lambda p: _rounded(p["x"], 6)).alias("xs"))


@query("SELECT p_partkey, regexp_replace(p_name, '\\s', '', 'g') AS folded FROM part")
def ascii_fold(spark, sf):
    return read(spark, sf, "part").select("p_partkey", T.ascii_folded(F.col("p_name")).alias("folded"))


# Pixels

V_PIXELS = """px AS (SELECT vec_id, i // 15 AS y, i % 15 // 3 AS x, i % 3 AS c, CAST(least(255, greatest(0, floor(128 + 127 * CAST(embedding[i + 1] AS DOUBLE)))) AS BIGINT) AS v FROM embeddings, range(60) AS r(i)),
 gr AS (SELECT vec_id, y, x, CAST((sum(v * CASE c WHEN 0 THEN 3735 WHEN 1 THEN 19235 ELSE 9798 END) + 16384) // 32768 AS BIGINT) AS g FROM px GROUP BY ALL)"""
_MIRROR = lambda i, n: f"(CASE WHEN ({i} + 96) % {2 * n - 2} < {n} THEN ({i} + 96) % {2 * n - 2} ELSE {2 * n - 2} - ({i} + 96) % {2 * n - 2} END)"  # noqa: E731  (96 is a multiple of both periods)


def small_pictures(spark, sf) -> DataFrame:
    v = F.transform(F.slice("embedding", 1, 60), lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 127 * x.cast("double")))).cast("int"))
    data = F.unhex(F.array_join(F.transform(v, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    picture = F.struct(F.col("vec_id").cast("string").alias("origin"), F.lit(4).alias("height"), F.lit(5).alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), data.alias("data"))
    return read(spark, sf, "embeddings").select("vec_id", "embedding", picture.alias("image"))


@query(
    f"""WITH {V_PIXELS}, wy AS (SELECT y, {_MIRROR("y + d", 4)} AS y2, sum(k) AS k FROM range(4) AS r(y), (SELECT d, exp(-d * d / (2 * 2.6 * 2.6)) AS k FROM range(-7, 8) AS q(d)) GROUP BY ALL),
 wx AS (SELECT x, {_MIRROR("x + d", 5)} AS x2, sum(k) AS k FROM range(5) AS r(x), (SELECT d, exp(-d * d / (2 * 2.6 * 2.6)) AS k FROM range(-7, 8) AS q(d)) GROUP BY ALL),
 one AS (SELECT sum(exp(-d * d / (2 * 2.6 * 2.6))) AS n FROM range(-7, 8) AS q(d)),
 bl AS (SELECT vec_id, wy.y, wx.x, c, round_even(sum(v * wy.k * wx.k) / max(n * n), 0) AS v FROM wy, wx, one, px WHERE px.y = y2 AND px.x = x2 GROUP BY vec_id, wy.y, wx.x, c)
SELECT vec_id, string_agg(printf('%02X', CAST(round_even(0.3 * v, 0) AS BIGINT)), '' ORDER BY y, x, c) AS pixels FROM bl GROUP BY vec_id"""
)
def picture_soften(spark, sf):
    return small_pictures(spark, sf).select("vec_id", pictures.softened(F.col("image")).alias("p")).select("vec_id", F.hex("p.data").alias("pixels"))


@query(
    f"""WITH {V_PIXELS}, s AS (SELECT a.vec_id, a.y, a.x, 10 * a.g - sum(b.g) AS s FROM gr AS a, range(-1, 2) AS r(dy), range(-1, 2) AS q(dx), gr AS b
  WHERE b.vec_id = a.vec_id AND b.y = {_MIRROR("(a.y + dy)", 4)} AND b.x = {_MIRROR("(a.x + dx)", 5)} GROUP BY a.vec_id, a.y, a.x, a.g),
 e AS (SELECT vec_id, y, x, CAST(least(255, round_even(CAST(least(255, greatest(0, s)) AS DOUBLE) * 1.5 + 10, 0)) AS BIGINT) AS e FROM s)
SELECT vec_id, string_agg(printf('%02X%02X%02X', e, e, e), '' ORDER BY y, x) AS pixels FROM e GROUP BY vec_id"""
)
def picture_enhance(spark, sf):
    return small_pictures(spark, sf).select("vec_id", pictures.enhanced(F.col("image")).alias("p")).select("vec_id", F.hex("p.data").alias("pixels"))


@query(
    f"""WITH {V_PIXELS}, t AS (SELECT a.vec_id, a.g AS t, count(*) AS n, CAST(count(*) FILTER (b.g <= a.g) AS DOUBLE) AS below, CAST(count(*) FILTER (b.g > a.g) AS DOUBLE) AS above,
   CAST(sum(b.g) FILTER (b.g <= a.g) AS DOUBLE) AS low, CAST(sum(b.g) AS DOUBLE) AS whole FROM (SELECT DISTINCT vec_id, g FROM gr) AS a JOIN gr AS b USING (vec_id) GROUP BY a.vec_id, a.g),
 v AS (SELECT vec_id, t, CASE WHEN above = 0 THEN 0 ELSE below * above * ((low / below - (whole - low) / above) * (low / below - (whole - low) / above)) END AS v FROM t),
 o AS (SELECT vec_id, t FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, t) = 1)
SELECT vec_id, string_agg(CASE WHEN g > t THEN 'FFFFFF' ELSE '000000' END, '' ORDER BY y, x) AS pixels FROM gr JOIN o USING (vec_id) GROUP BY vec_id"""
)
def picture_binarise(spark, sf):
    return small_pictures(spark, sf).select("vec_id", pictures.binarised(F.col("image")).alias("p")).select("vec_id", F.hex("p.data").alias("pixels"))


@query(f"WITH {V_PIXELS} SELECT vec_id, list(round((v / 255.0 - [0.485, 0.456, 0.406][c + 1]) / [0.229, 0.224, 0.225][c + 1], 3) ORDER BY c, y, x) AS input FROM px GROUP BY vec_id")
def picture_normalise(spark, sf):
    return small_pictures(spark, sf).select("vec_id", pictures.normalised(F.col("image")).alias("v")).select("vec_id", F.transform("v", lambda x: F.round(x.cast("double"), 3)).alias("input"))


@query(
    f"""WITH {V_PIXELS} , w AS (SELECT vec_id, y, x, c FROM (SELECT DISTINCT vec_id FROM px), range(6) AS r(y), range(4) AS q(x), range(3) AS s(c))
SELECT vec_id, string_agg(printf('%02X', coalesce(v, 0)), '' ORDER BY w.y, w.x, w.c) AS pixels FROM w LEFT JOIN (SELECT vec_id, y - 1 AS y, x - 2 AS x, c, v FROM px) AS p USING (vec_id, y, x, c) GROUP BY vec_id"""
)
def picture_crop_pad(spark, sf):
    """Columns 2 to 5 of rows from 1 on, padded to 6 rows of 4."""
    cut = pictures.cropped(F.col("image"), F.lit(2), F.lit(1), F.lit(5), F.lit(4))
    return small_pictures(spark, sf).select("vec_id", pictures.padded(cut, F.lit(6), F.lit(4)).alias("p")).select("vec_id", F.hex("p.data").alias("pixels"))


_ALONG = lambda k, n, m: f"(SELECT {k}, low AS {k}a, least(low + 1, {n} - 1) AS {k}b, spot - low AS {k}s FROM (SELECT {k}, spot, least(CAST(floor(spot) AS BIGINT), {n} - 2) AS low FROM (SELECT {k}, greatest(0, least((CAST({k} AS DOUBLE) + CAST(0.5 AS DOUBLE)) * {n} / {m} - CAST(0.5 AS DOUBLE), {n} - 1)) AS spot FROM range({m}) AS r({k}))))"


@query(
    f"""WITH {V_PIXELS}, w AS (SELECT * FROM {_ALONG("y", 4, 9)}, {_ALONG("x", 5, 7)}),
 f AS (SELECT w.y, w.x, p.vec_id, p.c, w.xs, CAST(p.v AS DOUBLE) + (q.v - p.v) * ys AS l, CAST(s.v AS DOUBLE) + (t.v - s.v) * ys AS r FROM w JOIN px AS p ON p.y = ya AND p.x = xa JOIN px AS q ON q.vec_id = p.vec_id AND q.c = p.c AND q.y = yb AND q.x = xa
   JOIN px AS s ON s.vec_id = p.vec_id AND s.c = p.c AND s.y = ya AND s.x = xb JOIN px AS t ON t.vec_id = p.vec_id AND t.c = p.c AND t.y = yb AND t.x = xb)
SELECT vec_id, string_agg(printf('%02X', CAST(round_even(l + (r - l) * xs, 0) AS BIGINT)), '' ORDER BY y, x, c) AS pixels FROM f GROUP BY vec_id"""
)
def picture_resize(spark, sf):
    return small_pictures(spark, sf).select("vec_id", pictures.resized(F.col("image"), F.lit(9), F.lit(7)).alias("p")).select("vec_id", F.hex("p.data").alias("pixels"))


@query()
def picture_rectify(spark, sf):
    at = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    quad = F.array(at(0, 1), at(4, 0), at(4, 3), at(0, 4))
    return small_pictures(spark, sf).select("vec_id", pictures.rectified(F.col("image"), quad).alias("p")).select("vec_id", "p.height", "p.width", F.hex("p.data").alias("pixels"))


@query(
    f"""WITH {V_VIDEOS}, h AS (SELECT video_id, width // 2 AS w FROM v), s AS (SELECT video_id, greatest(6, width * 12 // height // 2 * 2) AS n FROM v)
SELECT video_id, 'half' AS kind, i AS chunk_idx, CAST([0, w, w // 2][i + 1] AS INTEGER) AS "begin", CAST([w, 2 * w, w // 2 + w][i + 1] AS INTEGER) AS "end" FROM h, (SELECT CAST(i AS INTEGER) AS i FROM range(3) AS r(i))
UNION ALL SELECT video_id, 'square', CAST(i AS INTEGER), CAST(i * 64 AS INTEGER), CAST(i * 64 + 128 AS INTEGER) FROM (SELECT video_id, unnest(range(0, n // 2 - 1)) AS i FROM s)"""
)
def line_windows(spark, sf):
    v = videos(spark, sf)
    part = lambda kind, spans: v.select("video_id", F.lit(kind).alias("kind"), F.posexplode(spans).alias("chunk_idx", "s")).select("video_id", "kind", "chunk_idx", "s.*")
    return part("half", G.half_windows(F.col("width"))).unionByName(part("square", G.square_windows(F.col("width") * 12, F.col("height"))))


@query(
    """WITH t AS (SELECT vec_id // 4 AS image_id, CAST(vec_id % 2 * 5 AS BIGINT) AS l, CAST(vec_id // 2 % 2 * 5 AS BIGINT) AS t, embedding FROM embeddings),
 p AS (SELECT image_id, t + i // 8 AS y, l + i % 8 AS x, embedding[i + 1] > 0.1 AS hit FROM t, range(64) AS r(i)),
 z AS (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM p GROUP BY image_id)
SELECT image_id, CAST(h AS INTEGER) AS height, CAST(w AS INTEGER) AS width, CAST(count(*) FILTER (hit) AS DOUBLE) AS hits, CAST(coalesce(sum((y * 31 + x) * CAST(hit AS INTEGER)), 0) AS DOUBLE) AS places FROM p JOIN z USING (image_id) GROUP BY ALL"""
)
def tile_stitch(spark, sf):
    i = F.col("vec_id")
    left, top = i % 2 * 5, F.floor(i / 2) % 2 * 5
    tiles = read(spark, sf, "embeddings").select(F.floor(i / 4).alias("image_id"), left.alias("left"), top.alias("top"), (left + 8).alias("right"), (top + 8).alias("bottom"), F.lit(8).alias("tile_width"), F.col("embedding").alias("probs"))
    got = pictures.stitched_tiles(tiles, ["image_id"], 0.1)
    place = F.transform("probs", lambda v, k: v.cast("double") * (F.floor(k / F.col("width")) * 31 + k % F.col("width")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return got.select("image_id", "height", "width", total(F.transform("probs", lambda v: v.cast("double"))).alias("hits"), total(place).alias("places"))


@query()
def map_boxes(spark, sf):
    maps = read(spark, sf, "embeddings").select("vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.transform("embedding", lambda x: F.abs(x) * 4).alias("probs"))
    return pictures.map_boxes(maps, F.lit(80), F.lit(160), least_score=0.4, least_side=1)


# Evaluation of detections


@query(f"WITH {V_GT} SELECT image_id, gt_id, det_id, sigma, tau FROM s")
def det_overlaps(spark, sf):
    return matching.overlaps(truths(spark, sf), detections(spark, sf))


@query(
    f"""WITH {V_GT}, c AS (SELECT *, count(*) FILTER (sigma > 0.7) OVER gw AS gs, count(*) FILTER (tau > 0.6) OVER gw AS gt, count(*) FILTER (sigma > 0.7) OVER dw AS ds, count(*) FILTER (tau > 0.6) OVER dw AS dt FROM s
  WINDOW gw AS (PARTITION BY image_id, gt_id), dw AS (PARTITION BY image_id, det_id))
SELECT image_id, gt_id, det_id, sigma, tau FROM c WHERE gs = 1 AND gt = 1 AND ds = 1 AND dt = 1 AND sigma > 0.7 AND tau > 0.6"""
)
def det_match_one_to_one(spark, sf):
    return matching.one_to_one(matching.overlaps(truths(spark, sf), detections(spark, sf)))


@query(f"WITH {V_GT} SELECT image_id, det_id FROM d WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.image_id = d.image_id AND o.det_id = d.det_id AND o.dont_care AND o.inter / (o.da + 1.0) > 0.5)")
def dont_care_anti_join(spark, sf):
    return matching.without_ignored(detections(spark, sf), truths(spark, sf)).select("image_id", "det_id")


#: Single matches as sets; then, image by image, truths split among detections and detections that merge truths, one at a time.
_PRF = f"""WITH RECURSIVE one AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, max(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL), {V_GT.replace("FROM lineitem", "FROM one")},
 tx AS (SELECT l_orderkey AS image_id, l_linenumber AS id, lower(l_returnflag) AS text FROM one),
 dd AS (SELECT image_id, det_id FROM d WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.image_id = d.image_id AND o.det_id = d.det_id AND o.dont_care AND o.inter / (o.da + 1.0) > 0.5)),
 e AS (SELECT s.image_id, s.gt_id, s.det_id, sigma, tau, a.text = b.text AS same FROM s JOIN g USING (image_id, gt_id) JOIN dd USING (image_id, det_id)
   JOIN tx AS a ON a.image_id = s.image_id AND a.id = gt_id JOIN tx AS b ON b.image_id = s.image_id AND b.id = det_id WHERE NOT g.dont_care),
 gg AS (SELECT image_id, gt_id, list(det_id) FILTER (sigma > 0.7) AS sj, list(det_id) FILTER (tau > 0.6) AS tj, list({{'o': det_id, 'sigma': sigma, 'tau': tau, 'same': same}} ORDER BY det_id) AS links FROM e GROUP BY ALL),
 jj AS (SELECT image_id, det_id, count(*) FILTER (sigma > 0.7) AS ns, count(*) FILTER (tau > 0.6) AS nt, list({{'o': gt_id, 'sigma': sigma, 'tau': tau, 'same': same}} ORDER BY gt_id) AS links FROM e GROUP BY ALL),
 m AS (SELECT gg.image_id, gg.gt_id, sj[1] AS det_id, e.same FROM gg JOIN jj AS a ON a.image_id = gg.image_id AND a.det_id = sj[1] AND a.ns = 1 JOIN jj AS b ON b.image_id = gg.image_id AND b.det_id = tj[1] AND b.nt = 1
   JOIN e ON e.image_id = gg.image_id AND e.gt_id = gg.gt_id AND e.det_id = sj[1] WHERE len(sj) = 1 AND len(tj) = 1),
 st AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY kind, id) AS n, kind, id, links FROM (SELECT image_id, 2 AS kind, gt_id AS id, links FROM gg UNION ALL SELECT image_id, 3, det_id, links FROM jj)),
 f AS (SELECT i.image_id, CAST(0 AS BIGINT) AS n, coalesce(ug, []) AS ug, coalesce(ud, []) AS ud, coalesce(k, 0.0) AS r, coalesce(k, 0.0) AS p, coalesce(h, 0.0) AS hits
   FROM (SELECT DISTINCT image_id FROM e) AS i LEFT JOIN (SELECT image_id, list(gt_id) AS ug, list(det_id) AS ud, CAST(count(*) AS DOUBLE) AS k, CAST(count(*) FILTER (same) AS DOUBLE) AS h FROM m GROUP BY 1) USING (image_id)
  UNION ALL SELECT image_id, n, CASE WHEN kind = 2 AND (one OR many) THEN ug || [id] WHEN kind = 3 AND (one OR many) THEN ug || others ELSE ug END,
    CASE WHEN kind = 3 AND (one OR many) THEN ud || [id] WHEN kind = 2 AND (one OR many) THEN ud || others ELSE ud END,
    r + CASE WHEN one THEN 1.0 WHEN many AND kind = 2 THEN 0.8 WHEN many THEN 0.8 * len(q) ELSE 0.0 END, p + CASE WHEN one THEN 1.0 WHEN many AND kind = 3 THEN 0.8 WHEN many THEN 0.8 * len(q) ELSE 0.0 END,
    hits + CASE WHEN one OR many THEN CAST(len(list_filter(q, lambda x: x.same)) AS DOUBLE) ELSE 0.0 END
  FROM (SELECT *, list_transform(q, lambda x: x.o) AS others, free AND len(q) = 1 AND q[1].sigma >= 0.7 AND (kind = 2 OR q[1].tau >= 0.6) AS one,
     free AND len(q) > 1 AND (CASE WHEN kind = 2 THEN list_sum(list_transform(q, lambda x: x.sigma)) >= 0.7 ELSE list_sum(list_transform(q, lambda x: x.tau)) >= 0.6 END) AS many
   FROM (SELECT f.*, st.n AS nn, st.kind, st.id, CASE WHEN kind = 2 THEN NOT list_contains(ug, id) AND len(list_filter(links, lambda x: x.sigma > 0)) >= 2 ELSE NOT list_contains(ud, id) AND len(list_filter(links, lambda x: x.tau > 0)) >= 2 END AS free,
     CASE WHEN kind = 2 THEN list_filter(links, lambda x: NOT list_contains(ud, x.o) AND x.tau >= 0.6) ELSE list_filter(links, lambda x: NOT list_contains(ug, x.o) AND x.sigma >= 0.6) END AS q
     FROM f JOIN st ON st.image_id = f.image_id AND st.n = f.n + 1) AS z (image_id, n0, ug, ud, r, p, hits, n, kind, id, free, q))),
 w AS (SELECT sum(r) AS r, sum(p) AS p, sum(hits) AS hits FROM (SELECT image_id, arg_max(r, n) AS r, arg_max(p, n) AS p, arg_max(hits, n) AS hits FROM f GROUP BY 1)),
 t AS (SELECT (SELECT count(*) FROM g WHERE NOT dont_care) AS n_gt, (SELECT count(*) FROM dd) AS n_det, r, p, hits FROM w),
 v AS (SELECT *, r / n_gt AS recall, p / n_det AS precision, hits / n_gt AS e2e_recall, hits / n_det AS e2e_precision FROM t)"""
_PRF += " SELECT " + ", ".join(f"round({x}, 9) AS {n}" for n, x in (("recall", "recall"), ("precision", "precision"), ("f_score", "2 * recall * precision / (recall + precision)"), ("seqerr", "1.0 - hits / r"), ("e2e_recall", "e2e_recall"), ("e2e_precision", "e2e_precision"), ("e2e_f_score", "2 * e2e_recall * e2e_precision / (e2e_recall + e2e_precision)"))) + ", n_gt, n_det FROM v"


def _numbered_once(spark, sf) -> DataFrame:
    """lineitem with each number of an order once."""
    return read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"), F.max("l_partkey").alias("l_partkey"))


def _prf(gt: DataFrame, det: DataFrame) -> DataFrame:
    out = matching.detection_scores(gt.where("not dont_care"), matching.without_ignored(det, gt))
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns if not c.startswith("n_")], "n_gt", "n_det")


def _with_points(rows: DataFrame) -> DataFrame:
    """Boxes as polygons of five corners, a little beyond whole numbers."""
    b = F.col("box")
    at = lambda x, y: F.struct((x + 0.25).alias("x"), (y + 0.5).alias("y"))
    r, d = b["x"] + b["w"], b["y"] + b["h"]
    return rows.withColumn("points", F.array(at(b["x"], b["y"]), at(b["x"] + 20, b["y"]), at(r, b["y"]), at(r, d), at(b["x"], d))).drop("box")


@query(_PRF)
def det_prf(spark, sf):
    lines = _numbered_once(spark, sf)
    return _prf(truths(spark, sf, lines), detections(spark, sf, lines))


@query(_PRF)
def det_prf_polygons(spark, sf):
    lines = _numbered_once(spark, sf)
    return _prf(_with_points(truths(spark, sf, lines)), _with_points(detections(spark, sf, lines)))


@query(f"WITH {V_GT} SELECT image_id, gt_id, det_id, sigma, tau FROM s")
def det_overlaps_polygons(spark, sf):
    return matching.overlaps(_with_points(truths(spark, sf)), _with_points(detections(spark, sf)))


#: Angles of two bars each: what two angles share is what their bars share.
_BARS = "SELECT event_id, image_id, [{'x': x, 'y': y, 'w': w, 'h': 8.0}, {'x': x, 'y': y + 8, 'w': 30.0, 'h': h}] AS bars FROM b"


@query(
    f"""WITH {V_BOXES}, l AS ({_BARS}), p AS (SELECT a.event_id AS left_id, b.event_id AS right_id, a.bars AS m, b.bars AS n FROM l AS a JOIN l AS b ON a.image_id = b.image_id AND a.event_id < b.event_id),
 u AS (SELECT left_id, right_id, unnest(m) AS a, n FROM p), v AS (SELECT left_id, right_id, a, unnest(n) AS b FROM u), z AS (SELECT left_id, right_id, sum({_IN_LISTS}) AS shared FROM v GROUP BY ALL)
SELECT left_id, right_id, round(shared, 4) AS shared FROM z WHERE shared > 0"""
)
def polygon_angles_shared(spark, sf):
    x, y, w, h = (F.col("box")[k] for k in "xywh")
    corners = [(x, y), (x + w, y), (x + w, y + 8), (x + 30, y + 8), (x + 30, y + 8 + h), (x, y + 8 + h)]
    rows = boxes(spark, sf).select("event_id", "image_id", F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in corners]).alias("shape"))
    rows = rows.withColumn("around", polygon.box_of(F.col("shape")["x"], F.col("shape")["y"]))
    other = rows.select(F.col("event_id").alias("right_id"), F.col("image_id").alias("i"), F.col("shape").alias("other"), F.col("around").alias("by"))
    near = F.coalesce(matching.touch(F.col("around"), F.col("by")), F.lit(False))
    pairs = rows.join(other, (F.col("image_id") == F.col("i")) & (F.col("event_id") < F.col("right_id")) & near)
    return pairs.select(F.col("event_id").alias("left_id"), "right_id", F.round(polygon.polygon_intersection(F.col("shape"), F.col("other")), 4).alias("shared")).where("shared > 0")


@query(f"WITH {V_BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY event_id) AS n FROM b) SELECT event_id FROM r WHERE n <= 10")
def max_candidates(spark, sf):
    return filters.first_candidates(boxes(spark, sf), ["image_id"], "event_id", 10).select("event_id")


@query(f"WITH {V_TEXTS} SELECT video_id, ts, text FROM t WHERE event_id % 2 = 0 UNION ALL SELECT video_id, ts, text FROM t WHERE event_id % 2 = 1")
def union_batches(spark, sf):
    t = texts(spark, sf)
    return t.where("event_id % 2 = 0").unionByName(t.where("event_id % 2 = 1")).select("video_id", "ts", "text")
