"""Edge cases of column functions, sinks, configuration and model stages."""

import json
import logging
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import containers, raster, subwords
from palimpsest.functions import geometry as G
from palimpsest.functions import sequence as S
from palimpsest.functions import text as T
from palimpsest.operators import folds
from palimpsest.plans import config, logs, models, pipeline
from palimpsest.sources import files, sampling, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [("0.1,0.6,0.9,0.97", (0.1, 0.6, 0.9, 0.97)), ("10, 60,90,97", (0.1, 0.6, 0.9, 0.97)), ("0,0,1,1", (0, 0, 1, 1)), ("", None), ("1,2,3", None), ("a,b,c,d", None), (None, None)])
def test_roi(spark, text, want):
    got = one(spark, G.parse_roi(F.lit(text).cast("string")))
    assert (None if got is None else tuple(got)) == (want if want is None else pytest.approx(want))


def test_roi_border_is_inside_and_truncated(spark):
    roi = G.parse_roi(F.lit("0.1,0.1,0.555,0.9"))
    inside = lambda x, y, w, h: one(spark, G.in_roi(G.box(x, y, w, h), roi, 1000, 1000))
    assert inside(100, 100, 455, 800) and not inside(99, 100, 10, 10) and not inside(100, 100, 456, 10)
    assert one(spark, G.in_roi(G.box(0, 0, 1, 1), None, 10, 10))


@pytest.mark.parametrize("fps, want", [(25.0, 12), (29.97, 15), (27.0, 14), (0.5, 1)])
def test_stride_rounds_half_to_even(spark, fps, want):
    assert one(spark, sampling.stride(0.5, F.lit(fps))) == want


def test_samplers_on_short_videos(spark):
    videos = spark.createDataFrame([("a", 10.0, 0), ("b", 10.0, 4), ("c", 10.0, 11)], "video_id string, fps double, total_frames bigint")
    idx = lambda df: sorted((r.video_id, r.frame_idx) for r in df.collect())
    assert idx(sampling.modulo(videos, 0.5)) == [("b", 0), ("c", 0), ("c", 5), ("c", 10)]
    assert idx(sampling.sequential(videos, 0.5)) == [("c", 4), ("c", 9)]
    assert idx(sampling.segmented(videos, 0.5, 0.7)) == [("b", 0), ("c", 0), ("c", 5), ("c", 7)]


@pytest.mark.parametrize("text, blank", [("   　", True), ("", True), (None, True), ("\x1c\x85", True), (" a ", False)])
def test_blank(spark, text, blank):
    assert one(spark, T.is_blank(F.lit(text).cast("string"))) is blank


def test_times_and_widths(spark):
    assert one(spark, T.srt_time(F.lit(3661.5))) == "01:01:01,500"
    assert one(spark, T.reversed_runs(F.lit("abاب 12"))) == " 12باab"
    assert one(spark, T.is_logo(F.lit(" AB "))) and not one(spark, T.is_logo(F.lit("ABC")))
    assert one(spark, T.edit_distance(F.lit(""), F.lit(""))) == 0


def test_decoders_on_empty_and_ended_paths(spark):
    empty = F.expr("cast(array() as array<struct<id:int,p:double>>)")
    path = F.expr("cast(array(struct(1, 0.5D), struct(1, 0.9D), struct(0, 0.9D), struct(1, 0.7D)) as array<struct<id:int,p:double>>)")
    for kind in S.LAYOUTS:
        assert one(spark, S.decoded(empty, ["a", "b"], S.LAYOUTS[kind]))["text"] == ""
    assert one(spark, S.decoded(empty, ["a"], S.LAYOUTS["ctc"]))["conf"] == 0
    got = one(spark, S.decoded(path, ["a", "b"], S.LAYOUTS["ctc"]))
    assert (got.text, got.conf) == ("aa", pytest.approx(0.6))
    assert one(spark, S.decoded(path, ["a", "b"], S.LAYOUTS["ar"]))["text"] == "aa"
    assert one(spark, S.encoded(F.lit("?"), ["a"], "ctc")) is None and one(spark, S.encoded(F.lit("aaa"), ["a"], "ctc", 2)) is None


def test_cues_and_files(spark, tmp_path):
    rows = [("v", 1.0, 0, "low", 0.9, (0.0, 50.0, 9.0, 9.0)), ("v", 1.0, 1, "high", 0.9, (0.0, 10.0, 9.0, 9.0)), ("v", 5.0, 0, "end", 0.9, (0.0, 0.0, 9.0, 9.0))]
    texts = spark.createDataFrame(rows, "video_id string, ts double, line_idx int, text string, score double, box struct<x:double,y:double,w:double,h:double>")
    segments = folds.track(texts)
    blocks = [r.block for r in sinks.srt_blocks(sinks.cues(segments)).orderBy("idx").collect()]
    assert blocks == ["1\n00:00:01,000 --> 00:00:03,000\nhigh | low", "2\n00:00:05,000 --> 00:00:07,000\nend"]
    assert sinks.write_json_file(segments, f"{tmp_path}/out.json") == 2
    assert [s["texts"][0]["text"] for s in json.loads((tmp_path / "out.json").read_text())] == ["low", "end"]
    sinks.write_srt(segments, f"{tmp_path}/srt")
    sinks.write_json(segments, f"{tmp_path}/json")
    assert spark.read.text(f"{tmp_path}/json").count() == 2


def test_configuration(tmp_path):
    (tmp_path / "base.json").write_text('{"a": {"b": 1, "c": 2}, "d": 3}')
    (tmp_path / "top.json").write_text('{"_BASE_": ["base.json"], "a": {"b": 9}}')
    found = config.load(tmp_path / "top.json")
    assert found == {"a": {"b": 9, "c": 2}, "d": 3}
    assert config.override(found, ["a.c=[1, 2]", "e.f=x"]) == {"a": {"b": 9, "c": [1, 2]}, "d": 3, "e": {"f": "x"}}
    assert config.Settings.of({"drop_score": 0.3, "other": 1}).drop_score == 0.3
    with pytest.raises(KeyError):
        config.Registry().chain(None, [{"missing": {}}])


def test_files(spark, tmp_path):
    for n in ("b.PNG", "a.jpg", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "z.png").write_bytes(b"xy")
    for most in (100, 0):
        assert sorted((r.image_idx, r.filename, bytes(r.content)) for r in files.images(spark, str(tmp_path), most=most).collect()) == [(0, "a.jpg", b"x"), (1, "b.PNG", b"x"), (2, "z.png", b"xy")]
    assert [(r.image_idx, r.path[-5:]) for r in files.image_list(spark, str(tmp_path)).orderBy("image_idx").collect()] == [(0, "a.jpg"), (1, "b.PNG")]
    assert files.image_list(spark, f"{tmp_path}/a.jpg").count() == 1
    with pytest.raises(FileNotFoundError):
        files.image_list(spark, f"{tmp_path}/c.txt")
    (tmp_path / "chars").write_text("b\na\n \n", encoding="utf-8")
    assert files.charset(spark, f"{tmp_path}/chars", space=True) == ["b", "a", " ", " "]


def test_pipelines_with_a_stub_model(spark):
    frames = spark.createDataFrame([("v", i, i / 2, bytes([i, 7])) for i in range(30)], "video_id string, frame_idx bigint, ts double, image binary")
    settings = config.Settings(drop_score=0.5, roi=None, size_most=(0.9, 0.9))
    segments = pipeline.frames_to_segments(frames, 1280, 720, settings=settings)
    assert segments.count() > 0 and segments.columns == ["video_id", "segment_id", "start_time", "end_time", "timestamp", "texts"]
    images = spark.createDataFrame([(i, f"{i}.png", bytes([i, 7])) for i in range(20)], "image_idx int, filename string, image binary")
    got = pipeline.images_to_texts(images, 1280, 720, settings=settings)
    assert got.count() == 20 and got.where("texts is null").count() == 0
    pages = images.select(F.col("filename").alias("file"), F.lit(None).cast("int").alias("page"), "image")
    assert pipeline.end_to_end(pages).count() == 20
    assert models.detect(frames.limit(0)).count() == 0


def _slow_lines(image, settings, width=1280, height=720):
    """(text, score, box) of a picture's lines, step by step."""
    stub, boxes = models.StubModel(), []
    for quad, _ in stub.detect([image])[0]:
        (x, y), (r, d) = quad[0], quad[2]
        w, h = (r - x) / width, (d - y) / height
        if settings.size_least[0] <= w <= settings.size_most[0] and settings.size_least[1] <= h <= settings.size_most[1]:
            boxes.append((x, y, r - x, d - y))
    out = []
    for of in folds.merge_lines(boxes):
        x, y, w, h = folds.box_around([boxes[i] for i in of])
        out.append((*stub.recognize([image], [[(x, y), (x + w, y), (x + w, y + h), (x, y + h)]])[0], (x, y, w, h)))
    return [t for t in out if t[1] >= settings.drop_score]


def test_pictures_are_read_as_step_by_step(spark):
    settings = config.Settings(drop_score=0.85, roi=None, size_least=(0.05, 0.01), size_most=(0.2, 0.9), skip_logos=False)
    rows = [(i, f"{i}.png", bytes([i, 7])) for i in range(60)] + [(60, "none.png", None)]
    images = spark.createDataFrame(rows, "image_idx int, filename string, image binary").repartition(3)
    got = {r.image_idx: [(t.text, t.score, tuple(t.box)) for t in r.texts] for r in pipeline.images_to_texts(images, 1280, 720, settings=settings).collect()}
    assert got == {i: sorted(_slow_lines(image or b"", settings), key=lambda t: t[2][1]) for i, _, image in rows}
    assert sum(map(len, got.values())) > 20
    items = {r.file: [(t.transcription, t.score, tuple(map(tuple, t.points))) for t in r.items] for r in pipeline.end_to_end(images.selectExpr("filename file", "cast(null as int) page", "image"), drop_score=0.85).collect()}
    for _, name, image in rows:
        quads = [q for q, _ in models.StubModel().detect([image or b""])[0]]
        read = [(t, s, tuple(q)) for (t, s), q in zip(models.StubModel().recognize([image or b""] * len(quads), quads), quads, strict=True) if s >= 0.85]
        assert items[name] == [read[i] for i in folds.reading_swaps([q[0] for _, _, q in read])]


def test_each_model_is_called_once_and_no_picture_moves(spark):
    frames = spark.createDataFrame([("v", i, i / 2, bytes([i, 7])) for i in range(8)], "video_id string, frame_idx bigint, ts double, image binary")
    images = frames.selectExpr("cast(frame_idx as int) image_idx", "video_id filename", "image")
    plans = {
        "segments": (pipeline.frames_to_segments(frames, 1280, 720), 3),
        "texts": (pipeline.images_to_texts(images, 1280, 720), 3),
        "pages": (pipeline.end_to_end(images.selectExpr("filename file", "image_idx page", "image")), 3),
    }
    for name, (df, calls) in plans.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == calls, (name, plan)
        moved = plan[: plan.index("Exchange")] if "Exchange" in plan else ""
        assert plan.count("Exchange") == (1 if name == "segments" else 0) and "image" not in moved


def test_batches_by_aspect_ratio_are_all_and_in_order():
    quad = lambda w, h: [(0.0, 0.0), (w, 0.0), (w, h), (0.0, h)]
    quads = [quad(float(w), 10.0) for w in (90, 10, 50, 30, 70)] + [quad(5.0, 0.0)]
    batches = models.by_aspect(quads, 2)
    assert batches == [[1, 3], [2, 4], [0, 5]] and models.by_aspect([], 4) == []


@pytest.mark.parametrize("text, want", [("Caf\u00e9 \u2460\u3000x", "Cafe1x"), ("a\tb \n", "ab"), ("\u0448", ""), ("", ""), (None, None)])
def test_ascii_folding(spark, text, want):
    assert one(spark, T.ascii_folded(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("n, want", [(4, [0, 3, 6, 9]), (10, list(range(9)) + [9]), (11, None), (2, [0, 9])])
def test_points_spread_along_a_path(spark, n, want):
    assert one(spark, S.spread_points(F.sequence(F.lit(0), F.lit(9)), n)) == want


def test_points_along_their_direction(spark):
    points = [(float(i * 7 % 20), float(i * 3 % 20), 1.0, 0.5 if i % 2 else -0.25) for i in range(20)]

    def slow(p):
        dx, dy = (sum(q[k] for q in p) / len(p) for k in (2, 3))
        return sorted(p, key=lambda q: q[0] * dx + q[1] * dy)

    for n in (0, 1, 15, 16, 17, 20):
        df = spark.createDataFrame([(points[:n],)], "p array<struct<x:double,y:double,dx:double,dy:double>>")
        want = slow(points[:n]) if n else []
        if n >= 16:
            want = slow(want[: n // 2]) + slow(want[n // 2 :])
        assert [tuple(q) for q in df.select(G.along_direction(F.col("p")).alias("p")).first().p] == want


def test_decoding_along_a_path_with_the_blank_last(spark):
    path = F.expr("cast(array(struct(0, 0.5D), struct(0, 0.5D), struct(2, 0.9D), struct(0, 0.9D), struct(1, 0.7D)) as array<struct<id:int,p:double>>)")
    assert one(spark, S.decoded(path, ["a", "b"], S.LAYOUTS["pg"]))["text"] == "aab"


def _atom(kind, *bodies):
    body = b"".join(bodies)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _track(handler, runs, scale=600, size=(1280, 720), version=0):
    head = struct.pack(">B3x", version) + bytes(20 if version == 0 else 32) + bytes(52) + struct.pack(">II", *(x << 16 for x in size))
    media = struct.pack(">B3x", version) + bytes(8 if version == 0 else 16) + struct.pack(">I", scale) + bytes(8)
    times = bytes(4) + struct.pack(">I", len(runs)) + b"".join(struct.pack(">II", *r) for r in runs)
    kind = bytes(8) + handler + bytes(12)
    return _atom(b"trak", _atom(b"tkhd", head), _atom(b"mdia", _atom(b"mdhd", media), _atom(b"hdlr", kind), _atom(b"minf", _atom(b"stbl", _atom(b"stts", times)))))


def test_headers_of_videos(spark, tmp_path):
    whole = _atom(b"ftyp", b"isom") + _atom(b"moov", _track(b"soun", [(10, 1)]), _track(b"vide", [(100, 20), (50, 40)])) + _atom(b"mdat", b"x" * 50)
    assert containers.video_header(whole) == {"fps": 150 * 600 / 4000, "total_frames": 150, "width": 1280, "height": 720}
    wide = struct.pack(">I4sQ", 1, b"free", 16 + 5) + b"12345" + _atom(b"moov", _track(b"vide", [(25, 24)], version=1, size=(64, 48)))
    assert containers.video_header(wide) == {"fps": 25.0, "total_frames": 25, "width": 64, "height": 48}
    avi = b"RIFF" + bytes(20) + b"avih" + struct.pack("<11I", 56, 40_000, 0, 0, 0, 250, 0, 1, 0, 320, 240)
    assert containers.video_header(avi) == {"fps": 25.0, "total_frames": 250, "width": 320, "height": 240}
    for bad in (b"", b"RIFF", b"noise" * 9, whole[:60], _atom(b"moov", _track(b"soun", [(1, 1)])), _atom(b"moov", _track(b"vide", []))[:-8]):
        assert containers.video_header(bad) is None
    for name, data in (("a.mp4", whole), ("b.AVI", avi), ("bad.mov", b"noise"), ("c.txt", whole)):
        (tmp_path / name).write_bytes(data)
    rows = {r.video_id: (r.fps, r.total_frames, r.width, r.height) for r in files.videos(spark, str(tmp_path)).collect()}
    assert rows == {"a.mp4": (22.5, 150, 1280, 720), "b.AVI": (25.0, 250, 320, 240)}
    assert sampling.modulo(files.videos(spark, str(tmp_path)), 1.0).count() > 10


def _element(kind, body, order="<"):
    if len(body) <= 4:
        return struct.pack(f"{order}I", len(body) << 16 | kind) + body.ljust(4, b"\0")
    return struct.pack(f"{order}II", kind, len(body)) + body + b"\0" * (-len(body) % 8)


def _mat(name, values, code=9, order="<"):
    kinds = {9: "f8", 2: "u1", 3: "i2"}
    parts = struct.pack(f"{order}II", 6, 0), struct.pack(f"{order}ii", *values.shape), name.encode(), values.astype(order + kinds[code]).tobytes(order="F")
    return struct.pack(f"{order}II", 14, 0)[:4] + b"".join([struct.pack(f"{order}I", sum(map(len, p := [_element(6, parts[0], order), _element(5, parts[1], order), _element(1, parts[2], order), _element(code, parts[3], order)]))), *p])


def test_matrices_of_files(spark, tmp_path):
    a, b = np.arange(6).reshape(2, 3) * 1.5, np.array([[1, 2, 3, 4, 5]])
    head = lambda mark: b"MATLAB 5.0".ljust(124) + b"\0\1" + mark
    packed = zlib.compress(_mat("polygt", a))
    body = _mat("x", b, 2) + struct.pack("<II", 15, len(packed)) + packed + _mat("y", b, 3)
    got = containers.matrices(head(b"IM") + body)
    assert [n for n, _ in got] == ["x", "polygt", "y"] and all((v == w).all() for (_, v), w in zip(got, (b, a, b), strict=True))
    cells = _element(6, struct.pack("<II", 1, 0)) + _element(5, struct.pack("<ii", 1, 2)) + _element(1, b"cells") + _mat("", a) + _mat("", b)
    assert [(n, v.tolist()) for n, v in containers.matrices(head(b"IM") + struct.pack("<II", 14, len(cells)) + cells)] == [("cells", a.tolist()), ("cells", b.tolist())]
    big = containers.matrices(head(b"MI") + _mat("z", a, order=">"))
    assert len(big) == 1 and big[0][0] == "z" and (big[0][1] == a).all()
    assert containers.matrices(b"") == containers.matrices(b"x" * 300) == containers.matrices(head(b"IM") + b"\x0f\0\0\0\x09\0\0\0notpacked") == []
    (tmp_path / "poly_gt_img1.mat").write_bytes(head(b"IM") + body)
    assert {(r.name, str(r["values"])) for r in files.matrices(spark, str(tmp_path)).collect()} == {("x", str(b.astype(float).tolist())), ("polygt", str(a.tolist())), ("y", str(b.astype(float).tolist()))}


def test_variants_of_windows(spark):
    """Variants against lists that are changed in place."""
    charset, k = list("abcdef"), 3
    for word in ("abcabcab", "ab", "ffffff", "abcdefabcdef", "a"):
        dice = [(i % 3, 1 + i * 5 % 6, (i + 1) % 3, 1 + i * 7 % 6) for i in range(13)]
        column = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("at", "id", "then_at", "then_id"), d)]) for d in dice])
        got = one(spark, S.window_label(F.lit(word), charset, 12, k, dice=column))
        ids = ["abcdef".index(c) + 1 for c in word]
        filled = [8] * k + ids + [9] * k
        n = len(ids)
        for name, subs, told in (
            ("", [filled[i : i + k] for i in range(n + 1)], ids + [0]),
            ("_back", [filled[n + k - i : n + 2 * k - i] for i in range(n + 1)], ids[::-1] + [0]),
        ):
            for i, (window, x) in enumerate(list(zip(subs, told))[k:]):
                new = list(window)
                new[dice[i][0]] = dice[i][1]
                if new not in subs:
                    subs.append(new)
                    told.append(x)
                window[dice[i][2]] = dice[i][3]
            assert got[f"n_subs{name}"] == len(subs) and got[f"subs{name}"] == subs + [[10] * k] * (26 - len(subs))
            assert got[f"next{name}"] == told + [10] * (26 - len(told))
    assert one(spark, S.window_label(F.lit("xyz"), charset)) is None


def test_outlines():
    x = np.zeros((20, 30, 3), np.uint8)
    got = raster.outlined(x, [np.array([(5.0, 4.0), (25.0, 4.0), (25.0, 15.0), (5.0, 15.0)])], (1, 2, 3), 1)
    assert (got[4, 5:26] == (1, 2, 3)).all() and (got[4:16, 25] == (1, 2, 3)).all() and got.any(axis=2).sum() == 2 * 21 + 2 * 10
    assert raster.outlined(x, [np.array([(-9.0, -9.0), (90.0, 90.0)])], thick=3).any() and not x.any() and not raster.outlined(x, []).any()


def test_logger_and_observed_figures(spark, tmp_path):
    log = logs.logger("test", f"{tmp_path}/log.txt")
    assert logs.logger("test") is log and log.level == logging.DEBUG
    log.info("read")
    assert "test INFO: read" in (tmp_path / "log.txt").read_text()
    df, seen = logs.observed(spark.range(10), rows=F.count(F.lit(1)), most=F.max("id"))
    assert df.count() == 10 and seen.get == {"rows": 10, "most": 9}


def test_heads_of_word_parts(spark):
    table = ["[GO]", "hel", "lo", "#", "[SEP]", "##ing", "read", ".", "it", "'s", "#x"]
    steps = lambda *ids: [(i, 0.5 + i / 100) for i in ids]
    near = lambda text, conf: (text, pytest.approx(conf))
    assert subwords.pairs_text(steps(1, 2, 3, 6), table) == near("hello", 0.51 * 0.52)
    assert subwords.pairs_text(steps(3, 1), table) == ("", 1) and subwords.pairs_text(steps(10, 1), table)[0] == "#xhel"
    assert subwords.pieces_text(steps(6, 5, 7, 4, 1), table) == near("reading. ", 0.56 * 0.55 * 0.57 * 0.54)
    assert subwords.pieces_text(steps(8, 9), table) == near("it'", 0.58) and subwords.pieces_text([], table) == ("", 0.0)
    path = lambda ids: F.array(*[F.struct(F.lit(i).alias("id"), F.lit(p).alias("p")) for i, p in steps(*ids)])
    both = {k: one(spark, subwords.decoded(path([0, 1, 99, 2, 3]), table, k)) for k in ("pairs", "pieces")}
    assert both["pairs"]["text"] == "hello" and both["pairs"]["conf"] == pytest.approx(0.51 * 0.52)
    assert both["pieces"]["text"] == "hel lo " and both["pieces"]["conf"] == pytest.approx(0.51 * 0.52)
    heads = {"char": F.struct(F.lit("helo").alias("text"), F.lit(0.2).alias("conf")), "bpe": subwords.decoded(path([0, 1, 2, 3]), table, "pairs")}
    assert one(spark, S.best_head(heads))["text"] == "hello"


def test_reading_along_paths(spark):
    rng = np.random.default_rng(5)
    probs = rng.random((9, 11, 4)).tolist()
    paths = [[(int(rng.integers(9)), int(rng.integers(11))) for _ in range(k)] for k in (1, 2, 5, 6, 7, 12, 30)] + [[(0, 0), (8, 10)], [(4, 4)] * 6, []]

    def dense(path):
        out = []
        for (y, x), (v, u) in zip(path, path[1:]):
            m = max(abs(y - v), abs(x - u))
            out += [(int(y - k * ((y - v) / m)), int(x - k * ((x - u) / m))) for k in range(m)] if m else [(y, x)]
        return out + path[-1:]

    for n, full in ((6, False), (2, False), (3, True)):
        want = []
        for path in paths:
            if len(path) >= n:
                points = dense(path) if full else path
                ids = [int(np.argmax(probs[y][x])) for y, x in points]
                text = "".join("abc"[i] for k, i in enumerate(ids) if i < 3 and (k == 0 or i != ids[k - 1]))
                step = len(points) // (n - 1)
                if len(text) >= 2:
                    want.append((text, [points[k * step] for k in range(n - 1)] + [points[-1]]))
        df = spark.createDataFrame([(probs, paths)], "probs array<array<array<double>>>, paths array<array<struct<y:int,x:int>>>")
        got = df.select(S.read_along(F.col("probs"), F.col("paths"), list("abc"), n, dense=full).alias("r")).first()["r"]
        assert [(r.text, [tuple(p) for p in r.points]) for r in got] == want and want
