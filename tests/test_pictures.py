"""Pixel kernels against brute force, and picture columns on files, nulls and odd sizes."""

import struct
import zlib
from collections import deque

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import geometry as G
from palimpsest.functions import raster
from palimpsest.operators import pictures
from palimpsest.plans import models
from palimpsest.sources import files


def png(x):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    h, w = x.shape[:2]
    raw = b"".join(b"\0" + x[y, :, ::-1].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def flood(mask, corners):
    """Labels by breadth-first search."""
    label, n = np.zeros(mask.shape, int), 0
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (corners or not (a and b))]
    for start in zip(*np.nonzero(mask), strict=True):
        if not label[start]:
            n += 1
            label[start] = n
            todo = deque([start])
            while todo:
                y, x = todo.popleft()
                for a, b in near:
                    p = (y + a, x + b)
                    if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and not label[p]:
                        label[p] = n
                        todo.append(p)
    return label


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 14), st.integers(1, 14), st.floats(0.2, 0.8), st.booleans())
def test_regions_are_those_of_a_search(seed, h, w, share, corners):
    mask = np.random.default_rng(seed).random((h, w)) < share
    assert (raster.regions(mask, corners) == flood(mask, corners)).all()


def test_holes_are_filled():
    ring = np.zeros((7, 7), bool)
    ring[1:6, 1:6] = True
    ring[3, 3] = False
    assert raster.filled(ring).sum() == 25 and not raster.filled(ring)[0].any()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=3, max_size=25))
def test_least_rectangle_holds_all_points_and_no_other_angle_is_better(points):
    p = np.array(points)
    corners, a, b = raster.least_rectangle(p)
    if min(a, b) < 1e-6:  # points on one line
        return
    u, v = (corners[1] - corners[0]) / a, (corners[3] - corners[0]) / b
    for axis, side in ((u, a), (v, b)):
        at = (p - corners[0]) @ axis
        assert at.min() > -1e-6 and at.max() < side + 1e-6
    turn = np.linspace(0, np.pi / 2, 721)
    one, other = (p @ np.stack([np.cos(t), np.sin(t)]) for t in (turn, turn + np.pi / 2))
    assert a * b <= (np.ptp(one, axis=0) * np.ptp(other, axis=0)).min() + 1e-6


def test_map_boxes_finds_widened_rectangles_in_order():
    prob = np.zeros((60, 100), np.float32)
    prob[10:20, 10:50] = 0.9
    prob[30:50, 60:70] = 0.8
    prob[40:42, 5:30] = 0.9  # two pixels high: too thin
    prob[55:59, 5:30] = 0.4  # over the mask, under the score
    (a, one), (b, other) = raster.map_boxes(prob, 120, 200)
    by = 39 * 9 * 1.5 / (2 * (39 + 9))
    assert a.tolist() == np.rint(2 * np.array([(10 - by, 10 - by), (49 + by, 10 - by), (49 + by, 19 + by), (10 - by, 19 + by)])).tolist()
    assert one == pytest.approx(0.9) and other == pytest.approx(0.8) and b[0, 0] < 120 < b[1, 0]
    assert len(raster.map_boxes(prob, 120, 200, least_score=0.85)) == 1 and len(raster.map_boxes(prob, 120, 200, most=0)) == 0
    assert raster.map_boxes(np.zeros((5, 5)), 5, 5) == []


def test_map_boxes_of_a_slanted_region_and_exact_score():
    y, x = np.mgrid[0:80, 0:80]
    prob = ((np.abs(x - y) <= 6) & (x + y > 40) & (x + y < 120)).astype(float)
    ((quad, score),) = raster.map_boxes(prob, 80, 80, unclip=1.0, exact=True)
    assert score == 1.0
    side = np.linalg.norm(np.roll(quad, -1, axis=0) - quad, axis=1)
    assert sorted(side)[0] == pytest.approx(sorted(side)[1], abs=2) and max(side) > 50


def test_kernels_on_plain_pictures():
    flat = np.full((5, 7, 3), 90, np.uint8)
    assert (raster.blurred(flat) == 90).all() and (raster.softened(flat) == 27).all()
    assert (raster.enhanced(flat) == 145).all() and (raster.resized(flat, 11, 3) == 90).all()
    ramp = np.repeat(np.arange(0, 250, 10, dtype=np.uint8)[None, :, None], 3, axis=0)
    assert raster.resized(ramp, 3, 50)[0, 1:-1, 0].astype(int).tolist() == np.rint(np.arange(1, 49) * 5 - 2.5).astype(int).tolist()
    both = np.where(np.arange(40).reshape(5, 8, 1) % 3, 200, 10).astype(np.uint8).repeat(3, axis=2)
    assert set(raster.binarised(both).ravel()) == {0, 255} and (raster.binarised(both)[both == 200] == 255).all()
    see = np.dstack([np.full((2, 2, 3), 100, np.uint8), np.array([[0, 255], [51, 255]], np.uint8)])
    assert raster.on_colour(see)[..., 0].tolist() == [[255, 100], [224, 100]] and raster.on_colour(flat) is flat
    assert raster.blurred(np.full((1, 1, 1), 7, np.uint8)).tolist() == [[[7]]]


def test_rectified_is_the_crop_for_upright_quads_and_turns_high_ones():
    x = np.random.default_rng(3).integers(0, 256, (30, 40, 3), dtype=np.uint8)
    quad = np.array([(5, 4), (25, 4), (25, 14), (5, 14)])
    assert (raster.rectified(x, quad, 20, 10) == x[4:14, 5:25]).all()
    high = np.array([(5, 4), (9, 4), (9, 24), (5, 24)])
    assert (raster.rectified(x, high, 4, 20) == np.rot90(x[4:24, 5:9])).all()
    assert raster.rectified(x, quad, 0, 10).size == 0


@pytest.fixture(scope="module")
def shots(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("shots")
    x = np.zeros((90, 160, 3), np.uint8)
    x[20:40, 30:120] = (10, 200, 250)
    (folder / "a.png").write_bytes(png(x))
    (folder / "b.PNG").write_bytes(b"no picture")
    (folder / "c.txt").write_bytes(png(x))
    return files.pictures(spark, str(folder)), x


def test_picture_files(shots):
    df, x = shots
    rows = {r.filename: r.image for r in df.collect()}
    assert set(rows) == {"a.png", "b.PNG"} and rows["b.PNG"] is None
    assert (pictures.pixels(rows["a.png"].asDict()) == x).all()


def test_columns_on_null_pictures_and_empty_crops(shots):
    df, x = shots
    rows = df.select(
        "filename",
        pictures.chained(F.col("image"), ["soften", "enhance", "binarise"]).alias("p"),
        pictures.cropped(F.col("image"), F.lit(200), F.lit(0), F.lit(300), F.lit(9)).alias("none"),
        pictures.padded(F.col("image"), F.lit(100), F.lit(None).cast("int")).alias("no_size"),
        pictures.normalised(F.col("image")).alias("v"),
    )
    got = {r.filename: r for r in rows.collect()}
    assert got["b.PNG"].p is None and got["b.PNG"].v is None and got["a.png"].none is None and got["a.png"].no_size is None
    assert (pictures.pixels(got["a.png"].p.asDict()) == raster.binarised(raster.enhanced(raster.softened(x)))).all()
    assert np.allclose(np.array(got["a.png"].v).reshape(3, 90, 160), raster.normalised(x))
    with pytest.raises(ValueError):
        pictures.chained(F.col("image"), ["eval"])


def test_windows_and_tiles_cut_the_picture(shots):
    df, x = shots
    from palimpsest.functions import geometry as G

    a = df.where("filename = 'a.png'").select("image")
    halves = [pictures.pixels(r.image.asDict()) for r in pictures.windows(a, G.half_windows(F.col("image.width"))).orderBy("chunk_idx").collect()]
    assert [(h == x[:, i : i + 80]).all() for h, i in zip(halves, (0, 80, 40), strict=True)] == [True] * 3
    tiles = pictures.tiled(a, size=64, overlap=16).collect()
    assert sorted((t.left, t.top) for t in tiles) == [(0, 0), (0, 26), (48, 0), (48, 26), (96, 0), (96, 26)]
    for t in tiles:
        assert (pictures.pixels(t.image.asDict())[: t.bottom - t.top, : t.right - t.left] == x[t.top : t.bottom, t.left : t.right]).all()


def test_lines_fitted_to_an_input(shots):
    df, x = shots
    size = G.line_size(F.col("image.width"), F.col("image.height"), "pad", (32, 128))
    got = pictures.pixels(df.where("filename = 'a.png'").select(pictures.fitted(F.col("image"), size).alias("p")).first().p.asDict())
    wide = -(-32 * x.shape[1] // x.shape[0])
    assert got.shape == (32, 128, 3) and (got[:, :wide] == raster.resized(x, 32, wide)).all() and not got[:, wide:].any()


def test_rectangles_of_points(shots):
    df, x = shots
    at = lambda a, b: F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y"))
    points = F.array(at(30, 20), at(119, 20), at(119, 39), at(30, 39), at(50, 30))
    quad = F.array(at(30, 20), at(119, 20), at(119, 39), at(30, 39))
    row = df.where("filename = 'a.png'").select(pictures.least_rectangle_crop(F.col("image"), points).alias("a"), pictures.rectified(F.col("image"), quad).alias("b")).first()
    assert (pictures.pixels(row.a.asDict()) == x[20:39, 30:119]).all() and row.a.data == row.b.data


def test_detection_whole_and_by_tiles_agree(shots):
    df, _ = shots
    maps = models.probability_maps(df.select("filename", "image"))
    size = maps.withColumns({"h": F.col("height"), "w": F.col("width")})
    whole = pictures.map_boxes(size, F.col("h"), F.col("w"), least_score=0.5).collect()
    tiled = models.detect_tiled(df, ["filename"], size=128, overlap=32, least_score=0.5).collect()
    assert len(whole) == len(tiled) == 1 and whole[0].filename == tiled[0].filename == "a.png"
    for p, q in zip(whole[0].quad, tiled[0].quad, strict=True):
        assert abs(p.x - q.x) <= 2 and abs(p.y - q.y) <= 2
