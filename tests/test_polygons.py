"""Many polygons at once against one pair at a time, and plans that clip only what can overlap."""

import time

import numpy as np

from palimpsest.functions import polygon
from palimpsest.plans import catalog
from tests.conftest import DATA


def _packed(shapes):
    return np.concatenate(shapes).reshape(-1, 2), np.array([len(p) for p in shapes])


def test_intersections_as_pair_by_pair():
    r = np.random.default_rng(7)

    def star(n):
        t, k = np.sort(r.random(n)) * 2 * np.pi, r.uniform(2, 10, n)
        p = np.stack([k * np.cos(t), k * np.sin(t)], axis=1) + r.uniform(-6, 6, 2)
        return p[:: r.choice([-1, 1])]

    def angle():
        x, y, w, h = r.integers(1, 12, 4)
        return np.array([(x, y), (x + w + 3, y), (x + w + 3, y + 2), (x + 3, y + 2), (x + 3, y + 2 + h), (x, y + 2 + h)], float)

    shapes = [star(r.integers(3, 20)) for _ in range(60)] + [angle() for _ in range(60)] + [np.zeros((n, 2)) for n in range(5)]
    a, b = ([shapes[i] for i in r.permutation(len(shapes))] for _ in range(2))
    got = polygon.intersections(_packed(a), _packed(b))
    want = np.array([polygon.intersection(p, q) for p, q in zip(a, b, strict=True)])
    assert np.allclose(got, want, atol=1e-9) and ((got > 0) == (want > 0)).all()
    assert np.allclose(polygon.sizes(_packed(a)), [abs(polygon.area(p)) for p in a])


def test_many_pairs_in_seconds():
    """One pair at a time took about 0.1 ms a convex pair, so over ten seconds here."""
    a = np.array([(0, 0), (2, 0), (4, 0), (4, 3), (0, 3)], float)
    n = np.full(150_000, 5)
    began = time.perf_counter()
    got = polygon.intersections((np.tile(a, (len(n), 1)), n), (np.tile(a + 1, (len(n), 1)), n))
    assert (got == 6).all() and time.perf_counter() - began < 6


def test_columns_of_shares(spark):
    rows = spark.sql("select array(struct(0.5D x, 0D y), struct(4.5D x, 0D y), struct(4.5D x, 2D y), struct(0.5D x, 2D y)) a, array(struct(2D x, 1D y), struct(2D x, 5D y), struct(9D x, 1D y)) b union all select null, array(struct(2D x, 1D y))")
    got = rows.select(polygon.polygon_shares(rows.a["x"], rows.a["y"], rows.b["x"], rows.b["y"], whole=True).alias("s"), polygon.polygon_intersection(rows.a, rows.b).alias("i")).collect()
    assert [tuple(r.s) for r in got] == [(2.0, 8.0, 14.0), (0.0, 0.0, 0.0)] and [r.i for r in got] == [2.5, 0.0]


def test_angles_apart_are_not_clipped(spark):
    plan = catalog.polygon_angles_shared(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join" in line)
    assert "around" in join
