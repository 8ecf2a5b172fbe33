"""Ground truth against detections: overlaps within an image, degree-constrained matching, precision and recall."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import polygon

RECALL, PRECISION, SPLIT = 0.7, 0.6, 0.8


def overlaps(gt: DataFrame, det: DataFrame) -> DataFrame:
    """(image_id, gt_id, det_id, sigma, tau): shared area over the truth's and over the detection's, to two places, where any.

    Both sides have upright boxes in `box`, or both have simple polygons in `points`, whose corners are truncated. An equi-join on the image
    with the bounding boxes' overlap as its residual condition; polygons are clipped after it.
    """
    if "points" in gt.columns:
        return _polygon_overlaps(gt, det)
    g, d = gt.alias("g"), det.alias("d")
    a, b = F.col("g.box"), F.col("d.box")
    pairs = g.join(d, (F.col("g.image_id") == F.col("d.image_id")) & touch(a, b))
    inter = G.overlap_area(a, b)
    share = lambda x: F.coalesce(F.bround(F.try_divide(inter, x["w"] * x["h"]), 2), F.lit(0.0))
    return pairs.select("g.image_id", "g.gt_id", "d.det_id", share(a).alias("sigma"), share(b).alias("tau"))


def touch(a: Column, b: Column) -> Column:
    """Whether two boxes share more than a border."""
    return (a["x"] < b["x"] + b["w"]) & (b["x"] < a["x"] + a["w"]) & (a["y"] < b["y"] + b["h"]) & (b["y"] < a["y"] + a["h"])


def _outlines(rows: DataFrame, key: str, side: str, *more: str) -> DataFrame:
    """(image_id, key, points, more) -> the same under names of a side, corners as arrays of x and y, with the box around the truncated ones."""
    x, y = F.col("points")["x"], F.col("points")["y"]
    named = {"image": F.col("image_id"), "id": F.col(key), "x": x, "y": y, "box": polygon.box_of(x, y, whole=True)} | {c: F.col(c) for c in more}
    return rows.select(*[c.alias(f"{side}_{k}") for k, c in named.items()])


def _shared(g: DataFrame, d: DataFrame) -> DataFrame:
    """Pairs of outlines whose boxes touch, with `s`: the area they share and each one's own.

    Coalesced, the condition asks of neither side that its box isn't null, which would work out all boxes in the scan's filter, in a method too long to be compiled.
    """
    near = F.coalesce(touch(F.col("g_box"), F.col("d_box")), F.lit(False))
    pairs = g.join(d, (F.col("g_image") == F.col("d_image")) & near).drop("g_box", "d_box")
    return pairs.withColumn("s", polygon.polygon_shares(*[F.col(c) for c in ("g_x", "g_y", "d_x", "d_y")], whole=True))


def _polygon_overlaps(gt: DataFrame, det: DataFrame, *more: str) -> DataFrame:
    pairs = _shared(_outlines(gt, "gt_id", "g", *more), _outlines(det, "det_id", "d", *more)).where("s.inter > 0")
    share = lambda x: F.coalesce(F.bround(F.try_divide("s.inter", x), 2), F.lit(0.0))
    kept = [F.col(f"{side}_{c}").alias(f"{name}_{c}") for c in more for side, name in (("g", "gt"), ("d", "det"))]
    return pairs.select(F.col("g_image").alias("image_id"), F.col("g_id").alias("gt_id"), F.col("d_id").alias("det_id"), share("s.a").alias("sigma"), share("s.b").alias("tau"), *kept)


def one_to_one(pairs: DataFrame, recall: float = RECALL, precision: float = PRECISION) -> DataFrame:
    """Pairs that are each other's only overlaps above both limits."""
    hit = lambda c, least: F.when(F.col(c) > least, 1)
    for key, kind in (("gt_id", "g"), ("det_id", "d")):
        w = Window.partitionBy("image_id", key)
        pairs = pairs.withColumn(f"{kind}s", F.count(hit("sigma", recall)).over(w)).withColumn(f"{kind}t", F.count(hit("tau", precision)).over(w))
    alone = (F.col("gs") == 1) & (F.col("gt") == 1) & (F.col("ds") == 1) & (F.col("dt") == 1)
    return pairs.where(alone & (F.col("sigma") > recall) & (F.col("tau") > precision)).select("image_id", "gt_id", "det_id", "sigma", "tau")


def without_ignored(det: DataFrame, gt: DataFrame, share: float = 0.5) -> DataFrame:
    """Detections of which no don't-care truth covers more than `share`: an anti-join on the image."""
    if "points" in gt.columns:
        pairs = _shared(_outlines(gt.where("dont_care"), "gt_id", "g"), _outlines(det, "det_id", "d"))
        covered = pairs.where(F.col("s.inter") / (F.col("s.b") + F.lit(1.0)) > share).select(F.col("d_image").alias("image_id"), F.col("d_id").alias("det_id"))
        return det.join(covered, ["image_id", "det_id"], "left_anti")
    d, g = det.alias("d"), gt.where("dont_care").alias("g")
    a, b = F.col("d.box"), F.col("g.box")
    covered = G.overlap_area(a, b) / (a["w"] * a["h"] + F.lit(1.0)) > share
    return d.join(g, (F.col("d.image_id") == F.col("g.image_id")) & covered, "left_anti")


def scores(sigma: np.ndarray, tau: np.ndarray) -> tuple[float, float, list[tuple[int, int]]]:
    """(recall, precision, text pairs) that an image adds, from its truth by detection overlaps: single matches first, then truths
    split among detections, then detections that merge truths."""
    n, m = sigma.shape
    free_g, free_d = np.ones(n, bool), np.ones(m, bool)
    r = p = 0.0
    texts: list[tuple[int, int]] = []

    def single(i: int, j: int) -> None:
        nonlocal r, p
        r, p = r + 1, p + 1
        free_g[i] = free_d[j] = False
        texts.append((i, j))

    for i in range(n):
        s, t = np.flatnonzero(sigma[i] > RECALL), np.flatnonzero(tau[i] > PRECISION)
        if len(s) == 1 and len(t) == 1 and (sigma[:, s[0]] > RECALL).sum() == 1 and (tau[:, t[0]] > PRECISION).sum() == 1:
            single(i, int(s[0]))
    for i in range(n):
        if free_g[i] and (sigma[i] > 0).sum() >= 2:
            q = np.flatnonzero(free_d & (tau[i] >= PRECISION))
            if len(q) == 1:
                if sigma[i, q[0]] >= RECALL:
                    single(i, int(q[0]))
            elif sigma[i, q].sum() >= RECALL:
                r, p = r + SPLIT, p + SPLIT * len(q)
                free_g[i] = False
                free_d[q] = False
                texts += [(i, int(j)) for j in q]
    for j in range(m):
        if free_d[j] and (tau[:, j] > 0).sum() >= 2:
            q = np.flatnonzero(free_g & (sigma[:, j] >= PRECISION))
            if len(q) == 1:
                if tau[q[0], j] >= PRECISION and sigma[q[0], j] >= RECALL:
                    single(int(q[0]), j)
            elif tau[q, j].sum() >= PRECISION:
                r, p = r + SPLIT * len(q), p + SPLIT
                free_d[j] = False
                free_g[q] = False
                texts += [(int(i), j) for i in q]
    return r, p, texts


def detection_scores(gt: DataFrame, det: DataFrame) -> DataFrame:
    """(recall, precision, f_score, seqerr, n_gt, n_det) over all images; a truth's or detection's text may be null.

    Where no truth and no detection has two overlaps, only single matches can be, and sums say it all. Other images are folded one
    by one from their overlaps (an image's boxes are few); then all are summed.
    """
    pairs = _polygon_overlaps(gt, det, "text") if "points" in gt.columns else overlaps(gt, det)
    if "points" not in gt.columns:
        pairs = pairs.join(gt.select("image_id", "gt_id", F.col("text").alias("gt_text")), ["image_id", "gt_id"]).join(det.select("image_id", "det_id", F.col("text").alias("det_text")), ["image_id", "det_id"])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        g, d = {v: i for i, v in enumerate(sorted(set(pdf["gt_id"])))}, {v: i for i, v in enumerate(sorted(set(pdf["det_id"])))}
        sigma, tau = np.zeros((len(g), len(d))), np.zeros((len(g), len(d)))
        same = {}
        for gi, di, s, t, x, y in zip(pdf["gt_id"], pdf["det_id"], pdf["sigma"], pdf["tau"], pdf["gt_text"], pdf["det_text"], strict=True):
            sigma[g[gi], d[di]], tau[g[gi], d[di]] = s, t
            same[g[gi], d[di]] = x is not None and y is not None and x.lower() == y.lower()
        r, p, texts = scores(sigma, tau)
        return pd.DataFrame({"r": [r], "p": [p], "hits": [float(sum(same.get(k, False) for k in texts))]})

    per = lambda *keys: F.count(F.lit(1)).over(Window.partitionBy("image_id", *keys))
    pairs = pairs.select("image_id", "gt_id", "det_id", "sigma", "tau", "gt_text", "det_text").withColumn("most", F.greatest(per("gt_id"), per("det_id")))
    pairs = pairs.withColumn("most", F.max("most").over(Window.partitionBy("image_id")))
    hit = ((F.col("sigma") > RECALL) & (F.col("tau") > PRECISION)).cast("double")
    alike = F.coalesce((F.lower("gt_text") == F.lower("det_text")).cast("double"), F.lit(0.0))
    plain = pairs.where("most = 1").agg(F.sum(hit).alias("r"), F.sum(hit).alias("p"), F.sum(hit * alike).alias("hits"))
    folded = pairs.where("most > 1").drop("most").groupBy("image_id").applyInPandas(fold, "r double, p double, hits double")
    sums = plain.unionByName(folded).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("r", "p", "hits")])
    totals = gt.agg(F.count(F.lit(1)).alias("n_gt")).join(F.broadcast(det.agg(F.count(F.lit(1)).alias("n_det")))).join(F.broadcast(sums))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = totals.withColumn("recall", ratio(F.col("r"), F.col("n_gt"))).withColumn("precision", ratio(F.col("p"), F.col("n_det")))
    out = out.withColumn("f_score", ratio(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")))
    out = out.withColumn("seqerr", F.lit(1.0) - ratio(F.col("hits"), F.col("r")))
    e2e = {"e2e_recall": ratio(F.col("hits"), F.col("n_gt")), "e2e_precision": ratio(F.col("hits"), F.col("n_det"))}
    out = out.withColumns(e2e).withColumn("e2e_f_score", ratio(2 * F.col("e2e_recall") * F.col("e2e_precision"), F.col("e2e_recall") + F.col("e2e_precision")))
    return out.select("recall", "precision", "f_score", "seqerr", "e2e_recall", "e2e_precision", "e2e_f_score", "n_gt", "n_det")
