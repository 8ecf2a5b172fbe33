"""Language identification by a convolutional network over bytes, trained and applied in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded, written

#: Bytes of a window, filter widths, filters of each width.
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16


class Network:
    """Byte embeddings folded into filters (a table per filter position), ReLU, max pooling over the window, softmax."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.tables = [rng.normal(0, 0.3 / k, (k, 256, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.w = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.b = np.zeros(len(labels), np.float32)
        self._pairs = None

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """ReLU of the maximum over positions, and the positions of the maxima."""
        best, at = [], []
        for t, k in zip(self.tables, WIDTHS, strict=True):
            n = x.shape[1] - k + 1
            out = t[0][x[:, :n]]
            for j in range(1, k):
                out += t[j][x[:, j : j + n]]
            at.append(out.argmax(axis=1))
            best.append(np.take_along_axis(out, at[-1][:, None], 1)[:, 0])
        return np.maximum(np.concatenate(best, axis=1), 0), at

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy, for the filters of each width, the last layer's weights and its offsets."""
        hidden, at = self._pooled(x)
        p = _softmax(hidden @ self.w + self.b)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        back = (p @ self.w.T) * (hidden > 0)
        grads = []
        for f, (t, k) in enumerate(zip(self.tables, WIDTHS, strict=True)):
            g = np.zeros_like(t)
            part = back[:, f * FILTERS : (f + 1) * FILTERS]
            for j in range(k):
                np.add.at(g[j], (np.take_along_axis(x, at[f] + j, 1), np.arange(FILTERS)), part)
            grads.append(g)
        return [*grads, hidden.T @ p, p.sum(axis=0)]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 11) -> Network:
        """Adam on cross-entropy. Through max pooling only the maxima's bytes get gradients."""
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.w, self.b]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                xb, yb = x[order[i : i + batch]], y[order[i : i + batch]]
                grads = self.gradients(xb, yb)
                step += 1
                for q, g, mi, vi in zip(params, grads, m, v, strict=True):
                    mi += 0.1 * (g - mi)
                    vi += 0.001 * (g * g - vi)
                    q -= rate * (mi / (1 - 0.9**step)) / (np.sqrt(vi / (1 - 0.999**step)) + 1e-8)
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities of windows (n, WINDOW). Filters are looked up by byte pairs, which halves the look-ups."""
        if self._pairs is None:
            a, b = np.arange(65536) >> 8, np.arange(65536) & 255
            self._pairs = [[t[j][a] + t[j + 1][b] for j in range(0, k - 1, 2)] for t, k in zip(self.tables, WIDTHS, strict=True)]
        out = np.empty((len(x), len(self.labels)), np.float32)
        for i in range(0, len(x), 32):
            xb = x[i : i + 32]
            two = xb[:, :-1].astype(np.intp) * 256 + xb[:, 1:]
            best = []
            for t, pair, k in zip(self.tables, self._pairs, WIDTHS, strict=True):
                n = WINDOW - k + 1
                s = pair[0].take(two[:, :n], axis=0)
                for j in range(1, len(pair)):
                    s += pair[j].take(two[:, 2 * j : 2 * j + n], axis=0)
                if k % 2:
                    s += t[k - 1].take(xb[:, k - 1 : k - 1 + n], axis=0)
                best.append(s.max(axis=1))
            out[i : i + 32] = _softmax(np.maximum(np.concatenate(best, axis=1), 0) @ self.w + self.b)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str | None, float]]:
        """(label, score) of each whole text: the mean of its windows' probabilities, weighed by their bytes."""
        out: list[tuple[str | None, float]] = []
        held: list[bytes] = []
        size = 0
        for text in texts:
            held.append((text or "").encode().lower())
            size += len(held[-1])
            if size > 1 << 19:
                out += self._predict(held)
                held, size = [], 0
        return out + (self._predict(held) if held else [])

    def _predict(self, raw: list[bytes]) -> list[tuple[str | None, float]]:
        x, weight, owner = windows(raw)
        total = np.zeros((len(raw), len(self.labels)))
        np.add.at(total, owner, self.probabilities(x) * weight[:, None])
        total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-9)
        best = total.argmax(axis=1)
        return [(self.labels[j], min(1.0, float(total[i, j]))) for i, j in enumerate(best)]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows padded with zero bytes, their true lengths, index of the text) that cover every byte of the texts."""
    size = np.array([len(x) for x in raw])
    count = np.maximum(1, -(-size // WINDOW))
    x = np.frombuffer(b"".join(t.ljust(c * WINDOW, b"\0") for t, c in zip(raw, count.tolist(), strict=True)), np.uint8).reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(raw)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return x, np.maximum(np.minimum(size[owner] - nth * WINDOW, WINDOW), 1).astype(np.float32), owner


def train(labelled: DataFrame, per_label: int = 500, epochs: int = 12) -> Network | None:
    """A network fit on a bounded sample of (doc_id, text, lang) rows: of each language, two windows from `per_label` documents at
    most, those of the least hashes of doc_id. None if no row has a language and a text.

    A first count by language gives the hash below which four times as many are expected, so that what is ranked is bounded too,
    however many rows a language has.
    """
    h = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(2**40))
    at = lambda salt: F.expr(f"substring(text, cast(1 + pmod(xxhash64(doc_id, '{salt}'), greatest(length(text) - {WINDOW}, 1)) as int), {WINDOW})")
    rows = labelled.where("lang is not null and text rlike '\\\\S'")
    most = written(rows.groupBy(F.col("lang").alias("__lang")).agg((F.lit(4.0 * per_label * 2**40) / F.count(F.lit(1))).alias("most")))
    rows = rows.join(bounded(most), (F.col("lang") == F.col("__lang")) & (h <= F.col("most"))).select("lang", h.alias("h"), at("a").alias("a"), at("b").alias("b"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "a"))).where(F.col("n") <= per_label)
    got = sorted((r.lang, r.h, x) for r in rows.collect() for x in (r.a, r.b))
    if not got:
        return None
    labels = sorted({r[0] for r in got})
    x, _, owner = windows([r[2].encode().lower()[:WINDOW] for r in got])
    return Network(labels).fit(x, np.array([labels.index(r[0]) for r in got])[owner], epochs)


def languages(docs: DataFrame, network: Network | None):
    """Column struct<lang_pred, score> for column text of docs."""
    if network is None:
        return F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    model = docs.sparkSession.sparkContext.broadcast(network)  # filters and labels: under 1 MB

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            got = model.value.predict(batch.to_pylist())
            yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return F.when(letters, predict(F.col("text"))).otherwise(F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score")))


def held_out():
    """Whether crc32 of doc_id as text is divisible by 5 (false for a null doc_id, which is not learned from either)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, per_label: int = 500, epochs: int = 12) -> DataFrame:
    """(doc_id, text, lang, ...) -> (doc_id, held_out, lang_pred, score), a row per row of docs.

    Learns from text and lang of rows that are not held out and whose doc_id and lang are not null. Predicts from the whole text;
    `und` with score 0 for texts that are null or without letters, and for all if there is nothing to learn from. Repeated rows
    each keep their row; an empty table gives an empty result; other columns of docs are not used.
    """
    network = train(docs.where("doc_id is not null").where(~held_out()).select("doc_id", "text", "lang"), per_label, epochs)
    rows = docs.select("doc_id", held_out().alias("held_out"), languages(docs, network).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")
