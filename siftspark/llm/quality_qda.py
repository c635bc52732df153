"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each class is a Gaussian over transformed statistics of the whole text. A class
covariance is shrunk towards the pooled one and towards a multiple of the identity, then
factored once (Cholesky). A text's score is the difference of the classes' log densities,
from Mahalanobis distances by triangular solves against the cached factors, calibrated to
a probability on the learning rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.llm.common import cut

_KEEP = {name: bytes(set(range(256)) - set(keep)) for name, keep in {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "symbol": b"#*$%&<>=+~^@\\", "bar": b"|", "stop": b".,;:", "shout": b"!?", "quote": b"'\"()[]{}", "wide": range(0xC0, 0x100)}.items()}
FEATURES = ("words", "word_length", "upper", "digit", "symbol", "bar", "stop", "shout", "quote", "wide", "distinct", "top", "adjacent", "lines", "repeated_lines", "ended_lines")


def statistics(data: bytes) -> list[float]:
    """The transformed statistics of one whole text: logarithms of sizes, square roots of shares; no words: all sizes and shares 0."""
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    count = {name: len(data.translate(None, drop)) for name, drop in _KEEP.items()}
    letters = count["upper"] + count["lower"] + count["wide"]
    size = sum(map(len, words))
    found = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    ended = sum(x.rstrip()[-1:] in b".!?:;\"'" for x in lines)
    shares = [count["upper"] / max(1, letters), count["digit"] / size, count["symbol"] / size, count["bar"] / n, count["stop"] / n, count["shout"] / n, count["quote"] / n, count["wide"] / max(1, letters)]
    return [
        float(np.log1p(n)), float(np.log1p(size / n)), *(x**0.5 for x in shares),
        float(np.log(len(found)) / np.log(n)) if n > 1 else 1.0, (max(found.values()) / n) ** 0.5, (sum(map(eq, words, words[1:])) / n) ** 0.5,
        float(np.log1p(n / len(lines))), (1 - len(set(lines)) / len(lines)) ** 0.5, (ended / len(lines)) ** 0.5,
    ]


@dataclass
class Model:
    """Means, Cholesky factors and log determinants of both classes over standardised statistics, and the calibration."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    prior: float
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Difference of log densities (label 1 less label 0), compressed by arcsinh since Gaussian tails overstate it."""
        z = (x - self.centre) / self.scale
        density = []
        for mean, factor in zip(self.means, self.factors, strict=True):
            solved = np.linalg.solve(factor, (z - mean).T)
            density.append(-0.5 * (solved**2).sum(axis=0) - np.log(np.diag(factor)).sum())
        return np.arcsinh(density[1] - density[0])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -700, 700)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and label: count, sums and sums of products, flat."""
    d = len(FEATURES)
    totals = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
    for batch in batches:
        if not batch.num_rows:
            continue
        labels = np.asarray(batch.column(0).to_pylist())
        x = np.asarray(batch.column(1).to_pylist(), float)
        for k, total in totals.items():
            own = x[labels == k]
            total += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([t.tolist() for t in totals.values()], pa.list_(pa.float64()))], names=["label", "total"])


BINS, SPAN = 4000, 20.0


def _binned(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.clip((model.margin(np.asarray(batch.column(1).to_pylist(), float)) + SPAN) / (2 * SPAN) * BINS, 0, BINS - 1).astype(int)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32())], names=["label", "bin"])

    return run


def _calibrate(margin: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's method on counts, with targets kept off 0 and 1 (Platt)."""
    n0, n1 = zeros.sum(), ones.sum()
    target = (ones * (n1 + 1) / (n1 + 2) + zeros / (n0 + 2)) / np.maximum(zeros + ones, 1)
    weight, beta = zeros + ones, np.array([1.0, np.log((n1 + 1) / (n0 + 1))])
    design = np.stack([margin, np.ones_like(margin)])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(beta @ design, -500, 500)))
        gradient = design @ (weight * (p - target))
        hessian = (design * (weight * np.maximum(p * (1 - p), 1e-9))) @ design.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta - np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    return max(float(beta[0]), 1e-6), float(beta[1])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(x.as_py() or b"") for x in batch.column(1)], pa.list_(pa.float64()))], names=["id", "x"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", to_pooled: float = 0.1, to_identity: float = 0.02) -> Model:
    """Learns from the rows of docs that labels has with 0 or 1; other labels and null ids are left out.

    Moments are summed in the tasks: what reaches the driver is two vectors, whatever the
    input. With one class or none the score is a constant: the share of label 1, else 0.5.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).where("id is not null").mapInArrow(_features, f"id {kind}, x array<double>")
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    rows = cut(found.join(marked, found["id"] == marked["_id"]).select("label", "x"))
    d = len(FEATURES)
    summed = rows.mapInArrow(_moments, "label int, total array<double>").select("label", F.posexplode("total").alias("at", "v")).groupBy("label", "at").agg(F.sum("v").alias("v")).collect()
    totals = np.zeros((2, 1 + d + d * d))
    for r in summed:
        totals[r["label"], r["at"]] = r["v"]
    n = totals[:, 0]
    empty = Model(np.zeros(d), np.ones(d), [], [], 0.5)
    if not n.all():
        empty.constant = float(n[1] / n.sum()) if n.sum() else 0.5
        return empty
    means, seconds = totals[:, 1 : 1 + d] / n[:, None], totals[:, 1 + d :].reshape(2, d, d)
    within = [seconds[k] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (n[0] * within[0] + n[1] * within[1]) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    centre = means.mean(axis=0)
    shrink = lambda s: (1 - to_identity) * s + to_identity * max(np.trace(s) / d, 1e-3) * np.eye(d)
    factors = [np.linalg.cholesky(shrink(((1 - to_pooled) * w + to_pooled * pooled) / np.outer(scale, scale))) for w in within]
    model = Model(centre, scale, [(m - centre) / scale for m in means], factors, float(n[1] / n.sum()))
    counts = np.zeros((2, BINS))
    for r in rows.mapInArrow(_binned(model), "label int, bin int").groupBy("label", "bin").count().collect():
        counts[r["label"], r["bin"]] = r["count"]
    model.slope, model.offset = _calibrate((np.arange(BINS) + 0.5) / BINS * 2 * SPAN - SPAN, counts[0], counts[1])
    return model


def scores(text: Column, model: Model) -> Column:
    """The score (0 to 1, higher: label 1 likelier) of each whole text; null and empty texts have one too."""

    @F.pandas_udf("double")
    def scored(batch: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(bytes(x) if x is not None else b"") for x in batch], float).reshape(len(batch), -1)))

    return scored(text.cast("binary"))
