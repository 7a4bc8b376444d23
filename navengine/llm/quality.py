"""Quality classifier: naive Bayes support vectors.

N-gram indicators are scaled by the log-count ratio of the two classes, brought to
unit length, and a linear hinge-loss model is fitted to them by dual
coordinate descent. A logistic curve, fitted on rows that the model has
not seen, turns margins into scores from 0 to 1.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .folds import held_out, sample_per_class

_TOKEN = re.compile(r"\w+|[^\w\s]+")
SAME, OTHER = ("=", "=", "="), ("=", "_", "=")  # of three parts, so that no pair of tokens equals them
SMOOTH = 2.0  # added to the squared length, so that a few weak n-grams do not decide a short text


def features(text: str | None) -> set:
    """Distinct lower-cased tokens (words and runs of punctuation), pairs of neighbours, and marks of repetition.

    A mark is an n-gram of back references: three equal tokens in a row, or in every other place.
    """
    t = _TOKEN.findall((text or "").lower())
    pairs = set(zip(t, t[1:], strict=False))
    if any(a == b for a, b in pairs) and any(a == b == c for a, b, c in zip(t, t[1:], t[2:], strict=False)):
        pairs.add(SAME)
    if any(a == b == c and a != d for a, d, b, c in zip(t, t[1:], t[2:], t[4:], strict=False)):
        pairs.add(OTHER)
    return pairs.union(t)


@dataclass
class QualityModel:
    """weights: log-count ratio of each known n-gram, and its ratio times the fitted weight."""

    ratio: dict
    weight: dict
    bias: float
    slope: float
    shift: float

    def margin(self, text: str | None) -> float:
        found = features(text)
        ratio, weight = self.ratio, self.weight
        hit = [f for f in found if f in ratio]
        norm = math.sqrt(SMOOTH + sum(ratio[f] ** 2 for f in hit))
        return self.bias + sum(weight[f] for f in hit) / norm

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(text) + self.shift
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, dim: int, cost: np.ndarray, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of the L1-loss support vector machine with a cost for each row."""
    w, alpha = np.zeros(dim + 1), np.zeros(len(rows))
    square = np.array([v @ v + 1.0 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            g = y[i] * (values[i] @ w[rows[i]] + w[-1]) - 1.0
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                w[-1] += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w


def logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that fit smoothed targets best (Newton steps)."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -50, 50)))
        s = p * (1 - p) + 1e-9
        g = np.array([((p - goal) * margins).sum() + 1e-3 * (a - 1), (p - goal).sum()])
        h = np.array([[(s * margins**2).sum() + 1e-3, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if abs(d).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows_per_class: int = 3000, least_rows: int = 3, alpha: float = 1.0, cost: float = 1.0, docs: DataFrame | None = None) -> QualityModel:
    """Fit on about ``rows_per_class`` rows of each class: rows of ``labelled``, or of ``docs`` with each label that ``labelled`` has for their id.

    With ``docs``, only ids are joined with all labels; texts meet the sampled labels, which are broadcast. N-grams of fewer than ``least_rows`` sampled rows are left out. The sample bounds what is collected and broadcast. Null labels are
    left out; with rows of one class only (or none), every text gets that class's share (or 0.5).
    """
    known = F.col(label_col).cast("int").alias("y")
    if docs is None:
        rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), known).where("y in (0, 1)")
    else:
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        labels = labelled.select(F.col(id_col).alias("id"), known).where("y in (0, 1)")
        rows = texts.select("id").join(labels, "id")
    whole = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = sample_per_class(rows, "y", "id", rows_per_class)
    if docs is not None:
        drawn = labels.join(F.broadcast(sample.distinct()), ["id", "y"], "left_semi")
        sample = texts.join(F.broadcast(drawn), "id")
    sample = sample.select("id", "text", "y").cache()
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return QualityModel({}, {}, 0.0, 1.0, math.log((n.get(1, 0) + 1) / (n.get(0, 0) + 1)))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict = {}
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for f in features(t):
                    seen.setdefault(f, [0, 0])[y] += 1
            keys = ["\t".join(f) if isinstance(f, tuple) else f for f in seen]
            k = np.array(list(seen.values()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(k[:, 0]), pa.array(k[:, 1])], names=["f", "k0", "k1"])

    df = sample.select("text", "y").mapInArrow(grams, "f string, k0 bigint, k1 bigint").groupBy("f").agg(F.sum("k0").alias("k0"), F.sum("k1").alias("k1"))
    vocab = df.where(F.col("k0") + F.col("k1") >= least_rows).orderBy("f").toArrow().to_pandas()
    key = [tuple(f.split("\t")) if "\t" in f else f for f in vocab["f"]]
    p, q = vocab["k1"].to_numpy() + alpha, vocab["k0"].to_numpy() + alpha
    r = np.log((p / p.sum()) / (q / q.sum())) if len(key) else np.zeros(0)
    place = {f: i for i, f in enumerate(key)}
    shared = sample.sparkSession.sparkContext.broadcast(place)

    @F.pandas_udf("array<int>")
    def vector(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([sorted(shared.value[f] for f in features(t) if f in shared.value) for t in batch])

    got = sample.select("id", "y", vector("text").alias("x")).toArrow().to_pandas().sort_values("id")
    sample.unpersist()
    x = [np.asarray(v, np.int64) for v in got["x"]]
    v = [r[i] / math.sqrt(SMOOTH + r[i] @ r[i]) for i in x]
    y = np.where(got["y"].to_numpy() == 1, 1.0, -1.0)
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    fold = np.arange(len(y)) % 4 == 3
    fit = [np.flatnonzero(~fold), np.arange(len(y))]
    w = dual_coordinate_descent([x[i] for i in fit[0]], [v[i] for i in fit[0]], y[fit[0]], len(r), (cost / (2 * share))[fit[0]])
    margins = np.array([v[i] @ w[x[i]] + w[-1] for i in np.flatnonzero(fold)])
    slope, shift = logistic(margins, y[fold])
    # The curve is fitted to the model of three quarters of the rows, on the other quarter; the model
    # that scores is then fitted on all rows with the same curve. The shift goes from the sample's shares to those of all labels.
    shift += math.log((whole[1] / whole[0]) / (n[1] / n[0]))
    w = dual_coordinate_descent(x, v, y, len(r), cost / (2 * share))
    return QualityModel(dict(zip(key, r.tolist(), strict=True)), dict(zip(key, (r * w[:-1]).tolist(), strict=True)), float(w[-1]), slope, shift)


def classify(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with score (0 to 1, higher: class 1 likelier) and predicted (1 from ``threshold`` on).

    Null and empty texts have no n-grams and get the model's bias as a score.
    Whole texts are read; all rows and columns stay (a former score or predicted is replaced).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for batch in texts:
            yield pd.Series([model.score(t) for t in batch], dtype="float64")

    out = docs.withColumn("__nav_score", scored(F.col(text_col).cast("string"))).drop("score", "predicted")
    return out.withColumns({"score": F.col("__nav_score"), "predicted": (F.col("__nav_score") >= threshold).cast("int")}).drop("__nav_score")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = train(labels, docs=docs.where(~held_out()))
    return classify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")
