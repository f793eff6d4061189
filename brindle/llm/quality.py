"""Quality classifier: a naive-Bayes support vector machine (Wang & Manning, 2012).

Features are indicators of n-grams in a document: words, pairs of words, and runs of
three token shapes (lower, Upper, UPPER, number, mark, and "same" for a token that
repeats the one before), the last with how often they come, by powers of two of their
share. Each is scaled by its log-count ratio between the classes, and a linear
hinge-loss model is fitted on the scaled indicators by dual coordinate descent (Hsieh
et al., 2008). Margins become probabilities by a logistic fitted on a part of the
sample that the margins weren't (Platt).

The model is fitted on at most 2 * PER_CLASS labelled documents of at most MOST_CHARS
characters each; scoring reads every whole text.

Nulls: a null text counts as empty; an empty text has no feature and scores what the
bias says. Without labels of both classes every text scores the labels' mean, or 0.5.
Repeated rows score alike. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.labelled import fitted, fold

PER_CLASS = 4000
MOST_CHARS = 20_000
MOST_FEATURES = 1 << 18
LEAST_DOCS = 3
C = 1.0
PASSES = 12
ALPHA = 1.0
#: Tokens whose shape a worker remembers before it starts anew.
MEMORY = 200_000
TOKEN = re.compile(r"\w+|[^\w\s]+")
FOLDS, HELD = 3, 1


def shape(token: str) -> str:
    if token[0].isdigit():
        return "9"
    if not (token[0].isalnum() or token[0] == "_"):
        return token[:3]
    if token.isupper() and len(token) > 1:
        return "A"
    return "Aa" if token[0].isupper() else "a"


_shapes: dict[str, str] = {}


def features(text: str) -> set:
    """The n-gram indicators of a whole text."""
    tokens = TOKEN.findall(text)
    if not tokens:
        return set()
    if len(_shapes) > MEMORY:
        _shapes.clear()
    shapes = []
    last = None
    for t in tokens:
        s = _shapes.get(t)
        if s is None:
            s = _shapes[t] = shape(t)
        shapes.append("=" if t == last else s)
        last = t
    found: set = set(tokens)
    found.update(zip(tokens, tokens[1:], strict=False))
    n = len(tokens)
    for run, k in Counter(zip(shapes, shapes[1:], shapes[2:], strict=False)).items():
        found.add(run)
        found.add((*run, int(math.log2(k / n))))
    return found


class Model:
    """Weights by n-gram (at most MOST_FEATURES) and the logistic of the margin."""

    def __init__(self, weights: dict, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def score(self, text: str) -> float:
        get = self.weights.get
        z = self.slope * (self.bias + sum(filter(None, map(get, features(text))))) + self.shift
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def hinge_by_dual(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: np.ndarray, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights on scaled indicators and a bias: dual coordinate descent for the L1-loss SVM.

    rows: the features of each document; y: +1 or -1; cost: the upper bound of each dual
    variable. The bias is a feature that is always 1.
    """
    w, bias = np.zeros(len(scale)), 0.0
    dual = np.zeros(len(rows))
    values = [scale[r] for r in rows]
    norm = np.array([v @ v + 1 for v in values])
    rng = np.random.default_rng(0)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            grad = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(dual[i] - grad / norm[i], 0.0), cost[i])
            if step := (new - dual[i]) * y[i]:
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
                dual[i] = new
        if moved < 1e-4:
            break
    return w, bias


def logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, with Platt's smoothed targets."""
    up, down = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    x = np.stack([margin, np.ones_like(margin)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        g = x @ (weight * (p - t)) + np.array([1e-3 * (a - 1), 0])
        h = (x * (weight * p * (1 - p))) @ x.T + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(h, g)
        step *= min(1, 2 / np.abs(step).max()) if np.abs(step).max() > 0 else 1
        a, b = a - step[0], b - step[1]
    return max(a, 1e-3), b


def common_features(texts: list[str]) -> dict:
    """The features of at least LEAST_DOCS texts, the commonest if they are too many, numbered.

    Their hashes are counted first, so only features that are kept are held as objects.
    """
    hashes = np.concatenate([np.fromiter(map(hash, f), np.int64, len(f)) for f in map(features, texts)])
    hashes, docs_with = np.unique(hashes, return_counts=True)
    hashes, docs_with = hashes[docs_with >= LEAST_DOCS], docs_with[docs_with >= LEAST_DOCS]
    if len(hashes) > MOST_FEATURES:
        at_most = np.sort(docs_with)[-MOST_FEATURES]
        hashes = hashes[docs_with > at_most]  # ties at the border all go, whatever the order
    wanted, number = set(hashes.tolist()), {}
    for t in texts:
        for f in sorted((f for f in features(t) if hash(f) in wanted), key=str):
            number.setdefault(f, len(number))
    return number


def fit(texts: list[str], y: np.ndarray, weight: np.ndarray) -> Model:
    if len(set(y.tolist())) < 2:
        mean = float(np.mean(y)) if len(y) else 0.5
        odds = min(max(mean, 1e-6), 1 - 1e-6)
        return Model({}, 0.0, 1.0, math.log(odds / (1 - odds)))
    number = common_features(texts)
    rows = [np.array(sorted(number[f] for f in features(t) if f in number), np.int32) for t in texts]
    names = list(number)
    sign = np.where(y == 1, 1.0, -1.0)

    def trained(part: np.ndarray) -> tuple[np.ndarray, float]:
        count = {c: np.bincount(np.concatenate([rows[i] for i in part if y[i] == c] or [np.empty(0, np.int32)]), minlength=len(names)) + ALPHA for c in (0, 1)}
        ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
        w, bias = hinge_by_dual([rows[i] for i in part], ratio, sign[part], C * weight[part])
        return w * ratio, bias

    every = np.arange(len(texts))
    margin = np.zeros(len(texts))
    for third in range(3):  # margins from documents that the model hasn't seen
        w, bias = trained(every[every % 3 != third]) if len(set(y[every % 3 != third].tolist())) == 2 else (np.zeros(len(names)), 0.0)
        for i in every[every % 3 == third]:
            margin[i] = w[rows[i]].sum() + bias
    slope, shift = logistic(margin, y, weight)
    w, bias = trained(every)
    return Model({n: float(x) for n, x in zip(names, w, strict=True) if x}, bias, slope, shift)


def fit_tables(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality") -> Model:
    """The model from a bounded sample of the labels for which `learn` holds."""
    return fitted(fit, docs, labels, label, learn, PER_CLASS, MOST_CHARS)


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score and predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.select(F.col(key).alias("key")).dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value
        for batch in batches:
            score = np.array([of.score(t.as_py() or "") for t in batch.column(1)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["key", "score", "predicted"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, score double, predicted int").withColumnRenamed("key", key)


def judged(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, all columns, with score and predicted beside them; nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield some.map(lambda t: sent.value.score(t)).astype(float)

    score = F.pandas_udf(run, "double")(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.withColumn("score", score).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits outside the held-out fold and scores every document."""
    model = fit_tables(docs, labels, fold("doc_id", FOLDS) != HELD)
    return scored(docs, model).select("doc_id", (fold("doc_id", FOLDS) == HELD).alias("held_out"), "score", "predicted")
