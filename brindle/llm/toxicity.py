"""Toxicity by multiple-instance learning: sentences scored, documents labelled.

A sentence's probability is the logistic of a bias and the weights of its distinct words;
a word's weight is that of the word itself and of its first 3 to 7 letters, so that
inflected forms share what was learned. A document's probability is the noisy-or of its
sentences, 1 - prod(1 - p), in which of the sentences below FLOOR only the likeliest counts,
else a text of some thousand clean sentences would be toxic by its length alone. The weights
maximise the likelihood of the document labels through the noisy-or of all sentences; no
sentence is ever labelled. Scoring then gives the document's
probability and the sentences that are toxic by themselves.

The model is fitted on at most 2 * PER_CLASS labelled documents of at most MOST_CHARS
characters each; scoring reads every whole text.

Nulls: a null or empty text has no sentence and scores 0. Without labels of both classes
every text scores 0. Repeated rows score alike. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from array import array
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
MOST_FEATURES = 1 << 16
LEAST_DOCS = 3
#: Likelihood-ratio statistic of a word's part and the label, from which the part is learned.
LEAST_G = 18.0
STEPS = 200
RATE = 0.05
L2 = 1e-6
START, START_BIAS = 1.6, 7.0
#: Words remembered by a worker before its memory of them starts anew.
MEMORY = 300_000
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
FOLDS = 5
#: Probability of a sentence below which it does not add up with others.
FLOOR = 0.01
_FLOOR = math.log(FLOOR / (1 - FLOOR))


def parts(word: str) -> list[str]:
    """The features of a word: itself and its beginnings."""
    return [word, *(f"{word[:n]}~" for n in (3, 4, 5, 6, 7) if len(word) > n)]


def sentences(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in SENTENCE.finditer(text) if not m.group().isspace()]


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


class NoisyOr:
    """The fitted weights; small enough to send to every worker (at most MOST_FEATURES)."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.seen = weights, bias, {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "seen": {}}

    def word(self, w: str) -> float:
        found = self.seen.get(w)
        if found is None:
            if len(self.seen) >= MEMORY:
                self.seen.clear()
            get = self.weights.get
            found = self.seen[w] = sum(get(p, 0.0) for p in parts(w))
        return found

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability, and (start, end, probability) of each toxic sentence."""
        kept, faint, found, word = 0.0, -math.inf, [], self.word  # kept: log of the probability that no sentence is toxic
        for m in SENTENCE.finditer(text):
            words = set(WORD.findall(m.group().lower()))
            if not words:
                continue
            s = self.bias + sum(map(word, words))
            if s < _FLOOR:
                faint = max(faint, s)
                continue
            kept -= math.log1p(math.exp(s)) if s < 30 else s
            if s >= 0:
                found.append((*m.span(), 1 / (1 + math.exp(-s))))
        return -math.expm1(kept - math.log1p(math.exp(faint))), found


def fit(texts: list[str], y: np.ndarray, weight: np.ndarray) -> NoisyOr:
    """Gradient descent (Adam) on the noisy-or likelihood of the document labels."""
    if len(set(y.tolist())) < 2:
        return NoisyOr({}, -50.0)
    words: dict[str, int] = {}
    owner, nnz_word, nnz_sentence = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        for m in SENTENCE.finditer(text):
            if own := set(WORD.findall(m.group().lower())):
                nnz_word.extend(words.setdefault(w, len(words)) for w in sorted(own))
                nnz_sentence.extend([len(owner)] * len(own))
                owner.append(d)
    owner, nnz_word, nnz_sentence = (np.frombuffer(x, np.int32) if len(x) else np.empty(0, np.int32) for x in (owner, nnz_word, nnz_sentence))
    # What documents have each part of a word, by label; parts that tell the labels apart are learned.
    listed = list(words)
    pairs = np.divmod(np.unique(owner[nnz_sentence].astype(np.int64) * max(1, len(words)) + nnz_word), max(1, len(words)))
    toxic = y[pairs[0]] == 1
    with_part: tuple[Counter, Counter] = Counter(), Counter()
    for of_label, at in zip(with_part, (pairs[1][~toxic], pairs[1][toxic]), strict=True):
        for w, n in zip(*np.unique(at, return_counts=True), strict=True):
            for p in parts(listed[w]):
                of_label[p] += int(n)
    del pairs
    mean, n_toxic = float((y == 1).mean()), int((y == 1).sum())
    chosen = []
    for p, a in with_part[1].items():
        b = with_part[0][p]
        n = a + b
        g = 2 * (a * math.log(a / (n * mean)) + (b * math.log(b / (n * (1 - mean))) if b else 0))
        if a > n * mean and n >= LEAST_DOCS and g >= LEAST_G:
            odds = math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (len(y) - n_toxic + 1))
            chosen.append((-g, p, odds))
    chosen = sorted(chosen)[:MOST_FEATURES]
    number, odds = {p: i for i, (_, p, _) in enumerate(chosen)}, np.array([o for *_, o in chosen])
    names = list(number)
    del with_part, chosen
    part_of, part = array("q"), array("q")
    for w, word in enumerate(listed):
        own = [number[p] for p in parts(word) if p in number]
        part.extend(own)
        part_of.extend([w] * len(own))
    part_of, part = np.array(part_of, np.int64), np.array(part, np.int64)
    n_words, n_docs, n_features = len(words), len(texts), len(names)
    # A word starts with the mean log odds of its parts and no word alone is near the bias.
    per_word = np.bincount(part_of, minlength=n_words)
    shared = np.bincount(part, 1 / per_word[part_of], minlength=n_features) / np.maximum(np.bincount(part, minlength=n_features), 1)
    w = np.append(odds * shared * START, -START_BIAS)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        of_word = np.bincount(part_of, w[part], minlength=n_words)
        s = w[-1] + np.bincount(nnz_sentence, of_word[nnz_word], minlength=len(owner))
        none = np.minimum(-np.bincount(owner, _softplus(s), minlength=n_docs), -1e-12)  # log(1 - P)
        p = -np.expm1(none)
        pull = np.where(y == 1, -np.exp(none) / np.maximum(p, 1e-12), 1.0) * weight
        g = (1 / (1 + np.exp(-s))) * pull[owner]
        on_word = np.bincount(nnz_word, g[nnz_sentence], minlength=n_words)
        grad = np.append(np.bincount(part, on_word[part_of], minlength=n_features), g.sum()) / n_docs
        grad[:-1] += L2 * w[:-1]
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        w -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return NoisyOr({n: float(x) for n, x in zip(names, w, strict=False) if abs(x) > 1e-3}, float(w[-1]))


def fit_tables(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic") -> NoisyOr:
    """The model from a bounded sample of the labels for which `learn` holds."""
    return fitted(fit, docs, labels, label, learn, PER_CLASS, MOST_CHARS)


def scored(docs: DataFrame, model: NoisyOr, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, predicted and offending (start, end, score of each toxic sentence) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.select(F.col(key).alias("key")).dtypes)["key"]
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value
        for batch in batches:
            found = [of.score(t.as_py() or "") for t in batch.column(1)]
            score = np.array([s for s, _ in found], np.float64)
            bad = pa.array([[{"start": a, "end": b, "score": p} for a, b, p in x] for _, x in found], spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), bad], names=["key", "score", "predicted", "offending"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, score double, predicted int, offending array<struct<start: int, end: int, score: double>>").withColumnRenamed("key", key)


def judged(docs: DataFrame, model: NoisyOr) -> DataFrame:
    """The rows of `docs`, all columns, with score and predicted beside them; nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield some.map(lambda t: sent.value.score(t)[0]).astype(float)

    score = F.pandas_udf(run, "double")(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.withColumn("score", score).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits outside the held-out fold and scores every document."""
    model = fit_tables(docs, labels, fold("doc_id", FOLDS) != 0)
    out = scored(docs, model)
    return out.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"), F.try_element_at("offending", F.lit(1))["start"].alias("first_start"))
