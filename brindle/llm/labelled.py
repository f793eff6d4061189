"""A bounded, reproducible sample of labelled documents, for models that are fitted here."""

from __future__ import annotations

import ctypes
import gc
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: str, folds: int) -> Column:
    """crc32 of the id as text, mod `folds`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


def _picked(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, most_chars: int) -> tuple[DataFrame, dict[int, int]]:
    """The sample (id, y, text), and how many labels of each class may be learned from."""
    known = labels.where(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max(label).cast("int").alias("y"))
    totals = {int(r.y): r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    picked = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.where(F.length("text") <= most_chars).join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text")), totals


def _weighted(found: pd.DataFrame, totals: dict[int, int]) -> pd.DataFrame:
    found = found.sort_values("id").reset_index(drop=True)
    have = found["y"].value_counts()
    share = {y: (totals[y] / sum(totals.values())) / (n / len(found)) for y, n in have.items()}
    return found.assign(weight=found["y"].map(share).astype(float))


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, most_chars: int) -> pd.DataFrame:
    """Up to `per_class` documents of each class with text, y and weight.

    The ids come from `labels` alone, by a hash; so at most 2 * per_class rows are
    broadcast and come back, of texts of at most `most_chars` characters (longer ones are
    left out of the sample, never cut). weight gives a class the share it has among all
    labels that may be learned from. Null labels and ids are left out; of several labels
    of one id the largest holds, of several rows of one id the least text.
    """
    found, totals = _picked(docs, labels, label, learn, per_class, most_chars)
    return _weighted(found.toPandas(), totals)


def fitted(fit: Callable[[list[str], np.ndarray, np.ndarray], Any], docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, most_chars: int) -> Any:
    """What `fit` makes of the texts, labels and weights of `sample`, in one task of an executor.

    The sample is bounded, so the task is; the driver gets the model only, no text and
    nothing of what a fit needs in between.
    """
    found, totals = _picked(docs, labels, label, learn, per_class, most_chars)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(batches)
        if rows:
            rows = _weighted(pd.concat(rows), totals)
            texts, y, weight = rows["text"].tolist(), rows["y"].to_numpy(), rows["weight"].to_numpy()
            del rows
            model = pickle.dumps(fit(texts, y, weight))
            del texts
            give_back()
            yield pd.DataFrame({"model": [model]})

    made = found.repartition(1).mapInPandas(run, "model binary").collect()  # one row, or none of an empty sample
    return pickle.loads(made[0].model) if made else fit([], np.empty(0, np.int64), np.empty(0))


def give_back() -> None:
    """Returns what a fit has freed to the system, where the C library can; else a process that fits again and again grows."""
    gc.collect()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
