import math
import random
import re
import zlib

import numpy as np
import pytest
from brindle.llm import quality as Q
from brindle.llm import toxicity as T
from brindle.llm.labelled import fold, sample
from brindle.sources.tables import table
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def held_out(found, labels, name):
    rows = found.where("held_out").join(labels, "doc_id").select("predicted", name).collect()
    y, p = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    return (p == y).mean(), (p[y == 1] == 1).mean(), (p[y == 0] == 0).mean()


def test_toxicity_held_out(spark):
    labels = table(spark, SF, "labels")
    found = T.toxicity(table(spark, SF, "documents"), labels).cache()
    right, toxic, clean = held_out(found, labels, "toxic")
    assert right > 0.97 and toxic > 0.85 and clean > 0.98
    assert found.where("score < 0 or score > 1 or score is null").count() == 0
    wrong = found.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0))
    assert found.count() == 10_000 and wrong.count() == 0


def test_quality_held_out(spark):
    labels = table(spark, SF, "labels")
    right, good, bad = held_out(Q.quality(table(spark, SF, "documents"), labels), labels, "quality")
    assert right > 0.98 and good > 0.98 and bad > 0.95


def toy(n=400):
    rng = random.Random(1)
    words = [a + b for a in "bdfgklmnpr" for b in ("ala", "eru", "ino", "osa")]
    rows = []
    for i in range(n):
        sentences = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(5)]
        if toxic := i % 4 == 0:
            sentences[i % 5] += " vilewo" + rng.choice("abcdef")
        rows.append((i, ". ".join(sentences), int(toxic)))
    return rows


def test_sentences_are_located_and_one_is_enough():
    rows = toy()
    model = T.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]), np.ones(len(rows)))
    for _, t, y in toy(40):
        score, spans = model.score(t)
        assert (score >= 0.5) == (y == 1)
        assert [("vilewo" in t[a:b]) for a, b, _ in spans] == [True] * y
    unseen = model.score("bala eru. this has vilewox in it. dala")
    assert unseen[0] > 0.5 and "vilewox" in "bala eru. this has vilewox in it. dala"[slice(*unseen[1][0][:2])]
    assert model.score("") == (0.0, [])


def test_scores_against_plain_recomputation():
    rows = toy()
    model = T.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]), np.ones(len(rows)))
    for t in [*(t for _, t, _ in rows), "", "!!!", "Vilewoa VILEWOB. vilewoc! bala\n\nbala", "bala " * 5000]:
        each = []
        for sentence in re.split(r"[.!?\n]", t):
            words = set(re.findall(r"\w+", sentence.lower()))
            logit = model.bias + sum(model.weights.get(x, 0) for w in words for x in [w, *(f"{w[:n]}~" for n in range(3, 8) if len(w) > n)])
            if words:
                each.append(1 / (1 + math.exp(-logit)))
        none = math.prod(1 - p for p in each if p >= 0.01) * (1 - max([p for p in each if p < 0.01], default=0))
        assert abs(model.score(t)[0] - (1 - none)) < 1e-9
    model = Q.fit([t.upper() if y else t for _, t, y in rows], np.array([1 - y for *_, y in rows]), np.ones(len(rows)))
    for t in [*(t for _, t, _ in rows[:100]), "", "??", "A a a a 9 9 x_ BALA"]:
        tokens = re.findall(r"\w+|[^\w\s]+", t)
        grams = {*tokens, *((a, b) for a, b in zip(tokens, tokens[1:]))}  # noqa: B905
        shapes = ["=" if i and x == tokens[i - 1] else Q.shape(x) for i, x in enumerate(tokens)]
        runs = [tuple(shapes[i : i + 3]) for i in range(len(tokens) - 2)]
        grams |= {*runs, *((*r, int(math.log2(runs.count(r) / len(tokens)))) for r in runs)}
        z = model.slope * (model.bias + sum(model.weights.get(g, 0) for g in grams)) + model.shift
        assert abs(model.score(t) - 1 / (1 + math.exp(-z))) < 1e-9


def test_long_clean_texts_stay(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = T.fit_tables(docs, labels, fold("doc_id", 5) != 0)
    held = docs.join(labels.where("toxic = 0"), "doc_id").where((fold("doc_id", 5) == 0) & (F.col("lang") == "en")).orderBy("doc_id").select("text").limit(400).collect()
    clean = [r.text for r in held if r.text and model.score(r.text)[0] < 0.02]
    long = "\n".join(clean * (1 + 20_000 // sum(len(T.sentences(t)) for t in clean)))
    assert len(clean) > 350 and len(T.sentences(long)) > 20_000 and model.score(long)[0] < 0.5
    rows = docs.where(F.length("text") > T.MOST_CHARS).join(labels, "doc_id").select("text", "toxic").collect()  # none was learned from
    right = [(model.score(r.text)[0] >= 0.5) == (r.toxic == 1) for r in rows]
    assert len(right) > 10 and np.mean(right) > 0.8  # 15 of 17


def test_dual_coordinate_descent_against_subgradients():
    rng = np.random.default_rng(2)
    rows = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(60)]
    y = np.where([len(r) > 0 and (3 in r) ^ (rng.random() < 0.1) for r in rows], 1.0, -1.0)
    scale, cost = rng.uniform(0.5, 2, 12), np.full(60, 0.7)
    w, b = Q.hinge_by_dual(rows, scale, y, cost, passes=400)

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + sum(0.7 * max(0, 1 - t * (w[r] @ scale[r] + b)) for r, t in zip(rows, y, strict=True))

    at = loss(w, b)
    for _ in range(300):
        assert at <= loss(w + rng.normal(0, 0.02, 12), b + rng.normal(0, 0.02)) + 1e-3


@pytest.mark.parametrize("module, name, label", [(T, "toxicity", "toxic"), (Q, "quality", "quality")])
def test_odd_tables(spark, documents, module, name, label):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(1, None), (2, ""), (2, ""), (None, "é" * 60_000), (3, "!!! ???")]
    run = getattr(module, name)
    found = run(documents(rows), none).collect()
    assert len(found) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert run(documents([]), none).count() == 0
    texts = [(i, t) for i, t, _ in toy(120)]
    marks = [(i, 1 - y, y) for i, _, y in toy(120)] + [(None, 1, 1), (5, None, None), (7777, 0, 1)]
    found = run(documents([*texts, *rows]), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    assert len(found) == 125 and all(r.score is not None for r in found)
    folds = 5 if name == "toxicity" else 3
    for r in found:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % folds == (0 if name == "toxicity" else 1))


def test_sample_is_bounded_and_repeatable(spark, documents):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    docs = documents([(i, "x" * i) for i in range(100)])
    a = sample(docs, labels, "quality", fold("doc_id", 3) != 1, 10, 80)
    assert len(a) <= 20 and a["text"].str.len().max() <= 80 and a.equals(sample(docs, labels, "quality", fold("doc_id", 3) != 1, 10, 80))
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 for i in a["id"])


@pytest.mark.parametrize("module,label", [(T, "toxic"), (Q, "quality")])
def test_fits_leave_the_driver_alone(spark, documents, monkeypatch, module, label):
    rows = toy()
    docs = documents([(k, t) for k, t, _ in rows])
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], f"doc_id long, {label} int")
    s = sample(docs, labels, label, F.lit(True), module.PER_CLASS, module.MOST_CHARS)
    here = module.fit(s["text"].tolist(), s["y"].to_numpy(), s["weight"].to_numpy())

    def refused(*_):
        raise AssertionError("a fit in the driver")

    with monkeypatch.context() as m:
        m.setattr(type(docs), "toPandas", refused)
        m.setattr(np, "bincount", refused)
        model = module.fit_tables(docs, labels, F.lit(True), label)
    assert model.weights == here.weights and model.bias == here.bias and len(model.weights) > 0
    none = module.fit_tables(docs.where("false"), labels, F.lit(True), label)
    assert none.weights == {}
