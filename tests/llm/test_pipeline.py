import random
import re

import __spark_entry__
import corpus_pipeline
from brindle.llm import quality, toxicity
from brindle.llm.labelled import sample
from brindle.sources.tables import saved
from pyspark.sql import functions as F

from tests.llm.test_line_dedup import brute as without_lines
from tests.llm.test_minhash import brute as near_groups
from tests.llm.test_packing import check

WORDS = [a + b + c for a in "bdfgklmnpr" for b in ("ala", "eru", "ino", "osa") for c in ("", "nt", "lis")]


def fixture(spark, path):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(260):
        lines = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(6, 14))) + "." for _ in range(rng.randrange(2, 7))]
        toxic, good = i % 6 == 0, i % 5 != 1
        if toxic:
            lines[-1] += " vilewo" + rng.choice("abcdef") + "."
        if not good:
            lines = [" ".join(w.upper() + "!!" for w in line.split()) for line in lines]
        if i % 7 == 0:
            lines.append("one footer line that very many documents share with each other")
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(good), int(toxic)))
    rows += [(300 + i, t.replace("\n", " ")) for i, t in rng.sample(rows, 40)]
    rows += [(1000 + i, t) for i, t in rng.sample(rows[:260], 25)]
    rows += [(900, None), (901, ""), (902, "\n"), (903, "é " * 9000)]
    full = [(k, t, "en", "src", None if t is None else len(t)) for k, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_stages_against_brute_force(spark, tmp_path):
    fixture(spark, tmp_path)
    sf, labels = str(tmp_path), spark.read.parquet(f"{tmp_path}/labels.parquet")
    read = lambda df: {r.doc_id: r.text for r in df.collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = read(docs)
        out = stage(spark, docs, sf)
        assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(f"{sf}/{name}")
        after = read(spark.read.parquet(f"{sf}/{name}"))
        if name in ("toxicity", "quality"):
            module, label = (toxicity, "toxic") if name == "toxicity" else (quality, "quality")
            s = sample(docs, labels, label, F.lit(True), module.PER_CLASS, module.MOST_CHARS)
            model = module.fit(s["text"].tolist(), s["y"].to_numpy(), s["weight"].to_numpy())
            score = lambda t: model.score(t or "")[0] if name == "toxicity" else model.score(t or "")  # noqa: B023, E731
            expected = {k: t for k, t in before.items() if (score(t) < 0.5) == (name == "toxicity")}
            assert 0 < len(expected) < len(before)
        elif name == "line_dedup":
            lines = without_lines(list(before.items()))
            expected = {k: t for k, t in lines.items() if t == before[k] or re.search(r"[^\W_]", t)}
            assert lines != before and len(expected) < len(before)
        else:  # by the texts before lines went
            first = read(spark.read.parquet(f"{sf}/documents.parquet"))
            expected = {k: before[k] for k, _, _, kept in near_groups([(k, first[k]) for k in before], 5) if kept}
        assert after == expected, name
        docs = spark.read.parquet(f"{sf}/{name}")
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in last} == set(read(docs))
    check(last, 4096)
    whole = corpus_pipeline.run(spark, sf).collect()
    brief = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert brief(whole) == brief(last)


def test_near_copies_go_after_their_lines_went(spark, tmp_path):
    rng = random.Random(12)
    line = lambda: " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(12))
    base = [line() for _ in range(40)]
    rows = [(7, "\n".join(base))]
    for k in (20, 30, 40):  # near copies: a line of their own each
        rows.append((k, "\n".join([*base[:k], line(), *base[k:]])))
    rows += [(50, "\n".join(line() for _ in range(40))), (60, "\n".join(base)), (70, None), (71, ""), (None, "\n".join(base))]
    full = [(k, t, "en", "s", None if t is None else len(t)) for k, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    lined = saved(corpus_pipeline.without_repeated_lines(spark, docs, str(tmp_path)), "lined")
    left = {r.doc_id: r.text for r in lined.collect()}
    assert set(left) == {7, 20, 30, 40, 50, 70, 71, None}  # the exact copy has no line left
    assert all(left[k].count("\n") == 0 for k in (20, 30, 40))
    assert {r.doc_id for r in corpus_pipeline.one_of_each(spark, lined, str(tmp_path)).collect()} == {7, 50, 70, 71, None}


def test_stages_take_nulls_repeats_and_other_columns(spark, tmp_path):
    rows = [(None, None), (None, "words of nobody"), (4, "words of four here"), (4, "words of four here"), (5, ""), (6, "é")]
    full = [(k, t, None, None, None, "x", "y", "z") for k, t in rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept string, __id string, dropped_lines string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == list(corpus_pipeline.COLUMNS) and out.count() == 6, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 6


def test_stages_take_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
