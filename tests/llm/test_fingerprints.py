import hashlib
import random

from brindle.llm import fingerprints as FP
from pyspark.sql import functions as F

TEXTS = ["", None, "a", "abc\ndef\n\nghi", "x" * 5000, "A\n\n\n\nB", "ünï😀" * 40, "\n", "\n\n", "same text here " * 9, "same text here " * 9, "line\r\nother\tline\n" * 30]


def test_against_sql(documents, sql, same):
    rng = random.Random(1)
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(200 + i, "".join(rng.choice("ab \né\n.") for _ in range(rng.randrange(300)))) for i in range(60)]
    docs = documents(rows)
    assert same(FP.edited_fingerprints(docs), sql(FP.fingerprints_sql(), documents=docs))


def test_edited_text_wraps_and_counts_code_points(documents):
    rows = sorted([(4, "😀bcdefgh"), (9, "XYZ"), (2, "12345678")])
    found = {r.doc_id: r for r in FP.edited_fingerprints(documents(rows)).collect()}
    for i, (k, t) in enumerate(rows):
        following = rows[(i + 1) % 3][1]
        cut = len(t) // 4
        assert found[k].n_chars == len(t)
        assert found[k].edited_sha256 == hashlib.sha256((t[: len(t) - cut] + following[:cut]).encode()).hexdigest()
    assert found[9].fingerprint == found[9].edited_fingerprint and found[9].near_edited == 1.0


def test_roots_tell_texts_apart_and_branches_say_where(spark, documents):
    texts = ["a\nb\n\nc", "a\nb\n\nd", "a\n\nb\nc", "a\nb\nc", "ab\n\nc", "a\nb\n\nc\n"]
    found = FP.fingerprints(documents(list(enumerate(texts)))).orderBy("doc_id").collect()
    assert len({r.fingerprint for r in found}) == len(texts)
    df = spark.createDataFrame([(found[0].sections, found[1].sections, found[3].sections)], "a array<string>, b array<string>, c array<string>")
    r = df.select(FP.differing_sections(F.col("a"), F.col("a")), FP.differing_sections(F.col("a"), F.col("b")), FP.differing_sections(F.col("a"), F.col("c"))).first()
    assert list(r) == [[], [1], [0, 1]]


def test_repeated_null_and_no_ids(documents):
    rows = [(5, "bbbbbbbb"), (5, "aaaaaaaa"), (None, "cccccccc"), (9, None), (9, None)]
    found = FP.edited_fingerprints(documents(rows)).collect()
    assert len(found) == 5
    least = min("bbbbbbbb", "aaaaaaaa", key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    null = next(r for r in found if r.doc_id is None)
    assert null.edited_sha256 == hashlib.sha256(("cccccc" + least[:2]).encode()).hexdigest()
    assert FP.edited_fingerprints(documents([])).count() == 0
    one = FP.edited_fingerprints(documents([(1, "hello world")])).first()
    assert one.near_next == 1.0
