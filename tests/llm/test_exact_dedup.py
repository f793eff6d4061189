import hashlib
import random

import numpy as np
from brindle.llm import exact_dedup as D


def digests(n, seed=0):
    return np.frombuffer(b"".join(hashlib.sha256(f"{seed}/{i}".encode()).digest() for i in range(n)), np.uint8).reshape(-1, 32)


def test_perfect_hash_is_minimal_and_checked():
    for n in (0, 1, 2, 63, 5000):
        own, strangers = digests(n), digests(3000, 1)
        archive = D.Archive(own, np.arange(n), np.ones(n, np.int64))
        assert sorted(archive.hash.slots(own)) == list(range(n)) and archive.hash.size == n
        at = archive.lookup(own)
        assert (archive.winners[at] == np.arange(n)).all()
        assert (archive.lookup(strangers) == -1).all()


def test_what_no_level_places_is_still_found(monkeypatch):
    monkeypatch.setattr(D, "LEVELS", 1)
    own = digests(500)
    h = D.PerfectHash(own)
    assert len(h.rest) > 20 and sorted(h.slots(own)) == list(range(500))


def test_against_sql(documents, sql, same):
    rng = random.Random(2)
    texts = ["Same", "same", "SAME ", "É", "é", "", None, "x" * 9000, *(f"t{i}" for i in range(40))]
    rows = [(k, rng.choice(texts)) for k in rng.sample(range(-500, 1000), 400)] + [(3000 + i, "hot") for i in range(300)] + [(2000, "HOT")]
    docs = documents(rows)
    assert same(D.dedup_table(docs), sql(D.DEDUP_SQL, documents=docs))


def test_shards_agree(documents):
    docs = documents([(i, f"text {i % 700}") for i in range(2000)])
    d = D.text_digests(docs)
    one = {bytes(r.digest): (r.winner, r.n) for r in D.dedup_groups(d.where("key <= 900"), d.where("key > 900")).collect()}
    many = {bytes(r.digest): (r.winner, r.n) for r in D.dedup_groups(d.where("key <= 900"), d.where("key > 900"), shard_digests=50).collect()}
    assert one == many and len(one) == 700


def test_archive_and_arrivals_are_kept_apart(documents):
    found = {r.doc_id: r for r in D.exact_dedup(documents([(8, "a"), (9, "b"), (7, "b")]), documents([(1, "A"), (2, "c")])).collect()}
    assert found[1].keep_id == 8 and found[9].kept and found[7].keep_id == 9 and found[2].group_size == 1


def test_null_ids_and_empty_tables(documents):
    assert D.dedup_table(documents([])).count() == 0
    found = sorted((r.doc_id is None, r.keep_id, r.kept) for r in D.dedup_table(documents([(None, "x"), (4, "X"), (4, "x")])).collect())
    assert found == [(False, 4, True), (False, 4, True), (True, 4, False)]
    lone = D.dedup_table(documents([(None, None)])).first()
    assert lone.keep_id is None and lone.kept and lone.group_size == 1


def test_shards_follow_all_rows_whatever_the_ids(documents, sql, same, monkeypatch):
    monkeypatch.setattr(D, "SHARD_DIGESTS", 64)
    seen = []
    whole = D.dedup_groups
    monkeypatch.setattr(D, "dedup_groups", lambda new, archive: (seen.append((new.count(), archive.count())), whole(new, archive, 64))[1])
    rows = [(i, f"text {i % 900}") for i in range(1500)] + [(10**15, "far away")]
    docs = documents(rows)
    assert same(D.dedup_table(docs), sql(D.DEDUP_SQL, documents=docs))
    assert min(seen[0]) > 500  # one far id does not empty the archive
    nobody = D.dedup_table(documents([(None, f"text {i % 900}") for i in range(1500)])).collect()
    assert len(nobody) == 1500 and all(r.kept and r.keep_id is None for r in nobody) and 0 in seen[1]
