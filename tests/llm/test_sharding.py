import random
from collections import defaultdict

import pytest
from brindle.llm.sharding import extendible_shards, shards_sql, write_shards


@pytest.mark.parametrize("limit", [400, 3000, 10**9])
def test_against_sql(documents, sql, same, limit):
    rng = random.Random(limit)
    docs = documents([(i, None if i % 17 == 0 else "é" * rng.randrange(0, 120)) for i in range(700)] + [(9001, "z" * 500), (None, "n")])
    found = extendible_shards(docs, limit=limit)
    assert same(found, sql(shards_sql(limit), documents=docs))
    check(found.collect(), limit, 702)


def check(found, limit, n):
    by = defaultdict(list)
    for r in found:
        by[r.shard_id].append(r)
    assert len(found) == n
    for shard in by.values():
        assert sum(r.bytes for r in shard) == shard[0].shard_bytes and len(shard) == shard[0].shard_rows
        assert shard[0].shard_bytes <= limit or len(shard) == 1


def test_only_full_buckets_split(documents):
    found = extendible_shards(documents([(i, "x" * 10) for i in range(1000)]), limit=600).collect()
    depth = {r.shard_id: r.depth for r in found}
    parents = defaultdict(int)
    for r in found:
        for d in range(r.depth):
            parents[d, int(r.shard_id.split("-")[1]) >> (r.depth - d)] += r.bytes
    assert all(b > 600 for b in parents.values()) and len(depth) > 16


def test_repeated_key_and_oversize(documents):
    rows = [(5, "x" * 100)] * 40 + [(5, "y" * 7)] * 3 + [(6, "w" * 5000)] * 2 + [(i, "") for i in range(100, 120)]
    check(extendible_shards(documents(rows), limit=950).collect(), 950, len(rows))


def test_empty(documents):
    assert extendible_shards(documents([])).count() == 0
    assert extendible_shards(documents([(None, None)])).collect()[0].shard_bytes == 0


def test_null_keys_by_the_thousand(documents):
    rows = [(None, "x" * 10)] * 3000 + [(i, "y" * 10) for i in range(500)]
    found = extendible_shards(documents(rows).repartition(7), limit=200).collect()
    check(found, 200, len(rows))
    assert len({r.shard_id for r in found if r.doc_id is None}) == 150


def test_shards_are_written(spark, documents, tmp_path):
    docs = documents([(i, "z" * (i % 90)) for i in range(400)] + [(None, "n")])
    write_shards(docs, f"{tmp_path}/shards", limit=2000)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert {(r.doc_id, r.text, r.key) for r in back.collect()} == {(r.doc_id, r.text, r.key) for r in docs.collect()}
    sizes = defaultdict(int)
    for r in back.collect():
        sizes[r.shard_id] += len(r.text)
    assert len(sizes) > 5 and max(sizes.values()) <= 2000
