import os
import random
import time

import __spark_entry__
import duckdb
from brindle.operators.components import connected_components
from brindle.operators.neighbours import with_neighbours
from brindle.operators.skew import join_groups
from brindle.sources.tables import CLEANUP, discard, saved
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7), (None, 3), (9, None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_neighbours_wrap_and_nulls(spark):
    keys = [None, *random.Random(1).sample(range(1000), 97)]
    rows = with_neighbours(spark.createDataFrame([(k, -(k or 0)) for k in keys], "k long, c long"), "k", "c", 7).collect()
    order = sorted(keys, key=lambda k: (k is not None, k))
    got = {r.k: (r.next_key, r.prev_carry) for r in rows}
    for i, k in enumerate(order):
        assert got[k] == (order[(i + 1) % len(order)], -(order[i - 1] or 0))


def test_neighbours_of_one_and_none(spark):
    one = with_neighbours(spark.createDataFrame([(4, 9)], "k long, c long"), "k", "c").collect()
    assert [(r.k, r.next_key, r.prev_carry) for r in one] == [(4, 4, 9)]
    assert with_neighbours(spark.createDataFrame([], "k long, c long"), "k", "c").count() == 0


def test_profile_matches_sql(spark):
    got = {tuple(r) for r in __spark_entry__.queries()["documents_profile"](spark, SF).select("source", "lang", "n_docs", "n_chars", "n_words").collect()}
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'" if not __import__("os").path.isdir(f"{SF}/documents.parquet") else f"create view documents as select * from '{SF}/documents.parquet/*.parquet'")
    assert got == set(con.sql(__spark_entry__.oracle_sql()["documents_profile"]).fetchall())
    assert __spark_entry__.entry(spark).count() > 0


def test_profile_of_nulls_and_nothing(spark, tmp_path):
    rows = [(None, None, None), (None, None, ""), ("s", "en", " a  b\tc\n"), ("s", "en", "é"), ("s", "en", "é")]
    schema = "source string, lang string, text string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/some/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    profile = __spark_entry__.queries()["documents_profile"]
    got = {tuple(r) for r in profile(spark, f"{tmp_path}/some").select("source", "lang", "n_docs", "n_chars", "n_words").collect()}
    assert got == {(None, None, 2, 0, 0), ("s", "en", 3, 10, 5)}
    assert profile(spark, f"{tmp_path}/none").count() == 0


def test_saved_leaves_no_shuffle_files(spark):
    def files():
        jvm = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
        return sum(len(names) for d in jvm.blockManager().diskBlockManager().localDirs() for _, _, names in os.walk(d.getPath()))

    before, setting = files(), spark.conf.get(CLEANUP, "false")
    counted = saved(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "counted")
    time.sleep(1)
    assert counted.count() == 100 and spark.conf.get(CLEANUP, "false") == setting
    assert files() <= before + 4  # the count's own
    discard(counted)


def test_large_groups_are_not_shuffled(spark):
    rows = [(i, 0 if i < 900 else i) for i in range(2000)] + [(5000, None), (5001, 777_777)]
    sizes = [(0, 900, "large")] + [(i, 1, str(i)) for i in range(900, 2000)]
    left, right = spark.createDataFrame(rows, "id long, g long"), spark.createDataFrame(sizes, "g long, n long, name string")
    name = dict((g, x) for g, _, x in sizes)
    expected = sorted((i, g, name.get(g)) for i, g in rows if g is not None)
    for how in ("inner", "left"):
        got = join_groups(left, right, "g", "n", how)
        assert got.columns == ["id", "g", "name"]
        found = sorted(tuple(r) for r in got.where("g is not null").collect())
        assert found == [x for x in expected if how == "left" or x[2] is not None]
        assert got.where("g is null").count() == (how == "left")
    assert join_groups(left, right, "g", "n", carry=True).columns == ["id", "g", "n", "name"]
    assert join_groups(left.limit(0), right.limit(0), "g", "n", "left").count() == 0
