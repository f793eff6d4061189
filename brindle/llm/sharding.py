"""Sharding by extendible hashing, in DataFrame functions only.

The hash of a row is the first 60 bits of the MD5 of its key. The directory is
indexed by the leading bits of the hash; a bucket is halved on its next bit only
while it is over the byte limit. Bits are added in rounds: a round sums bytes by
a prefix some bits longer than the last one, adds those cells up to every shorter
prefix, and so knows each bucket that had to split. Rows of cells still over the
limit go to another round; everything else is done.

Rows larger than the limit by themselves, and rows whose 60 bits are all equal and
together are over the limit, cannot be parted by bits. They go to pages: each page
takes as many rows of one key and size as fit, and one row at least.

Nulls: a null key hashes as the empty string, a null text has 0 bytes. Repeated
rows are rows of their own. An empty table gives no rows. Other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources.tables import saved

#: Bytes of text in a shard at most.
SHARD_BYTES = 64 << 20
BITS = 60


def key_hash(key: str) -> Column:
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _round(rows: DataFrame, limit: int, low: int, high: int) -> DataFrame:
    """The directory of rows whose buckets at `low` bits are over the limit (at 0 bits: any rows).

    Returns cell (the first `high` bits), depth, prefix, shard_bytes, shard_rows; depth is
    null for cells that are over the limit at `high` bits.
    """
    cells = saved(
        rows.groupBy(F.shiftright("h", BITS - high).alias("cell")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n")), "cells"
    )
    first = low if low == 0 else low + 1
    steps = cells.select("cell", "b", "n", F.explode(F.sequence(F.lit(first), F.lit(high))).alias("depth"))
    steps = steps.withColumn("prefix", F.call_function("shiftright", F.col("cell"), F.lit(high) - F.col("depth")))
    levels = saved(steps.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows")), "levels")
    over = levels.where(F.col("shard_bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    leaves = levels.where(F.col("shard_bytes") <= limit).withColumn("parent", F.shiftright("prefix", 1))
    leaves = leaves.where(F.col("depth") == first).unionByName(leaves.where(F.col("depth") > first).join(over, ["depth", "parent"], "left_semi")).drop("parent")
    pointers = steps.select("cell", "depth", "prefix").join(leaves, ["depth", "prefix"])
    return cells.select("cell").join(pointers, "cell", "left").select("cell", "depth", "prefix", "shard_bytes", "shard_rows")


def extendible_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES, spare_bits: int = 6) -> DataFrame:
    """The shard of every row: key, bytes, shard_id, depth, shard_bytes, shard_rows.

    shard_id is depth and prefix of a bucket of the directory, or, of a page, the hash,
    the row size and the page's number; depth is 60 there. spare_bits: how many bits
    a round looks past those that an even spread would need; it changes no result.
    """
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    rows = saved(docs.select(F.col(key).alias("key"), size.alias("bytes"), key_hash(key).alias("h")), "rows")
    open_rows, done, low = rows.where(F.col("bytes") <= limit), [], 0
    while True:
        # One row: the bytes of the largest bucket still open.
        most = open_rows.groupBy(F.shiftright("h", BITS - low)).agg(F.sum("bytes").alias("b")).agg(F.max("b")).first()[0] if low else open_rows.agg(F.sum("bytes")).first()[0]
        if most is None:
            break
        high = min(BITS, low + max(1, math.ceil(math.log2(max(1, most / limit)))) + spare_bits)
        directory = saved(_round(open_rows, limit, low, high), "directory")
        placed = open_rows.withColumn("cell", F.shiftright("h", BITS - high)).join(directory, "cell")
        shard = F.concat(F.lit("b"), F.col("depth"), F.lit("-"), F.col("prefix"))
        done.append(placed.where("depth is not null").select("key", "bytes", shard.alias("shard_id"), "depth", "shard_bytes", "shard_rows"))
        if directory.where("depth is null").isEmpty():
            open_rows = None
            break
        open_rows, low = saved(placed.where("depth is null").select("key", "bytes", "h"), "open"), high
        if low == BITS:
            break
    paged = rows.where(F.col("bytes") > limit)
    if open_rows is not None and low == BITS:
        paged = paged.unionByName(open_rows)
    # Rows of one key and size get numbers, part of the table by part, and go to pages by number.
    fit = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("bytes", F.lit(1)))).cast("long")
    same, none = ["key", "bytes", "h"], F.lit(0).cast("long")
    paged = saved(paged.withColumn("part", F.spark_partition_id()), "paged")
    counted = paged.groupBy(*same, "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.select(*same, "part", F.coalesce(F.sum("n").over(before), none).alias("base"), F.sum("n").over(Window.partitionBy(*same)).alias("n"))
    numbered = paged.withColumn("i", F.row_number().over(Window.partitionBy(*same, "part").orderBy("bytes")))
    alike = [numbered[x].eqNullSafe(counted[x]) for x in (*same, "part")]
    each = numbered.join(counted, alike[0] & alike[1] & alike[2] & alike[3]).select(*[numbered[x] for x in same], "n", (F.col("base") + F.col("i") - 1).alias("i"))
    each = each.withColumn("fit", fit)
    in_page = F.least(F.col("fit"), F.col("n") - F.floor(F.col("i") / F.col("fit")) * F.col("fit"))
    pages = each.select(
        "key", "bytes", F.concat_ws("-", F.lit("p"), F.col("h"), F.md5(F.coalesce(F.col("key").cast("string"), F.lit("null"))), F.col("bytes"), F.floor(F.col("i") / F.col("fit"))).alias("shard_id"),
        F.lit(BITS).alias("depth"), (in_page * F.col("bytes")).alias("shard_bytes"), in_page.alias("shard_rows"),
    )
    out = pages
    for part in done:
        out = out.unionByName(part)
    return out.withColumnRenamed("key", key)


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> None:
    """The rows of `docs`, all columns, as Parquet under `path`, a folder for each shard (shard_id=...).

    Keys have to be distinct: a repeated key would not say which page its row is on.
    """
    shards = extendible_shards(docs, key, text, limit).select(F.col(key).alias("__shard_key"), "shard_id")
    placed = docs.drop("shard_id").join(shards, F.col(key).eqNullSafe(F.col("__shard_key"))).drop("__shard_key")
    placed.repartition("shard_id").write.partitionBy("shard_id").parquet(path)


def shards_sql(limit: int = SHARD_BYTES) -> str:
    """DuckDB SQL for distinct keys: every prefix of every length is summed, and the leaves are looked up."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS bytes,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
lv AS (SELECT g.depth, h >> CAST({BITS} - g.depth AS INT) AS prefix, sum(bytes) AS b, count(*) AS n
       FROM d, (SELECT CAST(unnest(range(0, {BITS + 1})) AS INT) AS depth) g WHERE bytes <= {limit} GROUP BY ALL),
leaf AS (SELECT * FROM lv WHERE b <= {limit} AND (depth = 0 OR EXISTS (
       SELECT 1 FROM lv p WHERE p.depth = lv.depth - 1 AND p.prefix = lv.prefix >> 1 AND p.b > {limit})))
SELECT d.doc_id, CAST(d.bytes AS BIGINT) AS bytes, 'b' || leaf.depth || '-' || leaf.prefix AS shard_id,
       leaf.depth, CAST(leaf.b AS BIGINT) AS shard_bytes, CAST(leaf.n AS BIGINT) AS shard_rows
FROM d JOIN leaf ON d.bytes <= {limit} AND d.h >> CAST({BITS} - leaf.depth AS INT) = leaf.prefix
UNION ALL
SELECT doc_id, CAST(bytes AS BIGINT), 'p-' || h || '-' || md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) || '-' || bytes || '-0', {BITS}, CAST(bytes AS BIGINT), 1
FROM d WHERE bytes > {limit}
"""
