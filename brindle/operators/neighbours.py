"""The next row in a global order, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources.tables import saved


def with_neighbours(keys: DataFrame, key: str, carry: str, parts: int | None = None) -> DataFrame:
    """`keys` (distinct values of `key`, and a column `carry`) with next_key and prev_carry.

    Rows are dealt by ranges of `key` (nulls first); a window orders each range, and
    one row per range bridges their ends. After the last key comes the first. Empty
    in, empty out.
    """
    n = parts or int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(keys.select(key, carry).repartitionByRange(n, F.col(key).asc_nulls_first()).withColumn("part", F.spark_partition_id()), "order")
    order = F.col(key).asc_nulls_first()
    within = Window.partitionBy("part").orderBy(order)
    rows = dealt.withColumns({
        "at": F.row_number().over(within), "next_key": F.lead(key).over(within), "prev_carry": F.lag(carry).over(within),
    }).withColumn("last", F.col("at") == F.max("at").over(Window.partitionBy("part")))
    # One row per range: at most `n` rows.
    rim = dealt.groupBy("part").agg(
        F.min_by(key, F.struct(F.col(key).isNotNull(), key)).alias("first_key"),
        F.max_by(carry, F.struct(F.col(key).isNotNull(), key)).alias("last_carry"),
    )
    along = Window.orderBy("part")
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rim = rim.select(
        "part",
        F.when(F.lead("part").over(along).isNull(), F.first("first_key").over(whole)).otherwise(F.lead("first_key").over(along)).alias("after"),
        F.when(F.lag("part").over(along).isNull(), F.last("last_carry").over(whole)).otherwise(F.lag("last_carry").over(along)).alias("before"),
    )
    return rows.join(rim, "part").select(
        key, carry,
        F.when(F.col("last"), F.col("after")).otherwise(F.col("next_key")).alias("next_key"),
        F.when(F.col("at") == 1, F.col("before")).otherwise(F.col("prev_carry")).alias("prev_carry"),
    )
