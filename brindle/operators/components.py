"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a join and an aggregate on the node, so no task ever holds a node's
neighbours and a hub costs one row for each of its links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.sources.tables import discard, saved


def _toward_least(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with the least v of its u as m."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u").withColumn("m", F.least("u", "m"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_steps: int = 60) -> DataFrame:
    """(node, component) for every node with a link; component is the least node reachable.

    Links with a null end and links of a node to itself are left out; repeated links
    count once. No rows come back for an empty table.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    links = edges.where(u.isNotNull() & v.isNotNull() & (u != v))
    now = saved(links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "links")
    mark = None
    for _ in range(most_steps):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        found = _toward_least(large)
        small = (
            found.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(found.select("u", F.col("m").alias("v"))).distinct()
        )
        after = saved(small, "links")
        discard(now)
        now, was = after, mark
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == was:
            break
    else:
        raise RuntimeError(f"components have not settled after {most_steps} steps")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
