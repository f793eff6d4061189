"""Groups of linked items from banded candidates, without pairs inside settled groups.

Items that share a key are candidates. A bucket of two is a pair. In a larger one, every item is first compared with the
least and the greatest item only, and the links found make components. Then, round by
round, each item outside its bucket's largest component is compared with a few members of
that component, chosen by a hash; a large group whose members are not all linked with its
ends closes in a round or two. What is left is compared exhaustively, but only across
components: two items of one component need no further comparison, as they end in one
group whatever they are to each other. So no link between components is lost, and a
bucket of thousands of copies costs a few pairs each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.components import connected_components
from brindle.sources.tables import discard, saved

#: Members of the largest component that an outsider is compared with in a round.
SPOKES = 6
ROUNDS = 1
#: Pairs that an item has verified in a round where distances are given, and the rounds then.
NEAREST, NEAR_ROUNDS = 1, 2
Near = Callable[[str, str], Column]


def _pairs(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def with_facts(facts: DataFrame, name: str) -> DataFrame:
    """`facts` with its id called `name` and the other columns prefixed by it."""
    return facts.select(F.col("id").alias(name), *[F.col(x).alias(f"{name}_{x}") for x in facts.columns if x != "id"])


def bucket_members(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of buckets of two their pair (a, b); of larger ones (key, id, lo, hi) for every item, lo and hi being the ends.

    keys: key, id and what `near` looks at in `across` besides the facts of an item.
    """
    sizes = saved(keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo < hi"), "buckets")
    pairs = saved(sizes.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).distinct(), "pairs")
    members = saved(keys.join(sizes.where("n > 2").drop("n"), "key").distinct(), "members")
    discard(sizes)
    return pairs, members


def marked_open(members: DataFrame, found: DataFrame) -> DataFrame:
    """(key, id, c, main, and what members carry): items in buckets with more than one component c, and the bucket's largest."""
    carried = [x for x in members.columns if x not in ("key", "id", "c", "main")]
    placed = members.select("key", "id", *carried).join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"), *carried)
    placed = saved(placed, "placed")
    out = marked(placed)
    discard(placed)
    return out


def marked(placed: DataFrame) -> DataFrame:
    """The items (key, id, c and what else they carry) of buckets that hold more than one c, with the commonest c as main."""
    sizes = placed.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.count("*").alias("parts"))
    return saved(placed.join(sizes.where("parts > 1").drop("parts"), "key"), "open")


def across(open_items: DataFrame, facts: DataFrame, near: Near) -> DataFrame:
    """Pairs (a, b) that share a key, are of different components and meet `near`.

    One of two such items is outside the bucket's largest component, so only those are
    joined with the bucket. `near` may also look at columns that the items carry.
    """
    own = [x for x in open_items.columns if x not in ("key", "id", "c", "main")]
    side = lambda name, df: df.select("key", F.col("id").alias(name), F.col("c").alias(f"{name}_c"), *[F.col(x).alias(f"{name}_{x}") for x in own]).join(with_facts(facts, name), name)
    outside, there = side("id", open_items.where("c != main")), side("id2", open_items).withColumnRenamed("key", "key2")
    met = outside.join(there, (F.col("key") == F.col("key2")) & (F.col("id_c") != F.col("id2_c")) & near("id_", "id2_"))
    return met.select(*_pairs("id", "id2")).distinct()


def linked_groups(
    pairs: DataFrame, members: DataFrame, facts: DataFrame, near: Near, verify: Callable[[DataFrame], DataFrame], rest: Callable[[DataFrame], DataFrame] | None = None, distance: Near | None = None
) -> DataFrame:
    """(node, component) of every item with a link. pairs, members: what `bucket_members` returns.

    facts: id and what `near` looks at, one row per item. near(p, q) is a condition on the
    columns of two items, prefixed with p and q, that every link meets. verify takes pairs
    (a, b) with a < b that meet it and returns those that are links. rest takes the items
    still open (key, id, c, main, and what the members carry) and returns the pairs to compare at the end, all that can
    be links across components; without it, those that share a key. distance(p, q): with it, of the pairs
    met before that an item takes only the NEAREST and the one with the least other end to verify; what that
    leaves apart is compared at the end.
    """

    def judged(pairs: DataFrame) -> DataFrame:
        """The links among pairs (x, y); x is the item that has met y."""
        met = pairs.join(with_facts(facts, "x"), "x").join(with_facts(facts, "y"), "y").where(near("x_", "y_"))
        if distance is not None:
            # The nearest ones, and the least, which most of a group have in common.
            own = Window.partitionBy("x")
            met = met.select("x", "y", F.row_number().over(own.orderBy(distance("x_", "y_"), "y")).alias("k"), F.min("y").over(own).alias("least"))
            met = met.where((F.col("k") <= NEAREST) | (F.col("y") == F.col("least")))
        return verified(met.select(*_pairs("x", "y")).distinct(), "near")

    done: list[DataFrame] = []  # what has been verified, link or not

    def verified(met: DataFrame, name: str) -> DataFrame:
        for before in done:
            met = met.join(before, ["a", "b"], "left_anti")
        done.append(saved(met, name))
        return saved(verify(done[-1]), "linked")

    ends = members.select("id", F.explode(F.array("lo", "hi")).alias("end")).where("id != end")
    links = judged(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")).unionByName(ends.select(F.col("id").alias("x"), F.col("end").alias("y"))).distinct())
    found = saved(connected_components(links), "found")
    rounds = ROUNDS if distance is None else NEAR_ROUNDS
    for turn in range(rounds + 1):
        before, members = members, marked_open(members.drop("lo", "hi"), found)
        if turn:
            discard(before)
        if turn < rounds:
            order = Window.partitionBy("key").orderBy(F.xxhash64("id", F.lit(turn)))
            spokes = members.where("c = main").withColumn("k", F.row_number().over(order)).where(F.col("k") <= SPOKES).select("key", F.col("id").alias("end"))
            more = judged(members.where("c != main").join(spokes, "key").select(F.col("id").alias("x"), F.col("end").alias("y")).distinct())
        else:
            left = rest(members) if rest else across(members, facts, near)
            more = verified(left, "across")
        if not more.isEmpty():
            links = links.unionByName(more)
            discard(found)
            found = saved(connected_components(links), "found")
    for x in (members, *done):
        discard(x)
    return found
