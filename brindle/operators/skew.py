"""A join of rows with their groups that no large group can hold up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group over this share of all rows counts as large, so there are fewer than its inverse of them.
LARGE = 1 / 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, how: str = "inner", carry: bool = False) -> DataFrame:
    """`rows` joined with `groups` by the column `key`; `size` of a group is its number of rows, and goes unless `carry`.

    Groups that hold more than LARGE of all rows are at most 1000, whatever the data, and
    are broadcast, so their rows stay where they are; all others are joined by a shuffle in
    which no key has more than that share. how: inner or left (rows without a group stay,
    with nulls). Rows with a null key have no group. Both tables are read twice, so they
    should be saved ones. The columns are those of `rows`, then the others of `groups`.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"join {how}")
    total = groups.agg(F.sum(size)).first()[0] or 0
    large, small = (x if carry else x.drop(size) for x in (groups.where(F.col(size) > total * LARGE), groups.where(F.col(size) <= total * LARGE)))
    columns = [*rows.columns, *[x for x in small.columns if x != key]]
    here = rows.join(F.broadcast(large), key).select(*columns)
    there = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(small, key, how).select(*columns)
    return here.unionByName(there)
