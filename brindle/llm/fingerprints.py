"""Merkle fingerprints of texts, in DataFrame functions only.

A text is a tree: sections (parted by one empty line), their paragraphs (lines), and
windows of WINDOW characters in each paragraph as the leaves. Every node's hash is the
MD5 of what is below it, so equal roots mean equal texts and a differing branch says
where an edit lies. Likeness is the share of distinct leaf hashes that two trees have
in common (Jaccard), 1 for two trees without leaves.

Nulls: a null text counts as empty. Repeated rows are fingerprinted each; the next
document of a doc_id is the next distinct doc_id (nulls first, after the last the
first), of several rows with that doc_id the one with the least SHA-256. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.neighbours import with_neighbours
from brindle.sources.tables import saved

WINDOW = 32


def leaf_tree(text: Column, window: int = WINDOW) -> Column:
    """Sections of paragraphs of leaf hashes: array<array<array<string>>>."""
    pattern = F.lit(f"(?s).{{1,{window}}}")
    paragraph = lambda p: F.transform(F.regexp_extract_all(p, pattern, F.lit(0)), F.md5)
    return F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), paragraph))


def section_hashes(tree: Column) -> Column:
    """One hash per section: of its paragraphs' hashes, each of its leaves' hashes."""
    return F.transform(tree, lambda s: F.md5(F.array_join(F.transform(s, lambda p: F.md5(F.array_join(p, ""))), "")))


def root(sections: Column) -> Column:
    return F.md5(F.array_join(sections, ""))


def leaf_keys(tree: Column) -> Column:
    """The distinct leaves, 60 bits of each."""
    flat = F.flatten(F.flatten(tree))
    return F.array_distinct(F.transform(flat, lambda x: F.conv(F.substring(x, 1, 15), 16, 10).cast("long")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct leaf keys."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either).cast("double")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, fingerprint, sections (hashes) and leaves (keys) of every text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return (
        docs.select(F.col(key).alias("key"), F.length(whole).cast("long").alias("n_chars"), leaf_tree(whole).alias("tree"))
        .select("key", "n_chars", section_hashes(F.col("tree")).alias("sections"), leaf_keys(F.col("tree")).alias("leaves"))
        .select(F.col("key").alias(key), "n_chars", root(F.col("sections")).alias("fingerprint"), "sections", "leaves")
    )


def differing_sections(a: Column, b: Column) -> Column:
    """The places (from 0) of sections whose hashes differ or that only one text has."""
    n = F.greatest(F.size(a), F.size(b))
    return F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & ~F.try_element_at(a, i + 1).eqNullSafe(F.try_element_at(b, i + 1)))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of the text with its last quarter replaced from the next document.

    Two shuffles carry text: the rows to their key, and from each document the few
    characters and the leaf keys that the one before it needs.
    """
    docs = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sizes = docs.select("key", F.length("text").cast("long").alias("n"))
    lone = sizes.groupBy("key").agg(F.max("n").alias("n"), F.count("*").alias("rows"))
    around = saved(with_neighbours(lone.withColumn("carry", F.struct("n", "rows", "key")), "key", "carry"), "around")
    repeated = not around.where("carry.rows > 1").isEmpty()
    around = around.select(F.col("key").alias("at"), F.col("prev_carry.key").alias("taker"), F.floor(F.col("prev_carry.n") / 4).cast("int").alias("need"))
    rows = docs.join(around, F.col("key").eqNullSafe(F.col("at"))).withColumn("leaves", leaf_keys(leaf_tree(F.col("text"))))
    given = rows.select(
        "taker", F.struct(F.substring("text", F.lit(1), F.col("need")).alias("head"), F.col("leaves").alias("next_leaves")).alias("given"),
        *([F.sha2("text", 256).alias("mark")] if repeated else []),
    )
    if repeated:
        given = given.groupBy("taker").agg(F.min_by("given", "mark").alias("given"))
    given = given.select("taker", "given.head", "given.next_leaves")
    whole = rows.drop("taker", "at").join(given, F.col("key").eqNullSafe(F.col("taker")))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("head", F.lit(1), cut))
    trees = whole.select("key", n.cast("long").alias("n_chars"), "leaves", "next_leaves", leaf_tree(F.col("text")).alias("tree"), edited.alias("edited"))
    trees = trees.select("*", leaf_tree(F.col("edited")).alias("edited_tree"))
    hashed = trees.select(
        "key", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), root(section_hashes(F.col("tree"))).alias("fingerprint"),
        root(section_hashes(F.col("edited_tree"))).alias("edited_fingerprint"), "leaves", "next_leaves", leaf_keys(F.col("edited_tree")).alias("edited_leaves"),
    )
    return hashed.select(
        F.col("key").alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("leaves"), F.col("edited_leaves")).alias("near_edited"), likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"),
    )


def fingerprints_sql(window: int = WINDOW) -> str:
    """DuckDB SQL for distinct ids: the same tree in list functions."""
    tree = lambda t: f"list_transform(string_split({t}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '(?s).{{1,{window}}}'), lambda x: md5(x))))"
    joined = lambda x: f"coalesce(array_to_string({x}, ''), '')"
    top = lambda t: f"md5({joined(f'list_transform({t}, lambda s: md5({joined(f'list_transform(s, lambda p: md5({joined('p')}))')}))')})"
    leaves = lambda t: f"list_distinct(flatten(flatten({t})))"
    alike = lambda a, b: f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b})) / CAST(len({a}) + len({b}) - len(list_intersect({a}, {b})) AS DOUBLE) END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nt FROM d),
e AS (SELECT doc_id, t, nt, substr(t, 1, length(t) - length(t) // 4) || substr(nt, 1, length(t) // 4) AS et FROM n),
h AS (SELECT doc_id, length(t) AS n_chars, sha256(et) AS edited_sha256, {tree('t')} AS a, {tree('et')} AS b, {tree('nt')} AS c FROM e),
l AS (SELECT doc_id, n_chars, edited_sha256, {top('a')} AS fingerprint, {top('b')} AS edited_fingerprint,
             {leaves('a')} AS la, {leaves('b')} AS lb, {leaves('c')} AS lc FROM h)
SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, edited_sha256, fingerprint, edited_fingerprint,
       CAST({alike('la', 'lb')} AS DOUBLE) AS near_edited, CAST({alike('la', 'lc')} AS DOUBLE) AS near_next FROM l
"""
