"""MinHash near-dedup with odd sketches.

A document's set is its distinct word shingles, as 64-bit hashes. PERMS MinHash samples
are cut into BANDS bands of ROWS; documents that agree on a band are candidates. At the
threshold of 0.8 a pair of sets shares no band with a chance below one in a million. The
same samples are folded into an odd sketch (Mitzenmacher, Pagh & Pham, 2014): a bitmap
whose bits are the parity of the samples that fall on them. The population count of two
sketches' XOR tells a high similarity precisely, and turns away candidates that are
clearly below the threshold (five standard deviations); what stays is confirmed on the
full sets, fetched again from the texts. Equal sets are one item throughout. What is
still apart after the large groups have closed is compared by an exact set join on rare
shingles (see prefix_rows and links.py), so a group of thousands makes no pair for each two.

Nulls: a null or empty text has an empty set, is linked with nothing and stays. A null
doc_id is linked with nothing either and has a null component. Rows that share a doc_id
belong each to the group of its own text. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.links import across, bucket_members, linked_groups, marked
from brindle.operators.skew import join_groups
from brindle.sources.tables import discard, saved

ROWS, BANDS = 6, 48
PERMS = ROWS * BANDS
SKETCH_BITS = 512
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 80
_rng = np.random.default_rng(20160601)
_A = _rng.integers(0, 1 << 32, PERMS, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, PERMS, dtype=np.uint32)
_BAND = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_SALT = _rng.integers(0, 1 << 63, PERMS, dtype=np.uint64) | np.uint64(1)
_CHUNK = 512


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | bytes | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of the `size`-word shingles of a text, A-Z lower-cased.

    Words are runs of anything but space and \\x09-\\x0D. Fewer words are one shingle as a
    whole; without words the set is empty.
    """
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(words))], np.uint64)
    n = len(h) - size + 1
    x = h[:n].copy()
    for i in range(1, size):
        x = _mixed(x) + h[i : i + n]
    return np.unique(_mixed(x))


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """PERMS samples of a non-empty set."""
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(PERMS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), _CHUNK):
        v = x[i : i + _CHUNK, None] * _A
        v += _B
        np.minimum(least, v.min(axis=0), out=least)
    return least


def band_keys(samples: np.ndarray) -> np.ndarray:
    return _mixed((samples.reshape(BANDS, ROWS).astype(np.uint64) * _BAND).sum(axis=1) + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)


def odd_sketch(samples: np.ndarray) -> bytes:
    """The parity bitmap of the samples."""
    at = _mixed(samples.astype(np.uint64) + _SALT) % np.uint64(SKETCH_BITS)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8).tobytes()


def sketch_similarity(differing: int) -> float:
    """The similarity that a count of differing bits speaks for."""
    rest = max(1e-9, 1 - 2 * differing / SKETCH_BITS)
    return 1 + SKETCH_BITS / (4 * PERMS) * math.log(rest)


def most_differing(percent: int = PERCENT) -> int:
    """The XOR count above which a pair at the threshold practically never comes."""
    j = percent / 100
    q = math.exp(-4 * PERMS * (1 - j) / SKETCH_BITS)
    mean = SKETCH_BITS / 2 * (1 - q)
    spread = math.sqrt(PERMS * j * (1 - j) * 4 * q * q + SKETCH_BITS / 4 * (1 - q * q))
    return math.ceil(mean + 5 * spread)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, text and mark, a hash of the text that tells rows of one key apart."""
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("mark"))


def signatures(docs: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, mark, n, digest, bands, sketch (as longs) of every row; digest is the whole set's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, bands, sketches = [], [], [], []
            for t in batch.column(1).cast(pa.binary()):
                s = shingle_set(t.as_py(), size)
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(s):
                    m = minhashes(s)
                    bands.append(band_keys(m))
                    sketches.append(np.frombuffer(odd_sketch(m), np.int64))
                else:
                    bands.append(None)
                    sketches.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                names=["key", "mark", "n", "digest", "bands", "sketch"],
            )

    return _rows(docs, key, text).mapInArrow(run, "key long, mark long, n long, digest binary, bands array<long>, sketch array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity. texts: (key, text)."""
    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary()), strict=True):
                a = ta.as_py()
                if mine is None or a != last:
                    last, mine = a, shingle_set(a, size)
                other = shingle_set(tb.as_py(), size)
                shared = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(shared > 0 and 100 * shared >= percent * (len(mine) + len(other) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", F.col("ta").cast("string"), F.col("tb").cast("string")).mapInArrow(run, "a long, b long").distinct()


def prefix_rows(items: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(key, id, c, k): the rarest shingles of each item (id, c), of which two linked items share one.

    Similar sets have `percent` of each set in common, so of the shingles in one order, here
    by how many of the items have them, the first n - ceil(percent * n / 100) + 1 of both
    have one in common (the prefix filter of set joins). k is the place in that order.
    Shingles of one item join nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                some = batch.slice(i, 64)
                sets = [shingle_set(t.as_py(), size) for t in some.column(2).cast(pa.binary())]
                n = [len(x) for x in sets]
                at = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(at), some.column(1).take(at), pa.array(np.repeat(n, n).astype(np.int64)), pa.array(np.concatenate(sets).view(np.int64))], names=["id", "c", "n", "key"]
                )

    own = items.join(texts.withColumnRenamed("key", "id"), "id").select("id", "c", "text").mapInArrow(run, "id long, c long, n long, key long")
    own = saved(own.distinct(), "shingles")
    common = own.groupBy("key").agg(F.count("*").alias("df"))
    order = Window.partitionBy("id", "n").orderBy("df", "key")
    ranked = own.join(common, "key").withColumn("k", F.row_number().over(order))
    length = F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1
    return ranked.where((F.col("k") <= length) & (F.col("df") > 1)).select("key", "id", "c", "k")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = PERCENT, key: str = "doc_id", text: str = "text", among: DataFrame | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; with `among`, only for rows with a key in that table, compared among themselves."""
    signed = signatures(docs, size, key, text)
    if among is not None:
        signed = signed.join(among.select(F.col(key).cast("long").alias("key")).distinct(), "key", "left_semi")
    signed = saved(signed, "signatures")
    brief = saved(signed.select("key", "n", "digest"), "sets")
    # Every distinct set is an item with a number of its own; rep is the least doc_id that has it.
    sets = brief.where("n > 0 and key is not null").groupBy("digest").agg(F.min("key").alias("rep"), F.count("*").alias("size"))
    sets = saved(sets.withColumn("id", F.monotonically_increasing_id()), "reps")
    items = signed.join(sets.select("digest", F.col("rep").alias("key"), "id"), ["key", "digest"])
    lone = saved(items.select("id", "key", "mark", "n", "bands", "sketch").dropDuplicates(["id"]), "items")
    discard(signed)
    most = most_differing(percent)

    def near(p: str, q: str):
        differing = F.bit_count(F.col(f"{p}s0").bitwiseXOR(F.col(f"{q}s0")))
        for i in range(1, SKETCH_BITS // 64):
            differing = differing + F.bit_count(F.col(f"{p}s{i}").bitwiseXOR(F.col(f"{q}s{i}")))
        sizes = 100 * F.least(f"{p}n", f"{q}n") >= percent * F.greatest(f"{p}n", f"{q}n")
        return sizes & (differing <= most)

    pairs, members = bucket_members(lone.select(F.explode("bands").alias("key"), "id"))
    # What candidates need later is fetched once: their sketches and their texts.
    ids = saved(members.select("id").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("id"))).distinct(), "ids")
    facts = lone.join(ids, "id", "left_semi")
    facts = saved(facts.select("id", "key", "mark", "n", *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH_BITS // 64)]), "facts")
    for x in (lone, ids):
        discard(x)
    wanted = facts.select("key", "mark", "id")
    facts = facts.drop("key", "mark")
    texts = _rows(docs, key, text).withColumn("text", F.coalesce("text", F.lit(""))).join(wanted, ["key", "mark"]).select(F.col("id").alias("key"), "text")
    texts = saved(texts, "texts")

    def rest(open_items: DataFrame) -> DataFrame:
        items = saved(open_items.select("id", "c").distinct(), "rest")

        def near_there(p: str, q: str):
            # Of two sets of these sizes, each has the first shingle in common among its first n - shared + 1.
            shared = F.floor((percent * (F.col(f"{p}n") + F.col(f"{q}n")) + 99 + percent) / (100 + percent))
            return (F.col(f"{p}k") <= F.col(f"{p}n") - shared + 1) & (F.col(f"{q}k") <= F.col(f"{q}n") - shared + 1) & near(p, q)

        return across(marked(saved(prefix_rows(items, texts, size, percent), "prefixes")), facts, near_there)

    found = linked_groups(pairs, members, facts, near, lambda some: confirmed(some, texts, size, percent), rest)
    for x in (pairs, members, texts):
        discard(x)
    # The name of a component is the least doc_id of its sets.
    numbered = found.join(sets.select(F.col("id").alias("node"), "rep"), "node")
    least = numbered.groupBy("component").agg(F.min("rep").alias("least"))
    named = found.join(least, "component").select(F.col("node").alias("id"), "least")
    of_set = saved(sets.join(named, "id", "left").select("digest", "size", F.coalesce("least", "rep").alias("component")), "sets")
    out = join_groups(brief, of_set, "digest", "size", "left")
    component = F.when(F.col("n") == 0, F.col("key")).when(F.col("key").isNotNull(), F.col("component"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def near_duplicates_sql(size: int = 2, percent: int = PERCENT) -> str:
    """DuckDB SQL for distinct doc_ids: all pairs that share a shingle, links on whole sets, components by reaching out."""
    shingle = "array_to_string(ws[i : i + {}], ' ')".format(size - 1)
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, {shingle} AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {size - 2}, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= {percent} * (nx.n + ny.n - c)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT x AS doc_id, y AS other FROM b UNION SELECT r.doc_id, b.y FROM r JOIN b ON b.x = r.other),
g AS (SELECT doc_id, min(other) AS least FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(g.least, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(g.least, doc_id)) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)
"""
