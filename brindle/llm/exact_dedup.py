"""Exact dedup against an archive, by minimal perfect hashing.

The archive's distinct digests are dealt to shards by their first bits. Each shard
gets a minimal perfect hash in levels (Limasset et al., 2017): at a level every
remaining digest sets one bit of a bit array; digests that are alone on theirs stay
there, the others go to the next level, and what is left after the last level is kept
in a short sorted list. A digest's slot is the rank of its bit over all levels. A slot
holds the whole 32-byte digest and the locator of the winning row, so a lookup is
checked byte by byte and a stranger is never taken for a member.

New digests that the archive has are repeats of its winner; the rest are grouped among
themselves. The winner of a group is its largest doc_id, wherever it is.

Nulls: a null text counts as empty, a null doc_id loses to any other and is kept only
where its group has no other. Rows that share doc_id and text are all kept or none.
Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.skew import join_groups
from brindle.sources.tables import saved

#: Digests in a shard, about; a shard is one task's unit of work.
SHARD_DIGESTS = 1 << 15
LEVELS = 24
GAMMA = 2.0
_NONE = np.iinfo(np.int64).min


def _words(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers from bytes 8-23 of each digest (the first bytes choose the shard)."""
    w = np.ascontiguousarray(digests).view(">u8").reshape(-1, 4).astype(np.uint64)
    return w[:, 1], w[:, 2] | np.uint64(1)


class PerfectHash:
    """A minimal perfect hash of distinct 32-byte digests (an n x 32 array of bytes)."""

    def __init__(self, digests: np.ndarray):
        self.bits, self.starts, self.rest = [], [], np.empty((0, 32), np.uint8)
        left, start = digests, 0
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, int(GAMMA * len(left)))
            at = self._place(left, level, size)
            n = np.bincount(at, minlength=size)
            self.bits.append(n == 1)
            self.starts.append(start)
            start += int((n == 1).sum())
            left = left[n[at] != 1]
        if len(left):
            self.rest = left[np.lexsort(left.T[::-1])]
        self.ranks = [np.cumsum(b) - b for b in self.bits]
        self.rest_start = start
        self._rest_at = {x.tobytes(): start + i for i, x in enumerate(self.rest)}
        self.size = start + len(self.rest)

    @staticmethod
    def _place(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        a, b = _words(digests)
        x = a + b * np.uint64(2 * level + 1)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        return (x % np.uint64(size)).astype(np.int64)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """A slot for each digest: its own for a member, any or -1 for a stranger."""
        out = np.full(len(digests), -1, np.int64)
        open_at = np.arange(len(digests))
        for level, bits in enumerate(self.bits):
            at = self._place(digests[open_at], level, len(bits))
            hit = bits[at]
            out[open_at[hit]] = self.starts[level] + self.ranks[level][at[hit]]
            open_at = open_at[~hit]
        if self._rest_at:
            for i in open_at:
                out[i] = self._rest_at.get(digests[i].tobytes(), -1)
        return out


class Archive:
    """Slots of whole digests and winner locators behind a perfect hash."""

    def __init__(self, digests: np.ndarray, winners: np.ndarray, counts: np.ndarray):
        self.hash = PerfectHash(digests)
        at = self.hash.slots(digests)
        self.digests, self.winners, self.counts = np.empty_like(digests), np.empty_like(winners), np.empty_like(counts)
        self.digests[at], self.winners[at], self.counts[at] = digests, winners, counts

    def lookup(self, digests: np.ndarray) -> np.ndarray:
        """The slot of every member, -1 for strangers: the bytes in the slot decide."""
        at = self.hash.slots(digests)
        if not len(self.digests):
            return np.full(len(digests), -1, np.int64)
        same = (at >= 0) & (self.digests[at] == digests).all(axis=1)
        return np.where(same, at, -1)


def text_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the SHA-256 (binary) of each whole text, A-Z lower-cased and nothing else."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            out = [hashlib.sha256((t.as_py() or b"").lower()).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["key", "digest"])

    kind = dict(docs.select(F.col(key).alias("key")).dtypes)["key"]
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(digest, f"key {kind}, digest binary")


def _grouped(digests: DataFrame) -> DataFrame:
    return digests.groupBy("digest").agg(F.max("key").alias("winner"), F.count("*").alias("n"))


def _array(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), np.uint8).reshape(-1, 32)


def dedup_groups(new: DataFrame, archive: DataFrame, shard_digests: int = SHARD_DIGESTS) -> DataFrame:
    """digest, winner, n for every distinct digest of two tables of (key, digest).

    Both are grouped first (a partial aggregate, so a digest that a third of the rows
    share costs one row per task); what a shard holds is distinct and evenly dealt, at
    most about `shard_digests` of either table.
    """
    old, fresh = saved(_grouped(archive), "archive"), saved(_grouped(new), "fresh")
    bits = max(0, math.ceil(math.log2(max(1, old.count() / shard_digests, fresh.count() / shard_digests))))
    shard = lambda df: df.withColumn("shard", F.shiftright(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), 32 - bits) if bits else F.lit(0).cast("long"))

    def merged(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        number = lambda s: s.astype("Int64").fillna(_NONE).to_numpy(np.int64)
        index = Archive(_array(a["digest"]), number(a["winner"]), a["n"].to_numpy(np.int64))
        asked, winners, counts = _array(b["digest"]), number(b["winner"]), b["n"].to_numpy(np.int64)
        at = index.lookup(asked)
        member = at >= 0
        index.counts[at[member]] += counts[member]
        index.winners[at[member]] = np.maximum(index.winners[at[member]], winners[member])
        won = np.concatenate([index.winners, winners[~member]])
        return pd.DataFrame({
            "digest": [x.tobytes() for x in index.digests] + [x.tobytes() for x in asked[~member]],
            "winner": pd.Series(won, dtype="Int64").mask(won == _NONE),
            "n": np.concatenate([index.counts, counts[~member]]),
        })

    return shard(old).groupBy("shard").cogroup(shard(fresh).groupBy("shard")).applyInPandas(merged, "digest binary, winner long, n long")


def exact_dedup(new: DataFrame, archive: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of both tables."""
    digests = saved(text_digests(archive, key, text).withColumn("old", F.lit(True)).unionByName(text_digests(new, key, text).withColumn("old", F.lit(False))), "digests")
    groups = saved(dedup_groups(digests.where("not old"), digests.where("old")), "groups")
    joined = join_groups(digests.drop("old"), groups, "digest", "n", carry=True)
    return joined.select(
        F.col("key").alias(key), F.col("winner").alias("keep_id"), F.col("n").alias("group_size"),
        F.col("key").eqNullSafe(F.col("winner")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def dedup_table(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One table deduped in full: half of it, by a hash of the id, is the archive, the rest arrives."""
    old = F.pmod(F.xxhash64(key), F.lit(2)) == 1
    return exact_dedup(docs.where(~old), docs.where(old), key)


DEDUP_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
