"""Packing by minimum bin slack over the histogram of lengths.

Documents become ids and one end id; longer ones are cut into pieces of CAPACITY. What
matters for packing is how many pieces have each length, which is at most CAPACITY
numbers however many documents there are. Bin by bin, the largest length left goes in
first and a bitset subset-sum over the lengths left finds the fullest combination that
fits the rest (Gupta & Ho, 1999). A combination is taken as often as the counts allow, so
the number of searches follows the number of lengths, not of bins. Pieces of one length
are then numbered, and a number and a length say which bin and place is theirs.

Nulls: a null text counts as empty and is one end id; a null doc_id is kept as it is.
Repeated rows are packed each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources.tables import saved

CAPACITY = 4096
END_ID = 1
#: Words whose ids a worker remembers, before it starts anew, and of which length at most.
MEMORY = 250_000
REMEMBERED = 64
#: Pieces of one length that a task numbers, about.
SALTED = 100_000
_SPACE = " \t\n\r"
#: Characters for which the tokenizer's normaliser and splitter are known to be what is
#: done here: printable ASCII and the Latin letters and signs up to U+017F, but for one
#: capital whose lower case is two characters. None of them composes with another.
_PLAIN = "".join(chr(c) for c in (*range(0x20, 0x7F), *range(0xA1, 0x180)) if c != 0x130) + _SPACE
_LETTERS = "".join(c for c in _PLAIN if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in _PLAIN if unicodedata.category(c)[0] == "N")
_OTHER = re.compile(f"[^{re.escape(_PLAIN)}]")
_CHUNK = re.compile(f"[^{_SPACE}]+")
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACE}{_LETTERS}{_NUMBERS}]+")
#: Stands for the end of a word; no byte of UTF-8.
_END = b"\xff"


class _Remembered(dict):
    """Ids of words as bytes, made when first asked for."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) <= REMEMBERED:
            self[word] = ids
        return ids


class WordEncoder:
    """Ids of a lower-casing BPE whose words carry an end mark and whose merges follow their ids.

    White space parts words and is dropped, so a text is encoded word by word. Words of
    plain characters are merged by the vocabulary's ranks; any chunk with another
    character, or with one of the tokenizer's special strings, goes through the tokenizer itself.
    """

    def __init__(self, definition: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(definition)
        made = json.loads(definition)
        model, special = made["model"], made.get("added_tokens") or []
        if any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] or _CHUNK.fullmatch(x["content"]) is None for x in special):
            raise ValueError("special strings that depend on what is around them are not supported")
        self.special = re.compile("|".join(re.escape(x["content"]) for x in special) or "(?!)")
        end = model["end_of_word_suffix"]
        byte_of = {c: b for b, c in _byte_letters().items()}
        ranks = {}
        for token, i in model["vocab"].items():
            body, mark = (token[: -len(end)], _END) if token.endswith(end) else (token, b"")
            if all(c in byte_of for c in body):
                ranks[bytes(byte_of[c] for c in body) + mark] = i
        ranks.setdefault(_END, len(model["vocab"]))
        merge = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.words = _Remembered(lambda w: array("I", merge(w.encode() + _END)).tobytes())

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if len(self.words) > MEMORY:
            self.words.clear()
        special = self.special.search
        if _OTHER.search(text) is None and special(text) is None:
            return b"".join(map(self.words.__getitem__, _WORD.findall(text.lower())))
        out = []
        for chunk in _CHUNK.findall(text):
            if _OTHER.search(chunk) is None and special(chunk) is None:
                out += map(self.words.__getitem__, _WORD.findall(chunk.lower()))
            else:
                out.append(np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes())
        return b"".join(out)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it is printable, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


_encoders: dict[int, WordEncoder] = {}


def encoder_for(definition: bytes) -> WordEncoder:
    """This worker's encoder; tasks that follow find it warm."""
    name = zlib.crc32(definition)
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = WordEncoder(definition)
    return _encoders[name]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32 of every piece of every document, and its ids if asked for.

    The tokenizer's file is read on the driver and its bytes, which do not grow with the data, are sent.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    kind = dict(docs.select(F.col(key).alias("key")).dtypes)["key"]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_for(sent.value)
        for batch in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for r, t in enumerate(batch.column(1)):
                data = encode(t.as_py() or "") + end
                for p, i in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[i : i + 4 * capacity]
                    rows.append(r)
                    piece.append(p)
                    start.append(i // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["key", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def fullest(room: int, stock: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(length, how many) of a combination from `stock` that fills `room` as far as any can.

    stock: lengths, largest first, and how many there are. Bit s of a set says that a sum
    of s can be made; lengths come in by powers of two of their count, and the search
    stops once the room can be filled whole.
    """
    sets, taken, mask = [1], [], (1 << (room + 1)) - 1
    for length, count in stock:
        if length > room:
            continue
        count, lump = min(count, room // length), 1
        while count > 0:
            lump = min(lump, count)
            after = sets[-1] | (sets[-1] << (lump * length) & mask)
            if after != sets[-1]:
                sets.append(after)
                taken.append((length, lump))
            count -= lump
            lump *= 2
        if sets[-1] >> room & 1:
            break
    s, used = sets[-1].bit_length() - 1, {}
    for i in range(len(taken) - 1, -1, -1):
        if not sets[i] >> s & 1:
            length, lump = taken[i]
            used[length] = used.get(length, 0) + lump
            s -= length * lump
    return sorted(used.items(), reverse=True)


def bin_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Combinations in order: (how many bins, [(length, how many in each bin), largest first])."""
    left = {n: c for n, c in counts.items() if c > 0}
    plan = []
    order = sorted(left, reverse=True)
    while left:
        order = [n for n in order if n in left]
        big = order[0]
        left[big] -= 1
        rest = fullest(capacity - big, [(n, left[n]) for n in order if left[n]])
        left[big] += 1
        used = dict(rest)
        used[big] = used.get(big, 0) + 1
        times = min(left[n] // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        plan.append((times, sorted(used.items(), reverse=True)))
    return plan


def plan_rows(plan: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first number, number after the last, how many in a bin, first bin, offset)."""
    rows, begun, sequence = [], {}, 0
    for times, combination in plan:
        offset = 0
        for length, k in combination:
            at = begun.get(length, 0)
            begun[length] = at + k * times
            rows.append((length, at, begun[length], k, sequence, offset))
            offset += k * length
        sequence += times
    return rows


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of `cut` (saved; with key, piece, length) with sequence_id and offset.

    Pieces of one length are dealt to salts, counted, and numbered within a salt from
    what the salts before it hold, so no task sees all pieces of a length. A length has a salt
    for every SALTED pieces, by its own count.
    """
    spark = cut.sparkSession
    by_length = saved(cut.groupBy("length").agg(F.count("*").alias("__all")), "lengths")
    salts = F.floor(F.col("__all") / SALTED) + 1
    salted = cut.join(F.broadcast(by_length), "length").withColumn("__salt", F.pmod(F.xxhash64("key", "piece", "ids_crc32"), salts)).drop("__all")
    sizes = saved(salted.groupBy("length", "__salt").agg(F.count("*").alias("n")), "sizes")
    # At most `capacity` rows come to the driver, as many as are broadcast.
    counts = {r["length"]: r["__all"] for r in by_length.collect()}
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "__salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("length", "__salt").orderBy("key", "piece", "ids_crc32")
    numbered = salted.withColumn("__n", F.row_number().over(within)).join(bases, ["length", "__salt"]).withColumn("__number", F.col("__base") + F.col("__n") - 1)
    # As many rows as the plan has, which follows the number of lengths; Spark broadcasts it if it is small.
    places = spark.createDataFrame(plan_rows(bin_plan(counts, capacity)), "__length long, __from long, __to long, __k long, __bin long, __place long")
    here = (F.col("length") == F.col("__length")) & (F.col("__number") >= F.col("__from")) & (F.col("__number") < F.col("__to"))
    rest = F.col("__number") - F.col("__from")
    return numbered.join(places, here).select(
        *cut.columns, (F.col("__bin") + F.floor(rest / F.col("__k"))).cast("long").alias("sequence_id"), (F.col("__place") + rest % F.col("__k") * F.col("length")).cast("long").alias("offset")
    )


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece of every document and its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = saved(pieces(docs, tokenizer, capacity, end_id), "pieces")
    return pack(cut, capacity).withColumnRenamed("key", "doc_id")


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The packed sequences themselves: sequence_id, length, ids; a sequence holds `capacity` ids at most."""
    cut = saved(pieces(docs, tokenizer, capacity, end_id, with_ids=True), "pieces")
    placed = pack(cut, capacity).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.flatten(F.col("parts.ids"))
    return placed.select("sequence_id", F.size(ids).alias("length"), ids.alias("ids"))
