"""Byte-level BPE by a lazily determinised finite-state transducer.

An encoding is right exactly if each of its tokens encodes to itself and every two
neighbours, encoded together, stay those two. That makes encoding a nondeterministic
transducer: a state is the last whole token and the place in the trie of tokens of the
one being read; it may finish the token at each byte, if it goes with the last. Over one
input the hypotheses differ in where their last whole token ends, so there are at most as
many as the longest token has bytes. The transducer is determinised on demand: a state of
it is the set of hypotheses with the tokens they still owe, and the tokens that all agree
on are emitted as soon as they do, within the lookahead of the longest token. Transitions
are remembered by state and byte; their memory is bounded and starts anew when it is full.

Decoding is streamed: the bytes of ids run through a state machine of UTF-8, lifted to
whole tokens, which hands on text up to the last whole character and replaces what can't
be UTF-8.

Nulls: a null text counts as empty and has no ids. Repeated rows are encoded each. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import unicodedata
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces of text in a generation of a worker's memory, states and pair verdicts it keeps;
#: together about 500 MB.
PIECES, STATES, PAIRS = 500_000, 100_000, 300_000
REMEMBERED = 48


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """The ranks of a rank file, given its bytes."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}


class Transducer:
    """Encodes byte strings by the ranks of merged tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        # The trie: node -> {byte: node}; the token that ends at a node and encodes to itself, or -1.
        self.next: list[dict[int, int]] = [{}]
        self.token = [-1]
        for word, rank in ranks.items():
            node = 0
            for c in word:
                child = self.next[node].get(c)
                if child is None:
                    child = self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.token.append(-1)
                node = child
            self.token[node] = rank
        self.pairs: dict[int, bool] = {}
        # Tokens that encode to themselves, and of each how its last merge parts it.
        self.whole, self.parts = set(), {}
        for word, rank in ranks.items():
            if len(word) == 1:
                self.whole.add(rank)
            elif len(two := self.merged(word, 2)) == 2 and two[0] + two[1] == word:
                self.whole.add(rank)
                self.parts[rank] = ranks[two[0]], ranks[two[1]]
        self.token = [t if t in self.whole else -1 for t in self.token]
        self.spines: tuple[dict[int, list[int]], dict[int, list[int]]] = {}, {}
        self._reset()

    def merged(self, word: bytes, until: int = 1) -> list[bytes]:
        """The plain merge loop, lowest rank first, down to `until` parts; only to take tokens apart."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > until:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spine(self, token: int, side: int) -> list[int]:
        """What stands at a token's left (0) or right (1) edge from its byte to itself, as merges go on."""
        found = self.spines[side].get(token)
        if found is None:
            inner = self.parts.get(token)
            found = self.spines[side][token] = [*(self.spine(inner[side], side) if inner else ()), token]
        return found

    def goes(self, a: int, b: int) -> bool:
        """Whether token b may follow token a: nothing merges across their border while they are built.

        Merges happen by rank. The two edges grow step by step; before each step the
        merge across must not be due, and at equal ranks the one further left is first.
        """
        at = a << 32 | b
        found = self.pairs.get(at)
        if found is not None:
            return found
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        left, right, i, j = self.spine(a, 1), self.spine(b, 0), 0, 0
        ranks, text, never = self.ranks, self.bytes_of, 1 << 62
        while True:
            across = ranks.get(text[left[i]] + text[right[j]], never)
            grow_left = left[i + 1] if i + 1 < len(left) else never
            grow_right = right[j + 1] if j + 1 < len(right) else never
            if across < grow_left and across <= grow_right and across < never:
                found = False
                break
            if grow_left == never and grow_right == never:
                found = True
                break
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1
        self.pairs[at] = found
        return found

    def _reset(self):
        """The start: nothing read. A hypothesis is (owed tokens, last token, trie node).

        A state is a dict: its moves by byte, and its hypotheses at -1. States can be in cycles, so they are collected here and
        nowhere else (a task turns the automatic collection off, which would go
        through all states again and again).
        """
        start = (((), -1, 0),)
        self.known = None
        gc.collect()
        self.start = {-1: start}
        self.known = {start: self.start}

    def _step(self, state: dict, byte: int) -> tuple[dict, tuple[int, ...]]:
        after: list[tuple[tuple[int, ...], int, int]] = []
        trie, token_at, pairs = self.next, self.token, self.pairs
        for owed, last, node in state[-1]:
            child = trie[node].get(byte)
            if child is None:
                continue
            if trie[child]:
                after.append((owed, last, child))
            token = token_at[child]
            if token >= 0:
                may = True if last < 0 else pairs.get(last << 32 | token)
                if may is None:
                    may = self.goes(last, token)
                if may:
                    after.append(((*owed, token), token, 0))
        if not after:
            raise ValueError("bytes that no token covers")
        out = after[0][0]
        for owed, _, _ in after:
            while out and owed[: len(out)] != out:
                out = out[:-1]
            if not out:
                break
        if k := len(out):
            after = [(owed[k:], last, node) for owed, last, node in after]
        key = tuple(after)
        to = self.known.get(key)
        if to is None:
            to = self.known[key] = {-1: key}
        move = state[byte] = to, out
        return move

    def encode(self, word: bytes) -> list[int]:
        """The ids of one piece of text (a match of the pattern)."""
        if len(self.known) > STATES:
            self._reset()
        state, ids = self.start, []
        if not word:
            return ids
        for byte in word[:-1]:
            move = state.get(byte)
            if move is None:
                move = self._step(state, byte)
            state, out = move
            if out:
                ids += out
        # At the end only the hypothesis counts that finishes a token there; no state is made for it.
        byte, trie, token_at = word[-1], self.next, self.token
        for owed, last, node in state[-1]:
            child = trie[node].get(byte)
            if child is not None and (token := token_at[child]) >= 0 and (last < 0 or self.goes(last, token)):
                ids += owed
                ids.append(token)
                return ids
        raise ValueError("bytes that no token covers")


def _utf8_step(state: tuple[int, int, int], byte: int) -> tuple[int, int, int] | None:
    """One byte of UTF-8. A state is (bytes to come, least and greatest next byte); None: not UTF-8 from here."""
    left, low, high = state
    if left:
        if not low <= byte <= high:
            return None
        return (left - 1, 0x80, 0xBF) if left > 1 else _START
    if byte < 0x80:
        return _START
    if 0xC2 <= byte <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= byte <= 0xEF:
        return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
    if 0xF0 <= byte <= 0xF4:
        return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
    return None


_START = (0, 0, 0)
_REPLACED = "�".encode()


class StreamDecoder:
    """Text from ids as they come: never part of a character, errors replaced."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.state, self.held = bytes_of, _START, b""
        #: Tokens that don't take the machine from its start to its start, or not without an error.
        self.partial = {i for i, b in bytes_of.items() if self._lift(_START, i, b"") != (b, _START, b"")}
        self.table = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        self.lifted: dict[tuple[tuple[int, int, int], int], tuple[bytes, tuple[int, int, int], int]] = {}

    def _lift(self, state: tuple[int, int, int], token: int, held: bytes) -> tuple[bytes, tuple[int, int, int], bytes]:
        """What a token emits in a state: bytes of whole characters, the state after, and what is held back."""
        out = bytearray()
        pending = bytearray(held)
        for byte in self.bytes_of[token]:
            after = _utf8_step(state, byte)
            if after is None:
                if pending:  # a character broken off; the byte may begin another
                    out += _REPLACED
                    pending.clear()
                    after = _utf8_step(_START, byte)
                if after is None:
                    out += _REPLACED
                    state = _START
                    continue
            pending.append(byte)
            state = after
            if state == _START:
                out += pending
                pending.clear()
        return bytes(out), state, bytes(pending)

    def feed(self, ids: Sequence[int]) -> bytes:
        """UTF-8 of the whole characters that are known now."""
        if self.state is _START and self.partial.isdisjoint(ids):
            return b"".join(map(self.table.__getitem__, ids))
        out = []
        for token in ids:
            if self.state is _START and not self.held:
                known = self.lifted.get(token)
                if known is None:
                    known = self.lifted[token] = self._lift(_START, token, b"")
                data, state, held = known
            else:
                data, state, held = self._lift(self.state, token, self.held)
            out.append(data)
            self.state, self.held = (_START if state == _START else state), held
        return b"".join(out)

    def end(self) -> bytes:
        """What is left: a character that broke off is replaced."""
        broken, self.state, self.held = bool(self.held), _START, b""
        return _REPLACED if broken else b""


class _Remembered(dict):
    """Ids of pieces of text, made when first asked for; what a generation never asks for is forgotten."""

    def __init__(self, encode):
        self.encode, self.before = encode, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.before.get(piece)
        if ids is None:
            ids = tuple(self.encode(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= REMEMBERED:
            self[piece] = ids
        return ids

    def age(self):
        if len(self) > PIECES:
            self.before = dict(self)
            self.clear()


#: Printable ASCII, the usual white space, and Latin letters and signs up to U+017F.
_PLAIN = "".join(map(chr, (*range(0x20, 0x7F), *range(0xA1, 0x180)))) + "\t\n\r"
_OTHER = re.compile(f"[^{re.escape(_PLAIN)}]")


def plain_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for plain texts, its letter and number properties written out; None if it has others."""
    letters, numbers = ("".join(c for c in _PLAIN if unicodedata.category(c)[0] == kind) for kind in "LN")
    known = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    return None if r"\p" in known else re.compile(known)


class Coder:
    """Encodes whole texts piece by piece and decodes ids again."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex

        self.fst = Transducer(read_ranks(ranks))
        self.find = regex.compile(pattern).findall
        self.plain = plain_pattern(pattern)
        self.known = _Remembered(self.fst.encode)
        self.decoder = StreamDecoder(self.fst.bytes_of)

    def encode(self, text: str) -> list[int]:
        self.known.age()
        plain = self.plain is not None and _OTHER.search(text) is None
        pieces = self.plain.findall(text) if plain else self.find(text)
        return list(chain.from_iterable(map(self.known.__getitem__, pieces)))

    def decode(self, ids: Sequence[int]) -> bytes:
        return self.decoder.feed(ids) + self.decoder.end()


_coders: dict[tuple[int, str], Coder] = {}


def coder_for(ranks: bytes, pattern: str) -> Coder:
    """This worker's coder; tasks that follow find it warm."""
    name = zlib.crc32(ranks), pattern
    if name not in _coders:
        _coders.clear()
        _coders[name] = Coder(ranks, pattern)
    return _coders[name]


def encoded(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 and (if asked for) ids and the decoded text of every row.

    The rank file is read on the driver and its bytes, which do not grow with the data, are sent.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())
    kind = dict(docs.select(F.col(key).alias("key")).dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # while this task runs
        try:
            yield from coded(batches)
        finally:
            gc.enable()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_for(sent.value, pattern)
        decimal = list(map(str, range(max(coder.fst.bytes_of) + 1)))
        for batch in batches:
            n, sha, back, all_ids, texts = [], [], [], [], []
            for t in batch.column(1):
                ids = coder.encode(t.as_py() or "")
                data = coder.decode(ids)
                n.append(len(ids))
                sha.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(data).hexdigest())
                if with_ids:
                    all_ids.append(ids)
                    texts.append(data.decode())
            columns, names = [batch.column(0), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)], ["key", "n_tokens", "ids_sha256", "decoded_sha256"]
            columns[2:] = [c.cast(pa.string()) for c in columns[2:]]
            if with_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
