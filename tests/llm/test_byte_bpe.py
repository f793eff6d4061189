import hashlib
import random
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken
from brindle.llm import byte_bpe as B

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    return B.Coder(Path(PATH).read_bytes(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(coder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.fst.ranks, special_tokens={})


def texts():
    rng = random.Random(9)
    yield from ("", "a" * 20_000, "ab" * 3000, " " * 3000, "́", "don't  stop\n\n\nnow 12345", "<|endoftext|>")
    for _ in range(4000):
        kind = rng.randrange(4)
        yield "".join(
            chr(rng.choice((rng.randrange(32, 127), rng.randrange(0xA0, 0x600), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0x1F300, 0x1F700)))) if kind == 0
            else rng.choice("ab 's\n\tt\x1c\x85 ") if kind == 1 else chr(rng.randrange(97, 123)) if kind == 2 else rng.choice(("the", " th", "ing", "tion", ".", "0", "é"))
            for _ in range(rng.randrange(40))
        )


def test_equals_the_library_and_decodes(coder, reference):
    for t in texts():
        ids = coder.encode(t)
        assert ids == reference.encode_ordinary(t)
        assert coder.decode(ids) == t.encode()


def test_pairs_go_as_merging_says(coder):
    fst, rng = coder.fst, random.Random(1)
    ids = list(fst.bytes_of)
    for _ in range(20_000):
        a, b = rng.choice(ids), rng.choice(ids)
        assert fst.goes(a, b) == ([fst.ranks[x] for x in fst.merged(fst.bytes_of[a] + fst.bytes_of[b])] == [a, b])


def test_small_memory_changes_nothing(coder, reference, monkeypatch):
    for name, least in (("STATES", 2000), ("PAIRS", 50), ("PIECES", 50)):
        monkeypatch.setattr(B, name, least)
    small = B.Coder(Path(PATH).read_bytes(), public_tokenizers.PATTERN)
    for t in list(texts())[100:1100]:
        assert small.encode(t) == reference.encode_ordinary(t)


def test_streamed_decoding_is_whole_characters_and_replaces_errors(coder):
    rng = random.Random(3)
    single = {b[0]: i for b, i in coder.fst.ranks.items() if len(b) == 1}
    decoder = B.StreamDecoder(coder.fst.bytes_of)
    for _ in range(3000):
        data = bytes(rng.choice((rng.randrange(256), 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x41, 0xC3, 0xA9, 0xED)) for _ in range(rng.randrange(12)))
        out = b""
        for byte in data:
            part = decoder.feed([single[byte]])
            part.decode()
            out += part
        out += decoder.end()
        assert out == data.decode("utf-8", "replace").encode()


def test_table(documents, reference):
    rows = [(1, "Hello world"), (1, "Hello world"), (2, None), (3, ""), (None, "é" * 50_000)]
    found = B.encoded(documents(rows), PATH, public_tokenizers.PATTERN).collect()
    assert len(found) == 5
    for r in found:
        t = next(t or "" for k, t in rows if k == r.doc_id)
        ids = reference.encode_ordinary(t)
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == t
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert B.encoded(documents([]), PATH, public_tokenizers.PATTERN).count() == 0
