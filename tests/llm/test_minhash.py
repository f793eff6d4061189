import random

import numpy as np
from brindle.llm import minhash as M

WORDS = [a + b for a in "bcdfglmnprst" for b in ("a", "e", "i", "o", "u", "an", "er", "ol")]


def brute(rows, size, percent=80):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs of word tuples."""

    def shingles(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            words = words.replace(c, " ")
        words = [w for w in words.split(" ") if w]
        return {tuple(words)} if 0 < len(words) < size else {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}

    sets = [(k, shingles(t)) for k, t in rows]
    root = {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, sa) in enumerate(sets):
        for b, sb in sets[:i]:
            if sa and sb and 100 * len(sa & sb) >= percent * len(sa | sb):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(k, len(s), find(k), find(k) == k) for k, s in sets]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS) + "x"
    return words


def corpus(seed):
    rng = random.Random(seed)
    rows, ids = [], iter(rng.sample(range(100_000), 5000))
    for _ in range(40):
        base = [rng.choice(WORDS) for _ in range(rng.choice((1, 2, 3, 8, 40, 200)))]
        for n in range(rng.randrange(1, 9)):
            rows.append((next(ids), " ".join(edited(rng, base, rng.randrange(0, 1 + len(base) // 12)))))
    hub = [rng.choice(WORDS) for _ in range(150)]
    rows += [(next(ids), " ".join(edited(rng, hub, rng.randrange(0, 13)))) for _ in range(120)]  # many near the threshold, in chains
    rows += [(next(ids), t) for t in (None, "", " \n\t", "Ba Be", "ba\x0bbe", "ba be", "É é", "é é")]
    rows += [(next(ids), "one two three four five six")] * 1 + [(next(ids), "ONE two\tthree four  five six")]
    return rows


def test_against_all_pairs(documents, same):
    for size in (2, 5):
        rows = corpus(size)
        found = M.near_duplicates(documents(rows), size=size).select("doc_id", "n_shingles", "component_id", "kept")
        expected = [(r[2], r[0], r[3], r[1]) for r in brute(rows, size)]
        assert same(found, expected)


def test_null_ids_empty_table_and_repeated_rows(documents):
    assert M.near_duplicates(documents([])).count() == 0
    found = M.near_duplicates(documents([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (3, None)])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in found) == [(0, 0, True), (3, 3, True), (7, 7, True), (7, 7, True)]


def test_sketch_estimates_and_never_turns_links_away():
    rng = np.random.default_rng(3)
    for share in (0.8, 0.9, 0.97):
        errors = []
        for _ in range(60):
            n = 2000
            both = int(n * share)
            pool = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
            a, b = (M.odd_sketch(M.minhashes(x)) for x in (pool[:n], pool[n - both :]))
            differing = (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
            true = both / (2 * n - both)
            if true >= 0.8:
                assert differing <= M.most_differing()
            errors.append(M.sketch_similarity(differing) - true)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_long_text(documents):
    long = " ".join(str(i) for i in range(60_000))
    found = {r.doc_id: r.component_id for r in M.near_duplicates(documents([(1, long), (2, long + " end"), (3, "short text of six words here")])).collect()}
    assert found == {1: 1, 2: 1, 3: 3}
