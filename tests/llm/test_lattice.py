import re
import zlib
from collections import Counter
from math import isclose, log, log10

import public_tokenizers
import pytest

from goldseam.llm import lattice

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def all_ways(s, weights):
    return (1.0 if not s else 0.0) + sum(weights[s[:i]] * all_ways(s[i:], weights) for i in range(1, len(s) + 1) if s[:i] in weights)


def test_forward_recursion_sums_all_segmentations(monkeypatch):
    weights = {lattice.SPACE: 0.1, lattice.SPACE + b"a": 0.2, b"a": 0.1, b"b": 0.15, b"ab": 0.05, b"ba": 0.07, lattice.SPACE + b"ab": 0.03}
    logs = {k: log(v) for k, v in weights.items()}
    for word in (b"a", b"abab", b"bbaab"):
        assert isclose(lattice.likelihood(word, logs, lattice.reaches(logs)), log(all_ways(lattice.SPACE + word, weights)))
    for cut in (1, 2, 3, 5):
        monkeypatch.setattr(lattice, "CUT", cut)
        assert isclose(lattice.likelihood(b"abababbaab", logs, lattice.reaches(logs)), log(all_ways(lattice.SPACE + b"abababbaab", weights)))
    assert lattice.likelihood(b"z", logs, lattice.reaches(logs)) == float("-inf")


@pytest.mark.parametrize("block", [1 << 24, 10])
def test_against_brute_force(spark, docs, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK_BYTES", block)
    rows = [(0, "The the cat"), (1, "a CAT sat"), (2, None), (3, ""), (4, "É é zzqx \x0b\n cat"), (5, "日本 the"), (6, "word " * 3000), (7, "unseen thing"), (8, "▁ mark"), (9, "x" * 3000), (9, "x")]
    got = sorted((tuple(r) for r in lattice.score(docs([*rows, (None, "null")]), MODEL).collect()), key=repr)
    tokens = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [None]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    rows = [*rows, (None, "null")]
    train = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(train.values()), len(train)
    want = []
    for i, t in rows:
        w = tokens(t)
        want.append((i, held(i), len(w), sum(x in train for x in w), n, sum(log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    want.sort(key=repr)
    key = lambda r: (repr(r[0]), r[2])
    for g, x in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == x[:5] and isclose(g[5], x[5], rel_tol=1e-9)
        assert g[6] < 0
    assert any(held(i) for i, _ in rows)


def test_long_word_in_bounded_memory():
    import tracemalloc

    weights = {lattice.SPACE: -1.0, b"a": -2.0, b"aa": -3.0, b"ab": -3.0, b"b": -2.0, b"a" * 30: -9.0}
    reach = lattice.reaches(weights)
    word = b"ab" * 500_000
    tracemalloc.start()
    assert lattice.likelihood(word, weights, reach) < 0
    assert tracemalloc.get_traced_memory()[1] < 2 << 20
    tracemalloc.stop()


def test_scores_are_those_of_the_lattice(spark, docs):
    """score against a sum over all segmentations of the words, with weights recounted here."""
    rows = [(0, "ab the"), (1, "the abc"), (2, "The cat"), (3, "ab"), (6, "abc")]
    sp, train, ends = lattice.processor(MODEL), Counter(), 0
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            ends += 1
            for w in t.lower().split():
                train.update(sp.encode(w))
    vocabulary = lattice.pieces(MODEL)
    train[vocabulary[lattice.END]] = ends
    mass = sum(train[i] for i in vocabulary.values()) + 0.5 * len(vocabulary)
    weights = {p: (train[i] + 0.5) / mass for p, i in vocabulary.items()}
    got = {r["doc_id"]: r["score"] for r in lattice.score(docs(rows), MODEL).collect()}
    for i, t in rows:
        want = sum(log10(all_ways(lattice.SPACE + w.encode(), weights)) for w in t.lower().split()) + log10(weights[lattice.END])
        assert isclose(got[i], want, rel_tol=1e-9)


def test_likelier_texts_score_higher(spark, docs):
    rows = [(i, "the cat sat on the mat") for i in range(40)] + [(1000, "the cat"), (1001, "zqj xkw")]
    got = {r["doc_id"]: r["score"] for r in lattice.score(docs(rows), MODEL).collect()}
    assert got[1000] > got[1001]


def test_empty_table(spark, docs):
    assert lattice.score(docs([]), MODEL).count() == 0


def test_short_words_sum_up_plain_probabilities():
    """Words that can't underflow are scored without logarithms, the others as before."""
    logs = {b"a": -3.0, b"b": -20.0, b"ab": -2.0, lattice.SPACE: -1.0}
    reach, plain = lattice.reaches(logs), lattice.chances(logs)
    assert plain[1] == 32
    for word in (b"a", b"abab", b"z", b"", b"ab" * 14, b"b" * 29, b"b" * 30, b"b" * 5000):
        assert isclose(lattice.likelihood(word, logs, reach, plain), lattice.likelihood(word, logs, reach))
