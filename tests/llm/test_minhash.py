import random

import numpy as np
import pytest

from goldseam.llm import minhash


def brute(rows, n, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[x] for b in sets[y]):
                p, q = sorted((find(x), find(y)))
                root[q] = p
    return sorted((i, len(s), find(i), find(i) == i) for i in ids for s in sets[i])


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows, texts = [], []
    for i in range(n):
        kind = r.random()
        if texts and kind < 0.6:
            w = r.choice(texts).split(" ")
            for _ in range(r.randint(0, max(1, len(w) // 12))):
                w[r.randrange(len(w))] = r.choice(words)
        else:
            w = r.choices(words, k=r.randint(1, 120))
        texts.append(" ".join(w))
        rows.append((i * 3 % 1009, texts[-1].upper() if kind < 0.1 else texts[-1].replace(" ", r.choice([" ", "\n\x0b"]))))
    return rows


@pytest.mark.parametrize("n, blocks", [(2, (2048, 2000)), (5, (7, 3))])
def test_against_brute_force(spark, docs, monkeypatch, n, blocks):
    monkeypatch.setattr(minhash, "BLOCK", blocks[0])
    monkeypatch.setattr(minhash, "MEMBERS", blocks[1])
    monkeypatch.setattr(minhash, "EXACT", blocks[0])
    rows = [*corpus(n, 250), (2001, None), (2002, ""), (2003, " \n"), (2004, "one"), (2005, "ONE"), (2006, "a\xa0b"), (2007, "long text " * 20000)]
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs(rows), n).collect())
    assert got == brute(rows, n)


def test_null_ids_and_repeated_rows(spark, docs):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "a b c"), (3, None)]
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs(rows), 2).collect()), key=repr)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (2, 2, 1, False), (3, 0, 3, True)], key=repr)


def test_empty_table(spark, docs):
    assert minhash.near_duplicates(docs([])).count() == 0


def test_estimates_correct_for_collisions():
    r = np.random.default_rng(1)
    errors = []
    for j in (0.5, 0.8, 0.9):
        for _ in range(30):
            union = r.integers(0, 1 << 63, 1000).astype(np.uint64)
            common, side = int(1000 * j), (1000 - int(1000 * j)) // 2
            a, b = union[: common + side], np.concatenate([union[:common], union[common + side :]])
            x, y = (minhash.pack(minhash.minima(np.sort(s), minhash.PERMUTATIONS)) for s in (a, b))
            errors.append(minhash.estimate(minhash.PERMUTATIONS - float(minhash._differing(x, y))) - j)
    assert abs(np.mean(errors)) < 0.005 and np.max(np.abs(errors)) < 0.1
