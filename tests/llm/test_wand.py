import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from goldseam.llm.wand import build_index, search, wand

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, k):
    """(item, rank, doc, score) by scoring every document that has an id for every item."""
    held = [(i, Counter(TERMS.findall(lower(t)))) for i, t in docs if i is not None]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in TERMS.findall(lower(text)) if w in c)
            if s > 0:
                scores.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def items_of(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "item_id long, text string, score int")


@pytest.mark.parametrize("shard_docs", [3, 1000])
def test_equals_scoring_every_document(spark, docs, shard_docs):
    rng = np.random.default_rng(5)
    words = np.array([f"W{i}é" if i % 7 == 0 else f"w{i}" for i in range(60)])
    share = 1 / np.arange(1, 61)
    table = [(i, " ".join(rng.choice(words, rng.integers(0, 40), p=share / share.sum()))) for i in range(120)]
    table += [(500 + i, table[4][1]) for i in range(30)]  # copies: ties go to smaller ids
    table += [(7, "w1 w2, w3"), (None, "w1 w1"), (901, None), (902, ""), (903, "., !"), (904, "w59 " * 5000)]
    items = [(1, "w3 W40 w55 w59 w59"), (2, "W0é w1 nowhere"), (3, None), (4, "?"), (1, "w50")]
    got = rows(search(build_index(docs(table), shard_docs=shard_docs), items_of(spark, items), 7, most_asked=4))
    assert got == brute(table, items, 7)


def test_empty_tables(spark, docs):
    index = build_index(docs([(1, "a b")]))
    assert rows(search(index, items_of(spark, []))) == []
    none = build_index(docs([]))
    assert rows(search(none, items_of(spark, [(1, "a")]))) == []
    with pytest.raises(ValueError):
        search(index, items_of(spark, [(1, "a")]), 0)


def test_ids_of_any_kind(spark):
    table = spark.createDataFrame([("x", "red fox"), ("a", "red fox"), ("m", "blue")], "doc_id string, text string")
    got = rows(search(build_index(table), items_of(spark, [(1, "fox")])))
    assert [(r[1], r[2]) for r in got] == [(1, "a"), (2, "x")]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 5))
def test_heap_equals_sorting_all(seed, k):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 3000))
    lists, score = [], np.zeros(n, np.int64)
    for _ in range(int(rng.integers(1, 9))):
        places = np.flatnonzero(rng.random(n) < rng.choice([0.9, 0.2, 0.01])).astype("<i4")
        if len(places):
            impacts, weight = rng.integers(1, 50, len(places)), int(rng.integers(1, 100))
            lists.append((weight, int(impacts.max()), places, impacts))
            score[places] += weight * impacts
    ids = list(range(10, 10 + n))
    heap, _ = wand(lists, n, k, [], ids)
    assert heap == sorted((-int(s), i) for s, i in zip(score, ids, strict=True) if s)[:k]


def test_most_documents_are_skipped():
    """A frequent term alone can't reach the threshold that a rare one has set."""
    n = 100_000
    often, rare = np.arange(n, dtype="<i4"), np.arange(0, n, 1000, dtype="<i4")
    lists = [(1, 9, often, np.full(n, 9)), (100, 9, rare, np.full(len(rare), 9))]
    heap, evaluated = wand(lists, n, 5, [(-909, i) for i in range(-5, 0)], list(range(n)))
    assert [i for _, i in heap] == [-5, -4, -3, -2, -1] and evaluated == len(rare)
