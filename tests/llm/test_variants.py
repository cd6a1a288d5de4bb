import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from goldseam.llm.variants import apart_by_one, count_words, variants


def one_edit(a, b):
    """By trying all edits of the longer one."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, length=6, often=5, times=5):
    words = {w: n for w, n in counts.items() if len(w) >= length and n >= often}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@settings(max_examples=300, deadline=None)
@given(st.text("abé", max_size=6), st.text("abé", max_size=6))
def test_distance(a, b):
    assert apart_by_one(a, b) == one_edit(a, b)


def words_of(seed, n, letters, longest):
    rng = np.random.default_rng(seed)
    out = Counter()
    for _ in range(n):
        w = "".join(rng.choice(list(letters), rng.integers(6, longest + 1)))
        out[w] += int(rng.integers(1, 200))
        i = rng.integers(0, len(w))
        for near in (w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "ÿ" + w[i + 1 :]):
            if rng.random() < 0.6:
                out[near] += int(rng.integers(1, 30))
    return out


@pytest.mark.parametrize(("seed", "letters", "group", "shard"), [(1, "ab", 50_000, 200_000), (2, "abcdeé", 50_000, 50), (3, "abc", 6, 100)])
def test_equals_comparing_all_words(spark, seed, letters, group, shard):
    """Two letters fill one node with many words; a small group makes segments longer; small shards scan words in several tasks."""
    counts = words_of(seed, 250, letters, 10)
    table = spark.createDataFrame([(w, n, 1) for w, n in counts.items()], "word string, n long, key int")
    assert rows(variants(table, group=group, shard=shard)) == brute(counts)


def test_words_that_share_a_half_with_a_third_of_all(spark):
    """A hot half in front and one behind, split by the other code points."""
    rng = np.random.default_rng(7)
    counts = Counter({"prefix" + "".join(rng.choice(list("abcd"), 6)): int(rng.integers(5, 500)) for _ in range(300)})
    counts |= {"".join(rng.choice(list("abcd"), 6)) + "suffix": int(rng.integers(5, 500)) for _ in range(300)}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows(variants(table, group=20, shard=200)) == brute(counts)


def test_ways_of_forms_and_ties(spark):
    counts = {"abcdef": 5, "abcdeg": 25, "abcdhg": 125, "abcihg": 625, "jbcdef": 25, "zzzzzz": 4, "short": 1000, "lonely": 9, "x" * 3000: 5, "x" * 2999 + "y": 50}
    table = spark.createDataFrame([*counts.items(), (None, 50), ("nulled", None)], "word string, n long")
    got = {r[0]: r for r in rows(variants(table))}
    assert sorted(got.values()) == brute(counts)
    assert got["abcdef"][1:3] == ("abcdeg", "abcihg") and got["lonely"][1:3] == (None, "lonely") and "zzzzzz" not in got
    assert rows(variants(table.limit(0))) == []


def test_runs_are_counted_over_whole_texts(spark, docs):
    rng = np.random.default_rng(4)
    table = [(i, " ".join(rng.choice(["Straße", "NAÏVE", "naïve", "ABCdef", "x-ray", "œuvre", "aßb×c÷d"], 400))) for i in range(60)]
    table += [(None, "Straße Straße"), (3, None), (4, ""), (5, "a" * 300_000 + " " + "b1b"), (5, "a" * 300_000)]
    want = Counter()
    for i, text in table:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for w in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            want[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    got = dict(tuple(r) for r in count_words(docs(table)).collect())
    assert got == dict(want)
    assert count_words(docs([])).collect() == []
