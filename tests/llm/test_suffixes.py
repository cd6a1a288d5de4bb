import random
from collections import Counter

import numpy as np
import pytest

from goldseam.llm import suffixes


def brute(rows, length):
    seen = Counter(b[i : i + length] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8)])))
        out.append((i, len(b), [tuple(x) for x in edge.reshape(-1, 2).tolist()], bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])))
    return sorted(out, key=repr)


def corpus(seed, length):
    r = random.Random(seed)
    alphabet = ["ab", "abcdefgh é"][seed % 2]
    passages = ["".join(r.choices(alphabet, k=r.randint(length - 5, 3 * length))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = ["".join(r.choices(alphabet, k=r.randint(0, 2 * length))) for _ in range(r.randint(1, 3))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 3)
            parts.insert(r.randint(0, len(parts)), p[a : len(p) - r.randint(0, a)])
        rows.append((i, "".join(parts)))
    rows += [(i + 100, t) for i, t in rows[:5]]
    return [*rows, (200, None), (201, ""), (202, "a" * 5 * length), (203, "ab" * 3 * length), (204, "x" * length), (None, rows[9][1]), (9, rows[9][1]), (205, "\0" * length), (206, "\0" * (length - 1) + "y")]


@pytest.mark.parametrize("seed, length, hot", [(1, 40, 20000), (2, 40, 3), (3, 64, 20000), (5, 101, 2)])
def test_against_brute_force(spark, docs, monkeypatch, seed, length, hot):
    monkeypatch.setattr(suffixes, "PART", hot)
    monkeypatch.setattr(suffixes, "BUCKET", 50)
    monkeypatch.setattr(suffixes, "SORTED", 32)
    rows = corpus(seed, length)
    got = suffixes.remove_repeats(docs(rows), length).collect()
    have = sorted(((r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in got), key=repr)
    assert have == brute(rows, length)


def listed(got):
    return sorted(((x["doc_id"], x["n_bytes"], [tuple(s) for s in x["spans"]], bytes(x["kept"])) for x in got.collect()), key=repr)


def test_common_lead_is_split(spark, docs, monkeypatch, tmp_path):
    monkeypatch.setattr(suffixes, "PART", 50)
    monkeypatch.setattr(suffixes, "SORTED", 100)
    monkeypatch.setattr(suffixes, "BUCKET", 10**6)
    own, folder = suffixes.repeated, str(tmp_path)

    def watched(group, before, after, length):
        import uuid

        with open(f"{folder}/{uuid.uuid4()}", "w") as f:
            f.write(f"{np.bincount(group).max()}")
        return own(group, before, after, length)

    monkeypatch.setattr(suffixes, "repeated", watched)
    r = random.Random(6)
    some = lambda k, alphabet: "".join(r.choices(alphabet, k=k))
    early, hot, longer = [some(60, "ABCDE") for _ in range(8)], some(38, "uvwxyz"), some(70, "klmnop")
    rows = [(i, some(50, "0123456789") + early[i % 8] + some(50, "0123456789")) for i in range(24)]
    rows += [(100 + i, some(50, "0123456789") + hot + some(50, "0123456789")) for i in range(300)]
    rows += [(500 + i, some(r.randint(0, 50), "0123456789") + longer + some(r.randint(0, 50), "0123456789")) for i in range(300)]
    assert listed(suffixes.remove_repeats(docs(rows), 40)) == brute(rows, 40)
    assert max(int(f.read_text()) for f in tmp_path.iterdir()) <= 50


def test_periodic_texts_have_few_anchors(spark, docs, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 900)
    r = random.Random(7)
    some = lambda k: "".join(r.choices("abcdefgh", k=k))
    unit = some(17)
    rows = [(1, some(70) + "z" * 1500 + some(60)), (2, "z" * 45 + some(70)), (3, some(30) + unit * 40 + "!" + unit * 30), (4, some(20) + unit * 3 + some(9)), (5, some(600)), (6, some(50) + "zz" * 21)]
    assert listed(suffixes.remove_repeats(docs(rows), 40)) == brute(rows, 40)
    monkeypatch.undo()
    assert sum(len(p) for p, _ in suffixes.anchors(b" " * (4 << 20))) < 4 * 4 * 400
    assert sum(len(p) for p, _ in suffixes.anchors(unit.encode() * 200_000)) < 4 * 4 * 400


def test_anchors_do_not_depend_on_segments(monkeypatch):
    r = random.Random(4)
    text = "".join(r.choices("abc ", k=20000)).encode()
    places = lambda: np.concatenate([p for p, _ in suffixes.anchors(text, 100)])
    whole = places()
    monkeypatch.setattr(suffixes, "SEGMENT", 700)
    assert np.array_equal(whole, places())


def test_multikey_order():
    r = np.random.default_rng(1)
    words, groups = r.integers(0, 3, (500, 6)), r.integers(0, 4, 500)
    want = sorted(range(500), key=lambda i: (groups[i], tuple(words[i]), i))
    got = suffixes.multikey_order(words, groups)
    assert [(groups[i], *words[i]) for i in got] == [(groups[i], *words[i]) for i in want]


def test_empty_table(spark, docs):
    assert suffixes.remove_repeats(docs([])).count() == 0
