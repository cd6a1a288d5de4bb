import random
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest

from goldseam.llm import packing

VOCAB = public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(1)
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCAB)


def own_ids(text):
    return library().encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, pieces, window):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] > 0
        by_doc[p["doc_id"]].append((p["start"], ids, p["doc_tokens"]))
        by_seq[p["sequence_id"]].append((p["offset"], p["length"]))
    for i, text, _ in rows:
        parts = sorted(by_doc.pop(i))
        want = own_ids(text)
        assert sum((x[1] for x in parts), []) == want
        assert all(x[2] == len(want) for x in parts)
        assert [x[0] for x in parts] == [sum(len(y[1]) for y in parts[:k]) for k in range(len(parts))]
    assert not by_doc
    sizes = []
    for k in sorted(by_seq):
        at = 0
        for offset, length in sorted(by_seq[k]):
            assert offset == at
            at += length
        sizes.append(at)
    assert sorted(by_seq) == list(range(len(by_seq)))
    tail = [n for n in sizes if n != window]
    assert all(n & (n - 1) == 0 and n < window for n in tail) and len(set(tail)) == len(tail)
    return sizes


def rows(n, seed=1):
    r = random.Random(seed)
    words = ["the", "ouble", "é", "tion,", "x9", "<|endoftext|>", "new\nline", "  gap"]
    return [(i, " ".join(r.choices(words, k=r.randint(1, 60))), ["hot", "a", None, "b"][min(r.randint(0, 5), 3) if r.random() < 0.5 else 0]) for i in range(n)]


def test_each_id_once_in_full_windows(spark, docs):
    data = [*rows(80), (100, None, "a"), (101, "", "c"), (102, "word " * 3000, "long")]
    got = packing.pack(docs(data, "source string"), VOCAB, window=64, quantum=16, span=8).collect()
    check(data, got, 64)


def test_mixture_of_every_stretch_of_windows(spark, docs):
    data = [(i, "the word " * 40, "ab"[i % 4 == 0]) for i in range(200)]
    got = packing.pack(docs(data, "source string"), VOCAB, window=64, quantum=8, span=16).collect()
    sizes = check(data, got, 64)
    share = defaultdict(int)
    for p in got:
        if data[p["doc_id"]][2] == "b":
            share[p["sequence_id"]] += p["length"]
    full = [share[k] for k, n in enumerate(sizes) if n == 64]
    want = 64 * sum(share.values()) / sum(sizes)
    for k in range(len(full)):  # the deficit stays within a quantum or two over any prefix, across partitions too
        assert abs(sum(full[: k + 1]) - want * (k + 1)) <= 24


def test_target_proportions_until_a_source_runs_dry(spark, docs):
    data = [(i, "the word " * 40, "abc"[min(i % 8, 2)]) for i in range(400)]  # one in eight a, one in eight b
    got = packing.pack(docs(data, "source string"), VOCAB, window=64, quantum=8, span=16, targets={"a": 0.5, "b": 0.2}).collect()
    sizes = check(data, got, 64)
    took, total = {k: defaultdict(int) for k in "abc"}, defaultdict(int)
    for p in got:
        took[data[p["doc_id"]][2]][p["sequence_id"]] += p["length"]
        total[data[p["doc_id"]][2]] += p["length"]
    dry = int(total["a"] / 0.5) // 64  # then b and c share the windows as 0.2 to 0.3
    for k, share in (("a", 0.5), ("b", 0.2), ("c", 0.3)):
        have = 0
        for j in range(dry - 1):
            have += took[k][j]
            assert abs(have - 64 * share * (j + 1)) <= 24
    later = range(dry + 1, dry + 1 + int((total["b"] - 0.2 * 64 * dry) / 0.4) // 64 - 1)
    assert len(later) > 20 and not any(took["a"][j] for j in later)
    assert abs(sum(took["b"][j] for j in later) / (64 * len(later)) - 0.4) < 0.02
    assert sizes


def test_targets_must_leave_room(spark, docs):
    with pytest.raises(ValueError):
        packing.pack(docs([(1, "a", "x"), (2, "b", "y")], "source string"), VOCAB, targets={"x": 1.0})


def test_round_robin_empties_all_queues():
    took = list(packing.rounds({"a": 1000, "b": 300, "c": 7}, {"a": 1000 / 1307, "b": 300 / 1307, "c": 7 / 1307}, dict.fromkeys("abc", 0.0), 100, 10))
    assert sum(n for t in took for _, n in t) == 1307
    assert all(sum(n for _, n in t) == 100 for t in took[:-1])


def test_empty_table_and_many_sources(spark, docs):
    assert packing.pack(docs([], "source string"), VOCAB).count() == 0
    data = [(i, "a b", f"s{i}") for i in range(300)]
    check(data, packing.pack(docs(data, "source string"), VOCAB, window=32, span=4, quantum=4).collect(), 32)


def test_mixture_with_more_sources_than_queues(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "QUEUES", 4)
    names = ["hot"] * 300 + [f"s{i // 10}" for i in range(200)]  # each source in one clump of the input
    data = [(i, "the word " * 20, s) for i, s in enumerate(names)]
    got = packing.pack(docs(data, "source string"), VOCAB, window=64, quantum=8, span=16).collect()
    sizes = check(data, got, 64)
    took = defaultdict(lambda: defaultdict(int))
    for p in got:
        took[data[p["doc_id"]][2]][p["sequence_id"]] += p["length"]
    worst, longest = 0, max(p["doc_tokens"] for p in got)
    for of_source in took.values():
        share, have, want = sum(of_source.values()) / sum(sizes), 0, 0.0
        for k, n in enumerate(sizes):
            have, want = have + of_source[k], want + share * n
            worst = max(worst, abs(have - want))
    assert worst <= 2 * longest


def test_whole_tokens_of_many_queues():
    """A thousand queues, one that lasts longest at a tiny weight: no queue gives a token back, all add up, and all are close to their shares."""
    from goldseam.llm.packing import Mixture

    r = random.Random(2)
    q = {f"s{i:04}": r.randint(1, 5000) for i in range(1000)} | {"long": 400_000}
    weight = {k: r.random() for k in q} | {"long": 1e-9}
    mix, last = Mixture(q, weight), dict.fromkeys(q, 0)
    for w in range(0, sum(q.values()) + 1, 99_991):
        now = mix.bounds(w)
        assert sum(now.values()) == w and all(last[k] <= now[k] <= q[k] for k in q)
        assert all(abs(now[k] - mix.exact(k, w)) <= 2 for k in q if k != "long") or w > sum(q.values()) - 400_000
        last = now
    assert mix.bounds(sum(q.values())) == q


def test_a_tiny_target_doesn_t_enlarge_partitions(spark):
    """The task of a partition holds span sequences, however small the target of the source that lasts longest."""
    rows = [(i, "a b c d e f g " * 6, "long" if i % 2 else f"s{i % 7}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(docs, VOCAB, window=64, span=4, quantum=16, targets={"long": 1e-9}).collect()
    used = {}
    for p in got:
        used[p["sequence_id"]] = used.get(p["sequence_id"], 0) + p["length"]
    assert sum(n == 64 for n in used.values()) >= len(used) - 6
    first = [p["doc_id"] for p in got if p["sequence_id"] < 8]
    assert first and all(i % 2 == 0 for i in first)  # the tiny target waits until the others have run dry
    assert sum(p["length"] for p in got) == sum(used.values())
