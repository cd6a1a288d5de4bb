import math

import numpy as np
import pytest

from goldseam.llm import topk


def brute(rows, every, k):
    ok = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(256 * float(np.float32(x))) for x in v]
        ok.append((i, w))
    out = []
    for at, (q, own) in enumerate(ok):
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for n, (i, v) in enumerate(ok) if n != at)
            out += [(q, r, i, -x) for r, (x, i) in enumerate(s[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block, spread", [(16384, 1.0), (37, 1.0), (200, 6.0), (1, 1.0)])
def test_against_brute_force(spark, monkeypatch, block, spread):
    monkeypatch.setattr(topk, "BLOCK", block)
    r = np.random.default_rng(3)
    m = r.normal(size=(400, 16)) * np.exp(-spread * r.random((400, 1)))
    m[50:80] = m[50]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(m)]
    rows += [(400, None), (410, [1.0, None]), (420, [float("nan")]), (430, [float("inf"), 1.0]), (440, []), (450, [2.0]), (None, [1.0]), (10, rows[10][1]), (10, [0.5] * 16), (3, [3.0] * 16), (3, [3.0] * 16)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, id int")
    got = sorted(tuple(x) for x in topk.top_k(df, every=10, k=5).collect())
    assert got == brute(rows, 10, 5)
    assert topk.top_k(df.limit(0)).count() == 0


def test_stops_early_on_proof():
    r = np.random.default_rng(1)
    v = np.zeros((2000, 8), np.int64)
    v[:, 0] = r.integers(0, 40, 2000)
    v[:20, 0] = 250
    v[:, 1] = r.integers(-8, 8, 2000)
    index = topk.Index(np.arange(2000), np.arange(2000), v)
    q = np.array([256, 1, 0, 0, 0, 0, 0, 0])
    ids, scores = index.search(q, 5, 7)
    want = sorted((-(int(x @ q)), i) for i, x in enumerate(v) if i != 7)[:5]
    assert [(-s, i) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)] == want


def test_postings_are_read_only_while_that_is_cheaper():
    class Counted:
        def __init__(self, order):
            self.order, self.read = order, 0

        def __getitem__(self, at):
            part = self.order[at]
            self.read += len(part)
            return part

    m = np.random.default_rng(3).normal(0, 32, (4000, 64)).round().astype(np.int64)  # noise: bounds prove little
    peaked = m.copy()
    peaked[np.arange(4000), np.arange(4000) % 64] = 2000
    for vectors in (m, peaked):
        rows = np.arange(len(vectors))
        index = topk.Index(rows, rows * 3, vectors)
        index.order = Counted(index.order)
        for own in range(0, 4000, 800):
            index.order.read = 0
            ids, scores = index.search(vectors[own], 5, own)
            s = vectors @ vectors[own]
            s[own] = -(10**12)
            best = np.lexsort((rows, -s))[:5]
            assert ids.tolist() == (best * 3).tolist() and scores.tolist() == s[best].tolist()
            assert index.order.read < 64 * 4000 // 4
