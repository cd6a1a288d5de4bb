"""Dense search, the default embedder and the grouped split against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest

from goldseam.operators import embedding as N
from goldseam.operators import goldset as G
from goldseam.operators import retrieval as R


@pytest.mark.parametrize("blocks, k, kind", [((4096, 512), 3, "long"), ((7, 2), 3, "string"), ((1, 1), 40, "long")])
def test_dense_search_in_blocks(spark, monkeypatch, blocks, k, kind):
    monkeypatch.setattr(R, "CHUNKS", blocks[0])
    monkeypatch.setattr(R, "ASKED", blocks[1])
    r = np.random.default_rng(5)
    m = r.normal(size=(30, 4))
    m[10:16] = m[10]
    name = str if kind == "string" else int
    rows = [(name(i), [float(x) for x in v]) for i, v in enumerate(m)]
    df = spark.createDataFrame([*rows, (name(99), None)], f"chunk_id {kind}, vector array<double>").repartition(3)
    got = R.dense_search(df, df.where("chunk_id % 5 = 0").withColumnRenamed("chunk_id", "qid"), k)
    want = []
    for q, v in rows[::5]:
        best = sorted((-round(float(np.dot(v, w)), 6), c) for c, w in rows if c != q)[:k]
        want += [(q, c, -s, i) for i, (s, c) in enumerate(best, 1)]
    assert sorted((x["qid"], x["chunk_id"], x["score"], x["rank"]) for x in got.collect()) == sorted(want)
    assert R.dense_search(df.limit(0), df.withColumnRenamed("chunk_id", "qid"), k).count() == 0


def plain(text, dims):
    v = [0.0] * dims
    for w in text.lower().split():
        s = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % (2 * dims)
        v[s % dims] += 1 if s < dims else -1
    n = math.sqrt(sum(x * x for x in v))
    return [x / n if n else x for x in v]


def test_embedders(spark):
    texts = ["a b b c", "", None, "longer words of a text " * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "qid int, question string")
    for prefix in (N.QUERY_PREFIX, ""):
        got = {r["qid"]: r["vector"] for r in N.embed_queries(df, prefix=prefix).collect()}
        for i, t in enumerate(texts):
            assert got[i] == pytest.approx(plain((prefix + (t or "")).replace(":", ""), N.DIMS))
    own = N.model_embedder(lambda: lambda texts: np.array([[3.0 * len(t), 4.0 * len(t)] for t in texts]))
    got = [r["vector"] for r in N.embed_chunks(df.orderBy("qid"), own, "question").collect()]
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == [0.0, 0.0]
    assert N.embed_chunks(df.limit(0), text_col="question").count() == 0


@pytest.mark.parametrize("share", [0.0, 0.5, 0.8, 1.0])
def test_split_is_the_greedy_fill(spark, share):
    rng = random.Random(share)
    sizes = {i: rng.choice([0, 1, 1, 1, 2, 2, 3, 9, 30]) for i in range(120)}
    want_train = round(sum(sizes.values()) * share)
    open_ = {"train": want_train, "test": sum(sizes.values()) - want_train}
    want = {}
    for i in sorted(sizes, key=lambda i: (-sizes[i], hashlib.md5(f"7:{i}".encode()).hexdigest(), i)):
        want[i] = "train" if open_["train"] >= open_["test"] else "test"
        open_[want[i]] -= sizes[i]
    df = spark.createDataFrame(list(sizes.items()), "group long, n long")
    assert {r["group"]: r["split"] for r in G.grouped_split(df, share, 7).collect()} == want
    assert G.grouped_split(df.limit(0), share, 7).count() == 0
