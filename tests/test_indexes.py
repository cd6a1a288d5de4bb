"""BM25 by bounded blocks and the vector index against plain scans."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from goldseam.config import EngineError
from goldseam.operators import retrieval as R
from goldseam.operators import vectors as V


def plain_bm25(chunks, questions, k, own=False):
    texts = {i: (t or "").lower().split() for i, t in chunks}
    n, avgdl = len(texts), sum(map(len, texts.values())) / len(texts)
    df = Counter(w for t in texts.values() for w in set(t))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    out = []
    for qid, q in questions:
        scores = []
        for i, t in texts.items():
            tf = Counter(t)
            if any(w in tf for w in q.split()) and not (own and i == qid):
                s = sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for w in q.split() if w in tf)
                scores.append((-round(s, 6), i))
        out += [(qid, i, -s, r + 1) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("block", "asked", "own"), [(4096, 200_000, False), (5, 200_000, True), (16, 3, False)])
def test_bm25_blocks_equal_a_scan(spark, monkeypatch, block, asked, own):
    monkeypatch.setattr(R, "BLOCK", block)
    monkeypatch.setattr(R, "MOST_ASKED", asked)
    rng = np.random.default_rng(3)
    share = 1 / np.arange(1, 41)
    words = lambda n: " ".join(rng.choice([f"w{i}" for i in range(40)], n, p=share / share.sum()))
    chunks = [(i, words(rng.integers(1, 50))) for i in range(150)] + [(200 + i, "w3 w39 w0") for i in range(20)] + [(300, None), (301, "")]
    questions = [(i, words(6)) for i in range(0, 12)] + [(77, "w39 w39 w0"), (78, "none of these")]
    index = R.build_index(spark.createDataFrame(chunks, "chunk_id long, text string").repartition(3))
    got = R.bm25_search(index, spark.createDataFrame(questions, "qid long, question string"), 4, exclude_self=own)
    assert sorted(tuple(r) for r in got.select("qid", "chunk_id", "score", "rank").collect()) == plain_bm25(chunks, questions, 4, own)


def test_bm25_shuffles_few_rows(spark):
    """What leaves the scan of the index is at most k rows for each question and task."""
    chunks = spark.range(5000).selectExpr("id as chunk_id", "concat('all of them w', id % 7) as text").repartition(4)
    index = R.build_index(chunks)
    questions = spark.createDataFrame([(1, "all of"), (2, "them w3")], "qid long, question string")
    words = {1: [("all", 1.0), ("of", 1.0)], 2: [("them", 1.0), ("w3", 2.0)]}
    tasks = index.blocks.rdd.getNumPartitions()
    assert R._scored(index, words, 10, 4.0, [], False, "bigint").count() <= 2 * 10 * tasks
    assert [r["chunk_id"] for r in R.bm25_search(index, questions.where("qid = 2"), 3).orderBy("rank").collect()] == [3, 10, 17]


def test_an_empty_corpus_has_no_index(spark):
    for rows in ([], [(1, ""), (2, None)]):
        with pytest.raises(EngineError):
            R.build_index(spark.createDataFrame(rows, "chunk_id long, text string"))


def clustered(n, clusters, dims=16):
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(clusters, dims))
    v = centers[rng.integers(0, clusters, n)] + 0.3 * rng.normal(size=(n, dims))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def table(spark):
    v = clustered(1500, 20)
    rows = [(i, "a" if i % 3 else "b", [float(x) for x in row]) for i, row in enumerate(v)]
    return spark.createDataFrame([*rows, (9999, "a", None)], "chunk_id long, corpus_id string, vector array<double>").repartition(3).persist()


def test_few_probes_find_nearly_all_in_clustered_vectors(spark, table):
    index = V.build(table, 20, sample=700)  # fitted on about half of them
    assert index.lists == 20 and index.vectors.count() == 1500
    queries = table.where("chunk_id % 25 = 0").withColumnRenamed("chunk_id", "qid")
    exact = R.dense_search(table, queries, 10, exclude_self=False)
    share = {p: V.recall(V.search(index, queries, 10, p), exact).first()[0] for p in (1, 3, 20)}
    assert share[3] >= 0.9 and share[1] <= share[3] and share[20] == 1.0


def test_probes_read_their_lists_only(spark, table):
    index = V.build(table, 8)
    one = table.where("chunk_id = 10").withColumnRenamed("chunk_id", "qid")
    plan = V.search(index, one, 3)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [(list" in plan or "list#" in plan.split("PartitionFilters")[1][:60]
    assert V.search(index, one, 1).first()["chunk_id"] == 10


def test_corpus_filter_and_arguments(spark, table):
    index = V.build(table)
    assert index.lists == 1  # one list for every thousand
    queries = table.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "qid")
    got = V.search(index, queries, 5, corpus="b", exclude_self=True)
    want = R.dense_search(table.where("corpus_id = 'b'"), queries, 5)
    key = lambda df: sorted(tuple(r) for r in df.select("qid", "chunk_id", "score", "rank").collect())
    assert key(got) == key(want)
    for bad in (0, -1, True, 1.5):
        with pytest.raises(ValueError):
            V.search(index, queries, 5, probes=bad)
        with pytest.raises(ValueError):
            V.build(table, lists=bad)
    with pytest.raises(ValueError):
        V.search(index, queries, 0)


def test_degenerate_tables(spark, table):
    none = V.build(table.limit(0))
    assert V.search(none, table.limit(0).withColumnRenamed("chunk_id", "qid"), 3).count() == 0
    same = spark.createDataFrame([(i, [0.0, 1.0]) for i in range(5)] + [(9, [0.0, 0.0])], "chunk_id long, vector array<double>")
    index = V.build(same, 4)
    got = V.search(index, same.where("chunk_id = 2").withColumnRenamed("chunk_id", "qid"), 9, probes=4)
    assert [r["chunk_id"] for r in got.orderBy("rank").collect()] == [0, 1, 2, 3, 4, 9]


def test_batches_are_bounded_and_lists_meet_without_the_driver(spark, table):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    index = V.build(table, 8)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "512"
    plan = V.search(index, table.where("chunk_id % 25 = 0").withColumnRenamed("chunk_id", "qid"), 3, 8)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_many_lists_are_fitted_without_comparing_candidates_on_the_driver(spark, monkeypatch):
    """Beyond SEEDED lists MLlib, whose seeding is quadratic in them, isn't asked; lists stay whole and clusters together."""
    import pyspark.ml.clustering as C

    monkeypatch.setattr(V, "SEEDED", 4)
    monkeypatch.setattr(C, "KMeans", lambda **k: 1 / 0)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 16))
    rows = [(i, (centers[i % 12] + rng.normal(size=16) * 0.05).tolist()) for i in range(600)] + [(600, [0.0] * 16)]
    table = spark.createDataFrame(rows, "chunk_id long, vector array<double>")
    index = V.build(table, 40)
    assert index.lists == 40 and np.allclose(np.linalg.norm(index.centers, axis=1), 1)
    assert sorted(r["chunk_id"] for r in index.vectors.select("chunk_id").collect()) == list(range(601))
    again = V.fitted(table, 40)
    assert np.array_equal(index.centers, again)
    mixed = [r["n"] for r in index.vectors.where("chunk_id < 600").groupBy("list").agg(F.countDistinct(F.expr("chunk_id % 12")).alias("n")).collect()]
    assert sum(n == 1 for n in mixed) >= len(mixed) - 2
    assert V.build(table.where("chunk_id < 3"), 40).lists == 3  # fewer different vectors than lists
