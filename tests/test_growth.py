"""What must grow no faster than the input: plans and plain comparisons of the steps that lanes and gold share."""

import random
import unicodedata
from collections import Counter
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from goldseam.functions import text as T
from goldseam.operators import embedding as N
from goldseam.operators import evaluation as E
from goldseam.operators import retrieval as R
from goldseam.plans import inputs as P


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ascii_texts_are_not_matched_character_by_character(spark):
    texts = ["plain text", "Ｆｕｌｌ and plain", "é and plain", "plain, then \U0001d400", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    conditions = plan(df.select(T.nfkc(F.col("t")).alias("v")))
    assert conditions.index("octet_length") < conditions.index("RLIKE")
    assert [r["v"] for r in df.select(T.nfkc(F.col("t")).alias("v")).collect()] == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_postings_are_the_plain_counts(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK", block)
    rng = random.Random(block)
    texts = {i: " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(9))) for i in range(60)} | {98: None, 99: "... !"}
    index = R.build_index(spark.createDataFrame(list(texts.items()), "chunk_id long, text string").repartition(3))
    got = {}
    for r in index.blocks.collect():
        at = 0
        places, counts = np.frombuffer(r["places"], "<i4").tolist(), np.frombuffer(r["counts"], "<i4").tolist()
        for word, n in zip(r["words"], r["sizes"], strict=True):
            assert places[at : at + n] == sorted(places[at : at + n])
            for p, c in zip(places[at : at + n], counts[at : at + n], strict=True):
                got.setdefault(r["ids"][p], {})[word] = c
            at += n
        assert at == len(places) == len(counts) and len(r["ids"]) <= block
        for i, n in zip(r["ids"], r["lengths"], strict=True):
            assert n == len((texts[i] or "").replace("... !", "").split())
    assert got == {i: dict(Counter(t.split())) for i, t in texts.items() if t and "!" not in t}


@pytest.mark.parametrize("patterns, head", [(100_000, 64), (100_000, 2), (3, 64), (1, 1)])
def test_passages_are_found_without_moving_texts(spark, monkeypatch, patterns, head):
    monkeypatch.setattr(R, "PATTERNS", patterns)
    monkeypatch.setattr(R, "HEAD", head)
    rng = random.Random(head)
    texts = [(i, " ".join(rng.choice(["a", "ab", "abc", "b"]) for _ in range(40))) for i in range(30)] + [(98, None), (99, "")]
    asked = [(i, texts[i % 30][1][i : i + rng.randrange(1, 30)]) for i in range(40)] + [(50, ""), (51, "never there at all in a text"), (52, None), (53, texts[4][1])]
    found = R.containing(spark.createDataFrame(texts, "chunk_id long, text string"), spark.createDataFrame(asked, "qid long, question string"))
    want = sorted((q, c) for q, x in asked for c, t in texts if x and t and x in t)
    assert sorted(tuple(r) for r in found.collect()) == want and len(want) > 40
    assert patterns < 1000 or "Exchange" not in plan(found)


def test_default_vectors_are_made_in_batches(spark):
    made = N.embed_chunks(spark.createDataFrame([(i, "a b") for i in range(3)], "chunk_id long, text string"))
    assert "ArrowEvalPython" in plan(made) and "md5" not in plan(made)
    assert len({tuple(r["vector"]) for r in made.collect()}) == 1


def test_only_texts_that_were_found_are_moved(spark, tmp_path):
    texts = [(i, f"word{i} common " + f"filler{i} " * 50) for i in range(400)]
    spark.createDataFrame(texts, "chunk_id long, text string").write.parquet(f"{tmp_path}/texts")
    spark.createDataFrame([(q, q + i, i + 1) for q in range(3) for i in range(9)] + [(0, 999, 2)], "qid long, chunk_id long, rank int").write.parquet(f"{tmp_path}/found")
    asked = spark.createDataFrame([(q, f"common word{q} other") for q in range(3)], "qid long, question string")
    again = R.rerank(spark.read.parquet(f"{tmp_path}/found"), asked, spark.read.parquet(f"{tmp_path}/texts"), 5, 2)
    assert "LeftSemi, BuildRight" in plan(again)
    got = sorted(tuple(r) for r in again.select("qid", "chunk_id", "score", "rank").collect())
    assert got == [(q, q + i, s, i + 1) for q in range(3) for i, s in enumerate((0.666667, 0.333333))]


def test_resamples_are_drawn_in_batches(spark):
    rows = [(q, (q * 7 % 5 - 2) / 3) for q in range(23)]
    got = E.bootstrap(spark.createDataFrame(rows, "qid long, v double"), "v", 150, 9)
    assert "MapInArrow" in plan(got) and "aggregate(sequence" not in plan(got)
    means = [sum(rows[int(md5(f"9:{b}:{i}".encode()).hexdigest()[:8], 16) % 23][1] for i in range(23)) / 23 for b in range(150)]
    assert tuple(got.first()) == pytest.approx((sum(v for _, v in rows) / 23, *np.quantile(means, [0.025, 0.975])))


def test_ids_go_to_the_texts_of_documents_with_a_vector(spark, tmp_path, monkeypatch):
    docs = [(i, f"text {i} " + "filler " * 40, "en", "s") for i in range(0, 300, 3)] + [(301, None, "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [0.5, 1.0], 1) for i in [*range(0, 400, 2), 301]], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    indexed = []
    monkeypatch.setattr(R, "build_index", lambda c: indexed.append(c) or 1 / 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (1_000_000, 10):
            monkeypatch.setattr(P, "IDS", most, raising=False)
            with pytest.raises(ZeroDivisionError):
                P.arms(spark, str(tmp_path))
        assert "Exchange hashpartitioning" not in plan(indexed[0])
        want = sorted((i, t) for i, t, *_ in docs if i % 2 == 0 or i == 301)
        assert len(want) == 51 and all(sorted(map(tuple, c.select("chunk_id", "text").collect())) == want for c in indexed)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tasks_that_keep_rows_of_every_question_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "TASKS", 3, raising=False)
    monkeypatch.setattr(R, "ranked", lambda scored, k: scored)
    spark.createDataFrame([(i, f"word{i % 7} more", [1.0, i / 40]) for i in range(40)], "chunk_id long, text string, vector array<double>").repartition(20).write.parquet(f"{tmp_path}/chunks")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")  # each file is read by a task
    try:
        chunks = spark.read.parquet(f"{tmp_path}/chunks")
        asked = spark.createDataFrame([(1, "word1 word2", [0.0, 1.0])], "qid long, question string, vector array<double>")
        found = [R.bm25_search(R.build_index(chunks), asked, 2), R.dense_search(chunks, asked, 2)]
        assert chunks.rdd.getNumPartitions() > 8
        assert all(f.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism for f in found)
        assert {r["chunk_id"] for r in found[1].collect()} >= {38, 39}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
