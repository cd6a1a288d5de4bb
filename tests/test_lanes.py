"""Failures by question, times by stage, figures over answered questions, and models of pairs."""

import pytest
from pyspark.sql import functions as F

from goldseam.operators import evaluation as E
from goldseam.operators import lanes as L
from goldseam.operators import retrieval as R
from goldseam.plans import inputs as P
from goldseam.plans import lanes as PL


def asked(spark, n):
    return spark.createDataFrame([(i, f"question {i}") for i in range(n)], "qid long, question string")


def answer(rows):
    return rows.selectExpr("qid", "qid * 10 as chunk_id", "1.0D as score", "1 as rank")


def picky(bad, calls):
    def retrieve(rows, k):
        calls.append(rows.count())
        if not rows.where(F.col("qid").isin(*bad)).isEmpty():
            raise ValueError("can't")
        return L.stage("second", L.stage("first", answer(rows)))

    return retrieve


def test_one_bad_question_is_one_miss(spark):
    calls: list = []
    found, facts = L.run([L.Lane("p", "P", picky([3], calls))], asked(spark, 12), 3)
    assert sorted(r["qid"] for r in found.collect()) == [i for i in range(12) if i != 3]
    log = {r["qid"]: r for r in facts["p"]["log"].collect()}
    assert facts["p"]["failures"] == 1 and facts["p"]["error"] is None and log[3]["error"] == "ValueError: can't" and log[3]["ms"] is None
    assert all(r["ms"] > 0 and r["error"] is None for q, r in log.items() if q != 3) and calls[0] == 12
    stages = {name: rows for name, _, rows in facts["p"]["stages"]}
    assert stages == {"first": 11, "second": 11} and all(s > 0 for _, s, _ in facts["p"]["stages"])
    gold = spark.createDataFrame([(i, i * 10) for i in range(12)], "qid long, chunk_id long")
    names = spark.createDataFrame([("p",)], "lane_id string")
    m = L.metrics(facts["p"]["log"], E.outcomes(asked(spark, 12), found, gold, 3, names)).first()
    assert (m["questions"], m["failed"], m["recall"], m["cost_usd"]) == (12, 1, round(11 / 12, 4), 0.0) and m["mean_ms"] > 0 and m["p95_ms"] > 0


def test_many_failures_lose_no_other_question(spark, monkeypatch):
    """A lane that has answered is never given up, however many batches fail."""
    monkeypatch.setattr(L, "PATIENCE", 15)
    bad = range(0, 30, 3)
    found, facts = L.run([L.Lane("p", "P", picky(bad, []))], asked(spark, 30), 3)
    assert sorted(r["qid"] for r in found.collect()) == [i for i in range(30) if i % 3]
    assert sorted(r["qid"] for r in facts["p"]["log"].where("error is not null").collect()) == list(bad)


def test_a_lane_that_always_fails_is_given_up(spark, monkeypatch):
    monkeypatch.setattr(L, "PATIENCE", 3)
    calls: list = []
    found, facts = L.run([L.Lane("p", "P", picky(range(40), calls))], asked(spark, 40), 3)
    assert found.count() == 0 and facts["p"]["failures"] == 40 and facts["p"]["error"] == "ValueError: can't" and len(calls) < 12
    names = spark.createDataFrame([("p",)], "lane_id string")
    gold = spark.createDataFrame([(1, 1)], "qid long, chunk_id long")
    m = L.metrics(facts["p"]["log"], E.outcomes(asked(spark, 40), found, gold, 3, names)).first()
    assert (m["recall"], m["failed"], m["mean_ms"], m["p95_ms"], m["cost_usd"]) == (0.0, 40, None, None, None)  # nothing was measured


def test_a_model_s_errors_are_misses_whatever_rows_there_are(spark):
    def retrieve(rows, k):
        usage = rows.selectExpr("qid", "case when qid = 1 then 'empty reply' end as error", "100L as prompt_tokens", "10L as completion_tokens")
        return L.Answer(answer(rows), usage)

    found, facts = L.run([L.Lane("m", "M", retrieve)], asked(spark, 3), 3)
    assert sorted(r["qid"] for r in found.collect()) == [0, 2] and facts["m"]["failures"] == 1
    gold = spark.createDataFrame([(i, i * 10) for i in range(3)], "qid long, chunk_id long")
    m = L.metrics(facts["m"]["log"], E.outcomes(asked(spark, 3), found, gold, 3)).first()
    assert m["cost_usd"] == round((100 * 0.075 + 10 * 0.30) / 1e6, 10)


def test_order_of_the_registry_and_all_that_is_missing(spark):
    registry = L.Registry()
    for name in ("x", "y", "z"):
        registry.add(L.Lane(name, name, lambda rows, k: answer(rows), warm=(lambda: 1 / 0) if name != "y" else lambda: None))
    assert [lane.id for lane in registry.chosen(["z", "x", "z"])] == ["x", "z"] and [lane.id for lane in registry.chosen()] == ["x", "y", "z"]
    with pytest.raises(L.LaneUnavailable, match="x .*z "):
        L.preflight(registry.chosen())
    assert registry.chosen([]) == []


def test_pairs_go_to_a_model_in_batches_and_truncated(spark, tmp_path):
    loads = str(tmp_path / "loads")

    def make():
        open(loads, "a").write("x")
        return lambda pairs: [float(len(text.split())) + (0.5 if question in text else 0.0) for question, text in pairs]

    found = spark.createDataFrame([(1, c, 1.0, c) for c in range(1, 6)], "qid int, chunk_id int, score double, rank int").coalesce(1)
    texts = spark.createDataFrame([(1, "a b"), (2, "a  b\nc d e f"), (3, ""), (5, "q q q q q")], "chunk_id int, text string")
    questions = spark.createDataFrame([(1, "q")], "qid int, question string")
    got = R.rerank(found, questions, texts, 4, 3, R.pair_model(make, words=4)).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == [(2, 4.0), (1, 2.0), (3, 0.0)]  # the fifth is beyond the depth, the fourth without a text ties with the third
    assert spark.createDataFrame([("  a\n b c ",)], "t string").select(R.truncated(F.col("t"), 2)).first()[0] == "  a\n b"


def test_an_error_that_is_not_expected_is_no_miss(spark):
    for caught in ((), KeyError):
        with pytest.raises(ValueError, match="can't"):
            L.run([L.Lane("p", "P", picky([3], []))], asked(spark, 12), 3, caught=caught)
    assert L.run([L.Lane("p", "P", picky([3], []))], asked(spark, 4), 3, caught=ValueError)[1]["p"]["failures"] == 1


def made(spark, folder, n=60):
    """Tables of the plans: every document has a vector."""
    texts = [(i, " ".join(f"w{(i * j) % 23}" for j in range(1, 15)), "en", f"src{i % 3}") for i in range(n)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, [1.0, float(i)], i % 2) for i in range(n)], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([(i, texts[i + 1][1][:20]) for i in range(10)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_a_lane_of_the_plan_that_raises_ends_the_query(spark, tmp_path, monkeypatch):
    d = made(spark, tmp_path / "t")
    registry = L.Registry()
    registry.add(L.Lane("hybrid_rerank_tuned", "T", lambda rows, k: 1 / 0))
    monkeypatch.setattr(PL, "registry", lambda spark, d: registry)
    for name in ("lane_rerank_tuned", "lane_metrics"):
        with pytest.raises(ZeroDivisionError):
            PL.QUERIES[name](spark, d)


def test_queries_of_other_plans_leave_the_lanes_their_vectors(spark, tmp_path):
    d = made(spark, tmp_path / "t")
    P.hybrid_texts(spark, d)
    facts = PL.ran(spark, d)[1]
    assert len(facts) == 6 and all(f["failures"] == 0 and f["error"] is None for f in facts.values())
    assert PL.QUERIES["lane_rerank_tuned"](spark, d).select("qid").distinct().count() == 10


@pytest.mark.parametrize("late", [(), (5, 17)])
def test_what_a_lane_takes_is_answered_at_once(spark, monkeypatch, late):
    """However many questions are refused, the others are one batch; a fault in the rows still costs only its own questions."""
    bad, written = range(0, 24, 4), []
    tried = L._tried

    def counted(lane, rows, n, k, run):
        error = tried(lane, rows, n, k, run)
        written.append((n, error is None))
        return error

    def retrieve(rows, k):
        if not rows.where(F.col("qid").isin(*bad)).isEmpty():
            raise ValueError("refused")
        return answer(rows).where(F.when(F.col("qid").isin(*late), F.raise_error(F.lit("late"))).otherwise(F.lit("")) == "")

    monkeypatch.setattr(L, "_tried", counted)
    found, facts = L.run([L.Lane("p", "P", retrieve)], asked(spark, 24), 3)
    lost = sorted({*bad, *late})
    assert sorted(r["qid"] for r in found.collect()) == [i for i in range(24) if i not in lost]
    log = facts["p"]["log"].collect()
    assert sorted(r["qid"] for r in log) == list(range(24)) and sorted(r["qid"] for r in log if r["error"]) == lost
    if not late:
        assert written == [(24, False), (18, True)]
