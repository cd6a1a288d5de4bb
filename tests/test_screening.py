"""Model replies, drafting and screening, with models that fail in every way."""

import pytest
from pyspark.sql import functions as F

from goldseam.operators import screening as C
from goldseam.operators.completion import by_model, by_rule, out_of_quota, replied, unquoted


class RateLimitError(Exception):
    pass


def test_daily_budget_is_told_from_other_errors():
    assert out_of_quota(RateLimitError("Limit 100000 tokens per day reached")) and out_of_quota(RateLimitError("on TPD: used"))
    assert not out_of_quota(RateLimitError("tokens per minute")) and not out_of_quota(ValueError("tokens per day"))


def flaky(loads, log):
    """A model that fails on whole batches that hold a bad prompt, and on some prompts only at first."""

    def make():
        open(loads, "a").write("x")
        tried = {}

        def model(prompts):
            for p in prompts:
                open(log, "a").write(p + "\n")
                tried[p] = tried.get(p, 0) + 1
                if p == "bad":
                    raise ValueError("no such prompt")
                if p == "slow" and len(prompts) == 1 and tried[p] < 3:
                    raise TimeoutError("again")
                if p == "slow" and len(prompts) > 1:
                    raise TimeoutError("again")
                if p == "budget":
                    raise RateLimitError("tokens per day")
            return [("" if p == "blank" else f" {p}! ", len(p), 1) for p in prompts]

        return model

    return make


def test_a_bad_prompt_costs_no_other_its_reply(spark, tmp_path):
    prompts = [f"p{i}" for i in range(20)] + ["bad", "blank", "slow"]
    rows = spark.createDataFrame([(p,) for p in prompts], "prompt string").coalesce(1)
    loads, log = str(tmp_path / "loads"), str(tmp_path / "log")
    got = {r["prompt"]: r["reply"] for r in replied(rows, by_model(flaky(loads, log), attempts=2, delay=0.0), "t").collect()}
    assert {p: r["text"] for p, r in got.items()} == {p: f"{p}!" if p not in ("bad", "blank") else None for p in prompts}
    assert got["bad"]["error"] == "ValueError: no such prompt" and got["bad"]["attempts"] == 2 and got["bad"]["ms"] is None
    assert got["blank"]["error"] == "empty reply" and not any(r["quota"] for r in got.values())
    assert got["p3"]["prompt_tokens"] == 2 and got["p3"]["ms"] >= 0
    assert open(loads).read() == "x"  # loaded once for the task


def test_no_call_after_the_quota_is_gone(spark, tmp_path):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "b", "budget", "c", "d"])], "i int, prompt string").coalesce(1).sortWithinPartitions("i")
    log = str(tmp_path / "log")
    got = {r["prompt"]: r["reply"] for r in replied(rows, by_model(flaky(str(tmp_path / "l"), log), delay=0.0), "t").collect()}
    assert got["budget"]["quota"] and got["c"]["quota"] and got["d"]["quota"] and not any(r["text"] for r in got.values())  # one call for the batch, no other
    assert open(log).read().split().count("budget") == 1


def test_quotes_around_a_reply(spark):
    rows = spark.createDataFrame([(x,) for x in ['"a b"', "' c'", '"', "d'", "'e\"", "  f "]], "x string")
    assert [r[0] for r in rows.select(unquoted(F.col("x"))).collect()] == ["a b", "c", '"', "d'", "'e\"", "f"]


CHUNKS = [(1, "the cat sat on the mat and slept all day"), (2, "a dog ran through the park at night"), (3, None)]


def screened(spark, drafts, judge, rewrite, **more):
    d = spark.createDataFrame(drafts, "qid long, question string, chunk_id long")
    rows, stopped = C.screen(d, spark.createDataFrame(CHUNKS, "chunk_id long, text string"), judge, rewrite, **more)
    return {r["qid"]: r for r in rows.collect()}, stopped


def by_words(drop=(), none=()):
    """A judge that fires a rule whose name the question holds."""

    def make():
        def model(prompts):
            out = []
            for p in prompts:
                question = p.split("Question: ")[1].split("\n")[0]
                asks = next(r for r, a in C.ASKS.items() if p.startswith(a))
                if "exhausted" in question:
                    raise RateLimitError("TPD")
                out.append(("hm" if f"?{asks}" in question else "YES it does" if asks in question else "NO", 1, 1))
            return out

        return model

    return by_model(make, delay=0.0)


def test_rules_and_their_order(spark):
    drafts = [(1, "where did it sleep", 1), (2, "generic multi_chunk thing", 1), (3, "?unanswerable generic", 1), (4, "cat sat on the mat generic", 1), (5, "q", 77), (6, "who", 3)]
    got, stopped = screened(spark, drafts, by_words(), by_rule(F.lit("x")))
    assert not stopped
    assert {q: (r["verdict"], r["rule"]) for q, r in got.items()} == {1: ("keep", None), 2: ("drop", "generic"), 3: ("unscored", None), 4: ("drop", "generic"), 5: ("unscored", None), 6: ("keep", None)}
    assert got[2]["scores"]["multi_chunk"]["fired"] and got[4]["scores"]["verbatim"]["fired"]  # all rules are scored
    assert got[3]["scores"]["unanswerable"]["fired"] is None and got[5]["scores"] == {} and got[3]["reason"] == "no score: unanswerable"


def test_rewriting_is_bounded(spark):
    drafts = [(1, "so the cat sat on the mat", 1), (2, "why a dog ran through the park at night", 2), (3, "the cat sat on the mat", 1)]
    shorter = F.when(F.col("qid") != 3, F.array_join(F.slice(F.split("now", " "), 1, F.greatest(F.size(F.split("now", " ")) - 3, F.lit(1))), " "))
    got, _ = screened(spark, drafts, by_words(), by_rule(shorter))
    assert {q: (r["verdict"], r["rephrase_attempts"], r["question"], r["original_question"]) for q, r in got.items()} == {
        1: ("fix", 1, "so the cat sat", drafts[0][1]), 2: ("fix", 2, "why a dog", drafts[1][1]), 3: ("unscored", 1, drafts[2][1], None)}
    assert got[1]["shared_run"] == 6
    same, _ = screened(spark, drafts, by_words(), by_rule(F.col("now")))
    assert {r["verdict"] for r in same.values()} == {"drop"} and {r["rephrase_attempts"] for r in same.values()} == {2}
    none, _ = screened(spark, drafts, by_words(), by_rule(F.col("now")), rewrites=0)
    assert {(r["verdict"], r["rephrase_attempts"]) for r in none.values()} == {("drop", 0)}


def test_quota_leaves_drafts_for_a_later_run(spark):
    drafts = [(1, "where", 1), (2, "exhausted", 1), (3, "when", 2)]
    got, stopped = screened(spark, drafts, by_words(), by_rule(F.lit("x")))
    assert stopped and 2 not in got and all(r["verdict"] == "keep" for r in got.values())
    done = spark.createDataFrame([(q,) for q in got], "qid long")
    later, stopped = screened(spark, [(q, t.replace("exhausted", "now"), c) for q, t, c in drafts], by_words(), by_rule(F.lit("x")), done=done)
    assert not stopped and set(later) == {1, 2, 3} - set(got)
    nothing, stopped = screened(spark, [], by_words(), by_rule(F.lit("x")))
    assert nothing == {} and not stopped


@pytest.mark.parametrize(("said", "check", "labelled"), [("2", "confirmed", 11), ("It is 1.", "relabelled", 10), ("NONE", "unverified", 11), ("7", "unverified", 11), ("", "unverified", 11)])
def test_drafts_and_their_labels(spark, said, check, labelled):
    chunks = spark.createDataFrame([(10, "s", 0, "first"), (11, "s", 1, "second"), (12, "s", 2, "third"), (13, "s", 4, "fourth")], "chunk_id long, source_doc string, chunk_index int, text string")
    sample = spark.createDataFrame([(1, 11), (2, 13)], "qid long, chunk_id long")
    writer = by_rule(F.when(F.col("qid") == 1, '"What?"'))
    rows, stopped = C.draft(sample, chunks, writer, by_rule(F.lit(said)))
    got = {r["qid"]: r for r in rows.collect()}
    assert not stopped and (got[1]["question"], got[1]["label_check"], got[1]["labelled_id"], got[1]["status"]) == ("What?", check, labelled, "draft")
    assert got[2]["status"] == "error" and got[2]["error"] == "empty reply"
    again, _ = C.draft(sample, chunks, by_rule(F.lit("New?")), by_rule(F.lit("1")), done=rows)
    assert {r["qid"]: r["question"] for r in again.collect()} == {1: "What?", 2: "New?"}  # only the error is asked again
