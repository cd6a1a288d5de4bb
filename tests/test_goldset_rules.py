"""Eligibility, guards, lanes, parsers and readers on small cases."""

import json
import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from goldseam.config import EngineError, LeakageError
from goldseam.functions import text as T
from goldseam.operators import evaluation, goldset, guards, lanes, retrieval
from goldseam.sources import jsonl


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize("text, opens, inside, closes", [
    ("plain words here\nand there", False, False, False),
    ("x = 1\n```\nwords after the block", True, True, False),
    ("words\n```python\nx = 1\n```\nmore words", False, False, False),
    ("words\n```python\nx = 1", False, False, True),
    ('{"a": [1, 2], "b": {}}\nwords', False, True, False),
    ("words\n[[1, 2], [3, 4]]\n\n", False, False, True),
    ("", False, False, False),
    ("~~~\nwords\n~~~js\n", True, True, True),
])
def test_code_edges(spark, text, opens, inside, closes):
    assert value(spark, text, goldset.opens_inside_fence) is opens
    assert value(spark, text, goldset.opens_inside_code) is inside
    assert value(spark, text, goldset.closes_inside_code) is closes


@pytest.mark.parametrize("text, share", [
    ("", 1.0),
    ("---\nname: x\n---\nbody", 16 / 20),
    ("body\n---\nname: x\n---\n", 0.0),
    ("name: x\n\nother: y\nbody\nlate: z\n", 17 / 30),
    ("body\nimport Tab from 'tabs'\n", 23 / 28),
    ("---\nnever shut\nbody\n", 1.0),
])
def test_scaffolding(spark, text, share):
    if text.startswith("name"):
        share = (len("name: x\n") + len("other: y\n")) / len(text)
    assert math.isclose(value(spark, text, goldset.scaffolding_fraction), share)


def test_non_prose_starts_in_the_block_that_a_bare_fence_shuts(spark):
    text = "inside\n```\nwords and words\nsee {* file.py *} here\n"
    assert math.isclose(value(spark, text, goldset.non_prose_fraction), (len("inside\n```\n") + len("see {* file.py *} here\n")) / len(text))


def test_headings(spark):
    rows = [("\n## Title\nx", 3, True), ("#Title", 3, False), ("text", 0, True), ("text\n# later", 2, False), ("", 4, False)]
    got = spark.createDataFrame([(t, i) for t, i, _ in rows], "t string, i int").select(goldset.starts_at_heading(F.col("t"), F.col("i")).alias("v")).collect()
    assert [r["v"] for r in got] == [x for *_, x in rows]


def questions(spark, *rows):
    return spark.createDataFrame([*rows], "qid string, question string")


def test_guard_of_test_questions(spark):
    train, test = questions(spark, ("a", "What is one?"), ("b", "Both?")), questions(spark, ("t", "What is  two?"), ("u", "both?"))
    asked = questions(spark, ("1", " what IS one? "), ("2", "WHAT is two?"), ("3", "Three?"), ("4", "both?"))
    kinds = {r["qid"]: r["kind"] for r in guards.classified(asked, train, test).collect()}
    assert kinds == {"1": "allowed", "2": "forbidden", "3": "unknown", "4": "forbidden"}
    with pytest.raises(LeakageError):
        guards.train_only(asked, train, test)
    assert guards.train_only(asked.where("qid = '1'"), train, test).count() == 1
    with pytest.raises(LeakageError):
        guards.check_all_asked(asked.where("qid = '1'"), train)


def test_faults_of_pairs(spark):
    train, test = questions(spark, ("a", "One?")), questions(spark, ("t", "Two?"))
    good = spark.createDataFrame([("a", "One?", 1, "text")], "qid string, question string, chunk_id long, text string")
    guards.check_pairs(good, train, test)
    for row, fault in ((("t", "x", 1, "y"), "test_qid"), (("z", "x", 1, "y"), "unknown_qid"), (("a", "two? ", 1, "y"), "test_question"), (("a", "x", 1, " "), "empty_text"), (("a", "x", 1, None), "empty_text")):
        bad = spark.createDataFrame([row], good.schema)
        assert {r["fault"] for r in guards.pair_faults(bad, train, test).collect() if r["n"]} == {fault}
        with pytest.raises(LeakageError):
            guards.check_pairs(good.unionByName(bad), train, test)


def test_leaks_of_a_split(spark):
    schema = "qid string, question string, chunk_id long, split string"
    clean = [("a", "One?", 1, "train"), ("a", "One?", 2, "train"), ("b", "Two?", 3, "test")]
    guards.check_no_leaks(spark.createDataFrame(clean, schema))
    for row, kind in ((("a", "Three?", 9, "test"), "shared_qids"), (("c", "one? ", 9, "test"), "shared_questions"), (("c", "Three?", 2, "test"), "shared_chunks"), (("b", "Four?", 9, "test"), "repeated_qids")):
        found = guards.leaks(spark.createDataFrame([*clean, row], schema)).first()
        assert found[kind] == 1 and sum(found) == 1


def test_lanes(spark):
    def find(asked, k):
        return asked.selectExpr("qid", "7L as chunk_id", "1.0D as score", "1 as rank")

    def fails(asked, k):
        raise RuntimeError("down")

    registry = lanes.Registry()
    registry.add(lanes.Lane("good", "Good", find))
    registry.add(lanes.Lane("bad", "Bad", fails))
    with pytest.raises(ValueError):
        registry.add(lanes.Lane("good", "Again", find))
    with pytest.raises(ValueError):
        registry.chosen(["none"])
    asked = questions(spark, ("a", "One?"), ("b", " "), ("c", None))
    found, facts = lanes.run(registry.chosen(), asked, 3)
    assert [(r["lane_id"], r["qid"]) for r in found.collect()] == [("good", "a")]
    assert "down" in facts["bad"]["error"] and facts["good"]["error"] is None and facts["good"]["seconds_per_question"] > 0
    gold = spark.createDataFrame([("a", 7), ("b", 7)], "qid string, chunk_id long")
    names = spark.createDataFrame([("good",), ("bad",)], "lane_id string")
    hits = {(r["lane_id"], r["qid"]): r["hit"] for r in evaluation.outcomes(asked, found, gold, 3, names).collect()}
    assert [k for k, v in hits.items() if v] == [("good", "a")] and len(hits) == 6
    registry.add(lanes.Lane("cold", "No model", find, warm=lambda: 1 / 0))
    with pytest.raises(lanes.LaneUnavailable):
        lanes.preflight(registry.chosen())
    none, _ = lanes.run([registry["bad"]], asked, 3)
    assert none.count() == 0


def test_verdicts(spark):
    def read(reply, n=2):
        v = T.verdicts(F.lit(reply), F.array(*[F.lit(f"S{i}.") for i in range(n)]))
        r = spark.range(1).select(v.alias("v")).first()["v"]
        return r["error"] or [(x["n"], x["sentence"], x["supported"], x["reason"]) for x in r["verdicts"]]

    good = {"verdicts": [{"supported": True, "reason": " a "}, {"supported": False}]}
    assert read(f"Here:\n```json\n{json.dumps(good)}\n```") == [(1, "S0.", True, "a"), (2, "S1.", False, "")]
    assert read("no") == "no JSON object"
    assert read("{broken") == "no JSON object"
    assert read("{broken}") == "not valid JSON"
    assert read('{"x": 1}') == "no list of verdicts"
    assert read(json.dumps(good), 3) == "another number of verdicts than sentences"
    assert read('{"verdicts": []}', 0) == []


def test_statistics_of_many_pairs(spark):
    rows = [(i, i % 2 == 0, i % 3 == 0, 0.0, 0.0) for i in range(6000)]
    pairs = spark.createDataFrame(rows, "qid long, hit_a boolean, hit_b boolean, rr_a double, rr_b double")
    r = evaluation.mcnemar(pairs).first()
    a, b = sum(x[1] and not x[2] for x in rows), sum(x[2] and not x[1] for x in rows)
    want = min(1.0, 2 * sum(math.comb(a + b, i) for i in range(max(a, b), a + b + 1)) / 2 ** (a + b))
    assert (r["a_only"], r["b_only"]) == (a, b) and math.isclose(r["p_value"], want, rel_tol=1e-6)
    assert {r["change"]: r["count"] for r in evaluation.changed(pairs).groupBy("change").count().collect()} == {"won": b, "lost": a}
    out = spark.createDataFrame([("x", 1, True, 1.0), ("x", 2, True, 1.0), ("y", 1, False, 0.0), ("y", 2, True, 1.0)], "lane_id string, qid long, hit boolean, rr double")
    assert {r["lane_id"]: r["wins"] for r in evaluation.detectable_wins(out).collect()} == {"x": 0, "y": 1}
    assert {r["lane_id"]: r["fired"] for r in evaluation.tripwire(out).collect()} == {"x": True, "y": False}


def test_compatibility_forms_meet(spark):
    texts = ["Ｆｕｌｌ ｗｉｄｔｈ", "ﬁne ﬂow", "plain é ü ß", "é combined", None, "", "№ ½ ﷺ", "한글 ①"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.nfkc(F.col("t")).alias("v")).collect()
    assert [r["v"] for r in got] == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]
    chunks = spark.createDataFrame([(1, "ﬁne words"), (2, "other words"), (3, None), (4, "")], "chunk_id long, text string")
    found = retrieval.bm25_search(retrieval.build_index(chunks), spark.createDataFrame([(9, "fine")], "qid long, question string"), 2)
    assert [r["chunk_id"] for r in found.collect()] == [1]


def test_plain_characters_are_stable():
    import re

    beyond = re.compile(f"[^{T.PLAIN}]")
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x30000)]):
        if not beyond.search(c):
            assert unicodedata.normalize("NFKC", f"a{c}b") == f"a{c}b"


@pytest.mark.parametrize("question", ["one two three four five six", "ne two three four fi", "two", "six\nseven  eight nine ten", "absent words are never found"])
def test_containing(spark, question):
    texts = [(1, "zero one two three four five six"), (2, "six\nseven  eight nine ten"), (3, "two"), (4, ""), (5, None), (6, "one two three")]
    found = retrieval.containing(spark.createDataFrame(texts, "chunk_id long, text string"), spark.createDataFrame([(1, question)], "qid long, question string"))
    assert sorted(r["chunk_id"] for r in found.collect()) == [i for i, t in texts if t is not None and question in t]


def test_queues(spark):
    first = spark.createDataFrame([(i, "keep" if i % 3 else "drop") for i in range(30)] + [(90, "unscored")], "qid long, verdict string")
    second = spark.createDataFrame([(i, "keep") for i in range(25)] + [(90, "keep")], "qid long, verdict string")
    got = [(r["qid"], r["kind"]) for r in goldset.audit_queue(first, second, 5, 42).collect()]
    assert sorted(i for i, k in got if k == "disputed") == [i for i in range(25) if i % 3 == 0]
    assert len([1 for i, k in got if k == "control" and i % 3 and i < 25]) == 5 == len(got) - 9
    pool = spark.createDataFrame([(1,), (2,)], "qid long")
    assert {r["qid"] for r in goldset.audit_queue(first, second, 5, 42, pool).where("kind = 'control'").collect()} == {1, 2}
    judged = spark.createDataFrame([(i, i < 3) for i in range(20)], "item long, grounded boolean")
    assert sorted(r["grounded"] for r in goldset.calibration_queue(judged, "item", "grounded", 10, 42, True).collect()) == [False] * 7 + [True] * 3
    assert goldset.calibration_queue(judged, "item", "grounded", 20, 42, True).count() == 20
    assert goldset.calibration_queue(judged, "item", "grounded", 10, 42).count() == 10
    with pytest.raises(EngineError):
        goldset.calibration_queue(judged, "item", "grounded", 21, 42)


def test_training_pairs(spark):
    found = spark.createDataFrame([("a", i, i) for i in range(1, 31)], "qid string, chunk_id long, rank int")
    gold = spark.createDataFrame([("a", 4), ("a", 2), ("b", 50)], "qid string, chunk_id long")
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "chunk_id long, text string")
    rows = goldset.training_pairs(found, gold, texts, 20, 4, 42).collect()
    good = sorted((r["qid"], r["chunk_id"], r["text"], r["fused_rank"]) for r in rows if r["label"] == 1.0)
    assert good == [("a", 2, "t2", 2), ("b", 50, "", None)]
    bad = [r for r in rows if r["label"] == 0.0]
    assert len(bad) == 4 and all(r["qid"] == "a" and r["chunk_id"] not in (2, 4) and r["fused_rank"] == r["chunk_id"] <= 20 for r in bad)


def test_readers(spark, tmp_path):
    (tmp_path / "map.json").write_text(json.dumps({"_README": {"why": "notes"}, "q1": {"also": ["c1", "c2"], "why": "same"}, "q2": {"why": "none"}}))
    got = {r["qid"]: (r["also"], r["why"]) for r in jsonl.read_hand_map(spark, str(tmp_path / "map.json")).collect()}
    assert got == {"q1": (["c1", "c2"], "same"), "q2": (None, "none")}
    assert jsonl.read_hand_map(spark, str(tmp_path / "absent.json")).count() == 0
    (tmp_path / "ids.txt").write_text("# note\nq1\n\n  q2  \nq1\n")
    assert sorted(r["qid"] for r in jsonl.read_qids(spark, str(tmp_path / "ids.txt")).collect()) == ["q1", "q2"]
    (tmp_path / "audit.jsonl").write_text("\n".join(json.dumps(x) for x in ({"qid": "q1", "human_verdict": "keep", "decided_at": "1"}, {"qid": "q1", "human_verdict": "drop", "decided_at": "2"})))
    assert [(r["qid"], r["human_verdict"]) for r in jsonl.read_audit(spark, str(tmp_path / "audit.jsonl")).collect()] == [("q1", "drop")]
