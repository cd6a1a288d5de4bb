import pytest

from goldseam.config import EngineError
from goldseam.sources import jsonl
from goldseam.streaming.append_log import read_log, resume


def test_split_and_folder(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"qid": "b", "question": "q", "gold_chunk_ids": ["x"]}\n{"qid": "a", "gold_chunk_ids": ["y"]}\n')
    assert [r["qid"] for r in jsonl.read_split(spark, str(tmp_path / "s.json")).collect()] == ["a", "b"]
    (tmp_path / "bad.json").write_text('{"qid": "b", "gold_chunk_ids": []}\n')
    with pytest.raises(EngineError):
        jsonl.read_split(spark, str(tmp_path / "bad.json"))
    (tmp_path / "c" / "d").mkdir(parents=True)
    (tmp_path / "c" / "d" / "x.MD").write_text("é")
    (tmp_path / "c" / "no.csv").write_text("n")
    assert [tuple(r) for r in jsonl.discover(spark, str(tmp_path / "c")).collect()] == [("d/x.MD", "é")]


def test_what_readers_refuse(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"qid": "b", "gold_chunk_ids": ["x"], "status": "kept"}\n{"qid": "a", "gold_chunk_ids": [], "status": "draft"}\n')
    assert [r["qid"] for r in jsonl.read_split(spark, str(tmp_path / "s.json"), statuses=("kept",)).collect()] == ["b"]
    with pytest.raises(EngineError, match="a"):
        jsonl.read_split(spark, str(tmp_path / "s.json"))
    with pytest.raises(EngineError, match="no folder"):
        jsonl.discover(spark, str(tmp_path / "missing"))
    (tmp_path / "f").mkdir()
    for name in ("b.md", "a.txt", "c.csv"):
        (tmp_path / "f" / name).write_text(name)
    assert [r["source_doc"] for r in jsonl.discover(spark, str(tmp_path / "f")).collect()] == ["a.txt", "b.md"]
    with pytest.raises(EngineError, match="c.csv"):
        jsonl.discover(spark, str(tmp_path / "f"), strict=True)


def test_resume_skips_what_is_done(spark, tmp_path):
    source, sink, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    run = lambda rows: (jsonl.write_jsonl(spark.createDataFrame(rows, "qid string, v int"), source, append=True), resume(spark, source, "qid string, v int", lambda d: d, sink, ck).awaitTermination())
    run([("a", 1), ("b", 2)])
    run([("b", 9), ("c", 3)])
    assert sorted(tuple(r) for r in read_log(spark, sink, "qid string, v int").collect()) == [("a", 1), ("b", 2), ("c", 3)]
