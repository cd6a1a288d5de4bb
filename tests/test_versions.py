"""The versioned store, logs that count a batch once, ordered digests and reports."""

import hashlib

import pytest
from pyspark.sql import functions as F

from goldseam import versions
from goldseam.config import EngineError, Settings
from goldseam.operators import evaluation as E
from goldseam.operators import goldset as G
from goldseam.operators import ranks
from goldseam.operators import retrieval as R
from goldseam.operators import summaries as U
from goldseam.operators import vectors as V
from goldseam.sources.chunkstore import ChunkStore
from goldseam.streaming.append_log import append, read_log

SMALL = Settings(chunk_size=5, chunk_overlap=1)


def docs(spark, **texts):
    return spark.createDataFrame([(f"{k}.txt", v) for k, v in texts.items()], "source_doc string, text string")


def held(store, number=None):
    return sorted(tuple(r) for r in store.chunks(number).select("corpus_id", "chunk_id", "text").collect())


def test_store_upserts_prunes_and_indexes_in_one_version(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"))
    with pytest.raises(EngineError):
        store.chunks()
    assert store.ensure(64) == 1 and store.ensure(64) == 1 and held(store) == []
    with pytest.raises(EngineError):
        store.ensure(65)
    report = store.ingest(docs(spark, a="one two three four five six", b="seven eight"), "x", SMALL).first()
    assert (report["documents"], report["chunks"]) == (2, 3) and store.version() == 2
    store.ingest(docs(spark, c="other corpus"), "y", SMALL)
    first = held(store)
    store.ingest(docs(spark, a="one two three four five six", b="seven eight"), "x", SMALL)
    assert held(store) == first  # the same again
    store.ingest(docs(spark, a="one 2"), "x", SMALL)
    assert held(store) == [("x", "a_ch_000", "one 2"), ("y", "c_ch_000", "other corpus")]
    assert held(store, 2) == [x for x in first if x[0] == "x"]  # older versions stay readable
    index = store.index()
    found = V.search(index, store.chunks().where("corpus_id = 'x'").select(F.col("chunk_id").alias("qid"), "vector"), 3, corpus="x")
    assert [r["chunk_id"] for r in found.collect()] == ["a_ch_000"]
    dry = store.ingest(docs(spark, z="nothing is written"), "x", SMALL, dry_run=True).first()
    assert dry["chunks"] == 1 and store.version() == 5
    with pytest.raises(EngineError):
        store.ingest(docs(spark, c="a chunk of y"), "x", SMALL)


def test_a_failure_in_between_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = ChunkStore(spark, str(tmp_path / "s"))
    store.ensure(64)
    store.ingest(docs(spark, a="as it was"), "x", SMALL)
    before = held(store)
    build = V.build
    monkeypatch.setattr(V, "build", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.ingest(docs(spark, a="new"), "x", SMALL)
    monkeypatch.setattr(V, "build", build)
    assert held(store) == before and store.version() == 2
    name, path = versions.staged(store.root)
    spark.range(1).write.parquet(path)
    with pytest.raises(versions.Conflict):
        versions.commit(spark, store.root, 2, name)
    assert held(store) == before


def test_racing_batches_count_once(spark, tmp_path):
    sink = str(tmp_path / "log")
    rows = lambda *x: spark.createDataFrame(list(x), "qid string, v int")
    assert append(spark, sink, rows(("a", 1)), "0") and not append(spark, sink, rows(("a", 2)), "0")
    # two writers that both believe to be first: the folder of the loser belongs to no entry
    one, two = versions.staged(sink), versions.staged(sink)
    rows(("b", 1)).write.parquet(one[1])
    rows(("b", 2)).write.parquet(two[1])
    assert versions.claim(spark, f"{sink}/commits/1", one[0]) and not versions.claim(spark, f"{sink}/commits/1", two[0])
    assert append(spark, sink, rows(("a", 9), ("c", 3)), "2")
    read = lambda **k: sorted(tuple(r) for r in read_log(spark, sink, "qid string, v int", **k).collect())
    assert read() == [("a", 1), ("a", 9), ("b", 1), ("c", 3)] and read(key="qid") == [("a", 1), ("b", 1), ("c", 3)]
    assert read_log(spark, str(tmp_path / "none"), "qid string, v int").collect() == []


def digest(files, fanout, levels=4):
    nodes = [hashlib.sha256(p.encode() + b"\0" + (c or "").encode()).hexdigest() for p, c in sorted(files)]
    for _ in range(levels):
        nodes = [hashlib.sha256("".join(nodes[i : i + fanout]).encode()).hexdigest() for i in range(0, len(nodes), fanout)]
    return nodes[0] if nodes else hashlib.sha256(b"").hexdigest()


def test_digest_depends_on_order_bytes_and_names(spark):
    files = [(f"d/{i:03}.md", f"text {i}") for i in range(50)] + [("e", None)]
    got = lambda rows, **k: ranks.ordered_digest(spark.createDataFrame(rows, "path string, text string").repartition(3), "path", F.col("text"), **k).first()["digest"]
    base = got(files, fanout=4)
    assert base == digest(files, 4) == got(files[::-1], fanout=4)
    assert got([("d/0000.md", files[0][1]), *files[1:]], fanout=4) != base
    assert got([(files[0][0], "text 1"), (files[1][0], "text 0"), *files[2:]], fanout=4) != base
    assert got([]) == digest([], 1024)


def test_places(spark):
    rows = spark.createDataFrame([(i * 7 % 40,) for i in range(40)], "k int").repartition(4)
    assert sorted(tuple(r) for r in ranks.numbered(rows, "k").select("k", "place").collect()) == [(i, i) for i in range(40)]


def test_bootstrap_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, (i * 37 % 11 - 4) / 7) for i in range(23)], "qid int, v double")
    whole = E.bootstrap(rows, "v", 200, 42).first()
    monkeypatch.setattr(E, "VALUES", 5)
    blocks = E.bootstrap(rows, "v", 200, 42).first()
    assert [round(x, 12) for x in whole] == [round(x, 12) for x in blocks]
    values = [(i * 37 % 11 - 4) / 7 for i in range(23)]
    means = sorted(sum(values[int(hashlib.md5(f"42:{b}:{i}".encode()).hexdigest()[:8], 16) % 23] for i in range(23)) / 23 for b in range(200))
    at = 0.025 * 199
    assert whole["low"] == pytest.approx(means[int(at)] + (at - int(at)) * (means[int(at) + 1] - means[int(at)]))


def test_verdict_is_withheld_while_a_tripwire_has_fired(spark):
    ci = lambda low, high: spark.createDataFrame([(0.1, low, high)], "mean double, low double, high double")
    fired = lambda *x: spark.createDataFrame([(v,) for v in x], "fired boolean")
    said = lambda *a: E.decide(*a).first()["verdict"]
    assert said(ci(0.1, 0.3), fired(False, True)) == "withheld"
    assert [said(ci(*x), fired(False)) for x in ((0.1, 0.3), (-0.3, -0.1), (-0.1, 0.1), (0.0, 0.1))] == ["improvement", "regression", "no detectable difference", "no detectable difference"]


def test_quotas_equal_the_plain_loop(spark):
    for sizes in ({"a": 3, "b": 50, "c": 9}, {"a": 1}, {"x": 2, "y": 2, "z": 2}):
        rows = spark.createDataFrame([(k,) for k, n in sizes.items() for _ in range(n)], "k string")
        for total in (0, 5, 20, 500):
            got = {r["k"]: r["quota"] for r in G.quotas(rows, "k", total).collect()}
            assert got == G.allocate(total, sizes)


def test_short_passages_in_texts(spark):
    chunks = spark.createDataFrame([(1, "the cat sat"), (2, "theatre"), (3, None), (4, "sat the cat")], "chunk_id long, text string")
    asked = spark.createDataFrame([(10, "the"), (11, "cat sat"), (12, ""), (13, "the"), (14, "no"), (15, "the cat")], "qid long, question string")
    got = sorted(tuple(r) for r in R.containing(chunks, asked).select("qid", "chunk_id").collect())
    assert got == [(q, c) for q, t in ((10, "the"), (11, "cat sat"), (13, "the"), (15, "the cat")) for c, x in ((1, "the cat sat"), (2, "theatre"), (4, "sat the cat")) if t in x]


def test_reports(spark):
    made = spark.createDataFrame([("keep", "keep", True, None, None), ("keep", "fix", False, "fix", "disputed"), ("drop", "drop", False, "keep", "control")], "screen_verdict string, human_verdict string, blind boolean, second_verdict string, queue_kind string")
    got = {(r["section"], r["name"]): r for r in U.audit(made).collect()}
    assert set(got) == {("overall", "all"), ("verdict", "keep"), ("verdict", "drop"), ("mode", "blind"), ("mode", "revealed"), ("kind", "disputed"), ("kind", "control")}
    assert got["verdict", "keep"]["human_said"] == "keep:1,fix:1" and got["kind", "disputed"]["agreed_with_second"] == 1 and got["overall", "all"]["agreed_with_second"] is None
    supported = lambda *x: [{"supported": v} for v in x]
    records = spark.createDataFrame([("a", 1, None, supported(True, True), 10), ("a", 2, None, supported(True, False), 20), ("b", 1, None, supported(True), 5), ("b", 2, "down", None, 0), ("c", 1, None, [], 1)], "lane_id string, qid int, error string, verdicts array<struct<supported boolean>>, prompt_tokens int")
    judge = {r["lane_id"]: r for r in U.judged(records, 2).collect()}
    assert (judge["a"]["rate"], judge["a"]["complete"], judge["b"]["complete"], judge["b"]["answers"], judge["c"]["grounded"]) == (0.5, True, False, 1, 0)
    board = spark.createDataFrame([("a", 0.5, None), ("b", 0.25, 3.0)], "lane_id string, recall double, ms double")
    good = U.publishable(U.judged(records, 2), 2)
    text = U.document(board, {"split": "test"}, good).first()["document"]
    assert text == '{"split":"test","lanes":[{"lane_id":"a","recall":0.5,"groundedness":0.5},{"lane_id":"b","recall":0.25,"ms":3.0}]}'
    assert U.publishable(U.judged(records, 2), 3).count() == 0  # of another split
    failed = U.document(board, {}, None, spark.createDataFrame([("a", 7, "no")], "lane_id string, qid int, error string")).first()["document"]
    assert failed.endswith('"failures":{"a":[{"qid":7,"error":"no"}]}}')
    with pytest.raises(EngineError):
        U.document(board.limit(0), {})


def test_a_source_that_comes_twice_leaves_its_chunks_once(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"))
    store.ensure(64)
    store.ingest(docs(spark, y="another corpus"), "y", SMALL)
    twice = docs(spark, a="one two three four five six", b="seven").unionByName(docs(spark, a="one two three four five six"))
    store.ingest(twice, "x", SMALL)
    assert [x[1] for x in held(store)] == ["a_ch_000", "a_ch_001", "b_ch_000", "y_ch_000"]


def test_chunks_are_written_once_and_joined_with_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("goldseam.operators.ingest.upsert", lambda *a, **k: 1 / 0)
    store = ChunkStore(spark, str(tmp_path / "s"))
    store.ensure(64)
    store.ingest(docs(spark, a="one two three four five six"), "x", SMALL)
    store.ingest(docs(spark, c="other"), "y", SMALL)
    store.ingest(docs(spark, a="one 2"), "x", SMALL)
    assert held(store) == [("x", "a_ch_000", "one 2"), ("y", "c_ch_000", "other")]
    assert "new" not in versions.names(spark, store._path(None))
