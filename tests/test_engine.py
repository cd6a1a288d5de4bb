"""Small cases of the retrieval engine with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from goldseam.config import EngineError, LeakageError, Settings, SlugCollision
from goldseam.functions import text as T
from goldseam.operators import evaluation as E
from goldseam.operators import goldset as G
from goldseam.operators import ingest as I
from goldseam.operators import retrieval as R
from goldseam.operators.components import connected_components


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first()["y"]


def plain_windows(n, size, overlap):
    """Starts until a window reaches the end."""
    starts, at = [], 0
    while n and (not starts or starts[-1] + size < n):
        starts.append(at)
        at += size - overlap
    return starts


def test_windows(spark):
    rows = [(n, size, overlap) for n in (0, 1, 12, 13, 40, 41) for size, overlap in ((1, 0), (12, 0), (13, 4), (7, 6))]
    for size, overlap in {r[1:] for r in rows}:
        got = spark.createDataFrame([(r[0],) for r in rows if r[1:] == (size, overlap)], "n int").select("n", T.window_starts(F.col("n"), size, overlap).alias("w"))
        assert all(r["w"] == plain_windows(r["n"], size, overlap) for r in got.collect())


def test_a_chunk_has_no_negative_number(spark):
    with pytest.raises(Exception, match="must not be negative"):
        one(spark, "x", lambda x: T.chunk_id(x, F.lit(-1)))


def test_chunks_by_the_tokens_of_a_model(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    vocab = public_tokenizers.path("byte_bpe_50k.json")
    texts = {"a.md": "Überall  gibt's naïve Wörter,\nund 日本語 too. " * 5, "b.md": "", "c.md": "one", "d.md": None, "e.md": "<|endoftext|> is text"}
    df = spark.createDataFrame(list(texts.items()), "source_doc string, text string")
    got = {r["chunk_id"]: r for r in I.chunk_by_spans(df, 10, 3, I.model_spans(vocab)).collect()}
    model = Tokenizer.from_file(vocab)
    model.encode_special_tokens = True
    want = 0
    for name, text in texts.items():
        spans = [x for x in model.encode(text or "", add_special_tokens=False).offsets if x[1] > x[0]]
        for i, first in enumerate(plain_windows(len(spans), 10, 3)):
            part, r = spans[first : first + 10], got[f"{name[0]}_ch_{i:03}"]
            assert (r["start_char"], r["end_char"]) == (min(x[0] for x in part), max(x[1] for x in part)) and r["text"] == text[r["start_char"] : r["end_char"]]
            want += 1
    assert len(got) == want


def test_only_windows_of_tokens_leave_a_worker(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    vocab, text = public_tokenizers.path("byte_bpe_50k.json"), "some words of a text " * 500
    n = len(Tokenizer.from_file(vocab).encode(text, add_special_tokens=False).offsets)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    I.chunk_by_spans(spark.createDataFrame([("a.md", text)], "source_doc string, text string"), 100, 0, I.model_spans(vocab))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "512"
    assert one(spark, text, lambda x: F.size(I.model_spans(vocab)(x, 100, 0))) == -(-n // 100)


def test_text_functions(spark):
    assert one(spark, "\r\n a\r\rb\n\n\n\nc \t\n", T.normalise_text) == "a\n\nb\n\nc"
    assert one(spark, "Dir\\Guide Notes.md", T.slug) == "dir_guide_notes"
    assert one(spark, "x", lambda x: T.chunk_id(x, F.lit(1234))) == "x_ch_1234"
    assert one(spark, "x", lambda x: T.chunk_id(x, F.lit(7))) == "x_ch_007"
    assert one(spark, "hm\n yes it is", T.judgement) is True and one(spark, "Nobody", T.judgement) is None
    assert one(spark, "number 3", lambda x: T.label_choice(x, 3)) == 3 and one(spark, "none, 3", lambda x: T.label_choice(x, 3)) is None
    assert one(spark, "Use e.g. this. Then  stop! ok", T.split_sentences) == ["Use e.g. this.", "Then stop! ok"]


def test_chunks_are_slices(spark):
    df = spark.createDataFrame([("river/Delta-1.md", " ".join(f"stone{i}" for i in range(23))), ("Sea log.txt", "\tone two\n\n\nthree  four"), ("empty.md", " \n")], "source_doc string, text string")
    text = {r["source_doc"]: r["text"] for r in df.collect()}
    rows = I.chunk_documents(df, 8, 3).collect()
    assert {r["chunk_id"] for r in rows} == {*(f"river_delta_1_ch_00{i}" for i in range(4)), "sea_log_ch_000"}
    assert all(text[r["source_doc"]][r["start_char"] : r["end_char"]] == r["text"] for r in rows)
    with pytest.raises(SlugCollision):
        I.chunk_documents(spark.createDataFrame([("a.md", "x"), ("A.txt", "y")], "source_doc string, text string"), 5, 2)


def test_upsert_and_prune(spark):
    old = spark.createDataFrame([(1, "c", "a"), (2, "c", "b"), (3, "d", "z")], "chunk_id int, corpus_id string, text string")
    new = spark.createDataFrame([(2, "c", "B"), (4, "c", "n")], old.schema)
    assert sorted(tuple(r) for r in I.upsert(old, new).collect()) == [(1, "c", "a"), (2, "c", "B"), (3, "d", "z"), (4, "c", "n")]
    assert sorted(r[0] for r in I.prune(old, new.limit(0), "c").collect()) == [3]


def test_bm25_floor_and_backfill(spark):
    chunks = spark.createDataFrame([(1, "cat dog"), (2, "cat fish"), (3, "dog fish"), (4, "bird")], "chunk_id int, text string")
    index = R.build_index(chunks)
    q = spark.createDataFrame([(1, "bird bird"), (2, ""), (3, "unknown")], "qid int, question string")
    got = R.bm25_search(index, q, 2, backfill=True).orderBy("qid", "rank").collect()
    idf = math.log(3.5) - math.log(1.5)
    avgdl = 7 / 4
    want = 2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 / avgdl))
    assert [(r["qid"], r["chunk_id"], r["rank"]) for r in got] == [(1, 4, 1), (1, 1, 2), (3, 1, 1), (3, 2, 2)]
    assert got[0]["score"] == round(want, 6)
    with pytest.raises(ValueError):
        R.bm25_search(index, q, 0)


def test_rrf_pays_an_id_once_a_list(spark):
    arms = spark.createDataFrame([("a", 1, "x", 1), ("a", 1, "x", 2), ("a", 1, "y", 3), ("b", 1, "y", 1)], "list_id string, qid int, chunk_id string, rank int")
    got = {r["chunk_id"]: r["score"] for r in R.rrf(arms, 60).collect()}
    assert got == {"x": round(1 / 61, 9), "y": round(1 / 63 + 1 / 61, 9)}


def test_metrics_equal_a_plain_loop(spark):
    ranks = {q: (q * 5) % 14 + 1 for q in range(1, 12)}  # where each question's only gold chunk stands
    found = spark.createDataFrame([("l", q, c, c) for q in ranks for c in range(1, 13)], "lane_id string, qid int, chunk_id int, rank int")
    gold = spark.createDataFrame(list(ranks.items()), "qid int, chunk_id int")
    for k in (1, 4, 12):
        got = E.outcomes(gold, found, gold, k).agg(F.avg(F.col("hit").cast("int")), F.avg("rr")).first()
        hits = [r for r in ranks.values() if r <= min(k, 12)]
        assert math.isclose(got[0], len(hits) / 11) and math.isclose(got[1], sum(1 / r for r in hits) / 11)


@pytest.mark.parametrize("a, b", [(9, 2), (4, 4), (0, 0), (1, 0), (0, 13)])
def test_mcnemar(spark, a, b):
    rows = [(i, True, False) for i in range(a)] + [(100 + i, False, True) for i in range(b)] + [(999, True, True)]
    got = E.mcnemar(spark.createDataFrame(rows, "qid int, hit_a boolean, hit_b boolean")).first()
    tail = sum(math.comb(a + b, i) for i in range(max(a, b), a + b + 1)) / 2 ** (a + b)
    assert (got["a_only"], got["b_only"]) == (a, b) and math.isclose(got["p_value"], min(1.0, 2 * tail))


def test_kappa_and_pairing(spark):
    pairs = [(i % 3 > 0, i % 4 > 0) for i in range(17)]
    df = spark.createDataFrame(pairs, "a boolean, b boolean")
    same = sum(x == y for x, y in pairs) / 17
    a, b = (sum(p[i] for p in pairs) / 17 for i in (0, 1))
    chance = a * b + (1 - a) * (1 - b)
    assert math.isclose(E.kappa(df, "a", "b").first()["kappa"], (same - chance) / (1 - chance))
    assert E.kappa(df.select(F.lit(True).alias("a"), "b"), "a", "b").first()["kappa"] == 0.0
    out = spark.createDataFrame([("x", 1, True, 1.0), ("y", 2, True, 1.0)], "lane_id string, qid int, hit boolean, rr double")
    with pytest.raises(EngineError):
        E.paired(out, "x", "y")


def test_components_allocate_and_split(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (7, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[101] == 100
    assert G.allocate(10, {"a": 2, "b": 50, "c": 50}) == {"a": 2, "b": 4, "c": 4}
    groups = spark.createDataFrame([(1, 5), (2, 3), (3, 2)], "group long, n long")
    sides = {r["group"]: r["split"] for r in G.grouped_split(groups, 0.5, 42).collect()}
    assert sides[1] == "train" and sides[2] == sides[3] == "test"
    with pytest.raises(LeakageError):
        G.check_no_shared_chunks(spark.createDataFrame([(1, 9, "train"), (2, 9, "test")], "qid int, chunk_id int, split string"))


def test_fences_and_verdicts(spark):
    assert one(spark, "", G.non_prose_fraction) == 1.0
    assert one(spark, "text\n```py\ncode\n```\nend", G.non_prose_fraction) == len("```py\ncode\n```\n") / len("text\n```py\ncode\n```\nend")
    df = spark.createDataFrame([(True, False), (False, True), (None, True), (False, False)], "d boolean, f boolean")
    v, r = G.rule_verdict({"d": F.col("d"), "f": F.col("f")}, ("d",), ("f",))
    assert [tuple(x) for x in df.select(v, r).collect()] == [("drop", "d"), ("fix", "f"), ("unscored", None), ("keep", None)]


@pytest.mark.parametrize("q, p, n", [("the cat sat on a mat", "a cat sat on a dog", 4), ("a b c d e", "x a b c d e y", 5), ("", "a", 0)])
def test_longest_overlap(spark, q, p, n):
    df = spark.createDataFrame([(1, q, p)], "qid int, question string, passage string")
    assert G.longest_overlap(df).first()["length"] == n


@pytest.mark.parametrize("bad", [{"chunk_size": 0}, {"chunk_overlap": 512}, {"rerank_depth": 60}, {"rrf_k": 0}])
def test_settings(bad):
    with pytest.raises(ValueError):
        Settings(**bad)
