"""The stages one after the other against brute force on a small corpus."""

import random

import corpus_pipeline as P
import numpy as np
import public_tokenizers


def test_stages_against_brute_force(spark, tmp_path):
    r = random.Random(8)
    words = [f"w{i}é" for i in range(500)]
    passage = " ".join(r.choices(words, k=52))
    rows = []
    for i in range(60):
        text = " ".join(r.choices(words, k=r.randint(30, 90)))
        if i % 7 == 0:
            text += " " + passage
        if i % 10 == 3:
            text = rows[i - 3][1] + " tail"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(100, "too short", "en", "s0", 9), (101, None, None, None, None), (102, "same " * 40, "en", "s1", 200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = P.load(spark, str(tmp_path), "documents"), []
    for name, stage in P.STAGES:
        docs = P.stored(stage(spark, docs, str(tmp_path)), name.replace(" ", "-"))
        kept.append({x["doc_id"]: x for x in docs.collect()} if name != "packing" else docs.collect())
    assert set(kept[0]) == set(range(60))
    shingles = {i: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)} for i, t, *_ in rows[:60]}
    like = lambda a, b: 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b])
    assert set(kept[1]) == {i for i in range(60) if not any(like(i, j) for j in range(i))}
    left = {i: kept[1][i]["text"].encode() for i in kept[1]}
    seen: dict = {}
    for i, t in left.items():
        for k in range(len(t) - P.PASSAGE + 1):
            seen.setdefault(t[k : k + P.PASSAGE], []).append((i, k))
    for i, t in left.items():
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - P.PASSAGE + 1):
            if len(seen[t[k : k + P.PASSAGE]]) > 1:
                gone[k : k + P.PASSAGE] = True
        assert kept[2][i]["text"] == bytes(np.frombuffer(t, np.uint8)[~gone]).decode("utf-8", "ignore")
        assert kept[2][i]["n_chars"] == len(kept[2][i]["text"])
    assert passage in "".join(x["text"] for x in kept[1].values()) and passage not in "".join(x["text"] for x in kept[2].values())
    assert sum(kept[2][i] == kept[1][i] for i in kept[1]) > 30  # texts without the passage are left alone
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = {i: len(tok.encode(x["text"], add_special_tokens=False).ids) + 1 for i, x in kept[2].items()}
    got: dict = {}
    for p in kept[3]:
        got[p["doc_id"]] = got.get(p["doc_id"], 0) + p["length"]
    assert got == size


def test_removal_keeps_replacement_characters_of_the_source(spark):
    r = random.Random(9)
    passage, a, b, c = ("".join(r.choices("abcdefghij", k=k)) for k in (600, 90, 90, 90))
    # the shared string starts with the second byte of the character before the passage and ends with the first of that after it
    rows = [(1, f"\ufffd{a}\ufffdé{passage}ã\ufffd{a}"), (2, f"{b}ĩ{passage}á{b}\ufffd"), (3, f"\ufffd{c}")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x["doc_id"]: (x["text"], x["n_chars"]) for x in P.repeats(spark, docs, "").collect()}
    want = {1: f"\ufffd{a}\ufffd\ufffd{a}", 2: f"{b}{b}\ufffd", 3: f"\ufffd{c}"}
    assert got == {i: (t, len(t)) for i, t in want.items()}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=80):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(3, 8))) for _ in range(n))


def whole_run(spark, tmp_path, rows, labels, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
    docs, kept = P.load(spark, str(tmp_path), "documents"), []
    for name, stage in P.STAGES:
        docs = P.stored(stage(spark, docs, str(tmp_path)), name.replace(" ", "-"))
        kept.append(docs.collect())
    return kept


def test_rows_that_repeat_an_id(spark, tmp_path):
    a, b, c, d, e = map(prose, range(5))
    rows = [(1, a), (1, a), (2, b), (3, c), (3, d), (None, e), (None, e + " tail"), (None, prose(9)), (7, a + " end")]
    kept = whole_run(spark, tmp_path, [(i, t, "en", "s", len(t)) for i, t in rows], [(1, 1, 0)])
    want = sorted([(1, a), (2, b), (3, c), (3, d), (None, e), (None, prose(9))], key=str)
    for stage in kept[1:3]:  # either of the two without an id, as they are read
        stage[:] = [x.asDict() | {"text": x["text"].removesuffix(" tail")} for x in stage]
    assert sorted(((x["doc_id"], x["text"]) for x in kept[1]), key=str) == want
    assert sorted(((x["doc_id"], x["text"]) for x in kept[2]), key=str) == want  # nothing that stays repeats
    assert len({(x["doc_id"], x["doc_tokens"], x["start"]) for x in kept[3]}) == len(kept[3])


def test_smallest_id_stays_whatever_the_order_of_rows(spark, tmp_path):
    a = prose(1)
    kept = whole_run(spark, tmp_path, [(i, f"{a} t{i}", "en", "s", 1) for i in (9, 4, None, 6)], [(1, 1, 0)])
    assert [x["doc_id"] for x in kept[1]] == [4]


def test_empty_tables(spark, tmp_path):
    assert whole_run(spark, tmp_path, [], []) == [[], [], [], []]


def test_nulls_clashing_columns_and_long_texts(spark, tmp_path):
    names = "row long, id string, key string, component_id long, kept boolean, spans string"
    long = " ".join(prose(100 + i, 2000) for i in range(20)) + " " * 1_100_000 + "end"
    rows = [(1, prose(1), None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, long, "en", "s", len(long))]
    kept = whole_run(spark, tmp_path, [(*r, 5, "x", "y", 6, False, "z") for r in rows], [(None, 1, 0), (1, None, None)], f"{SCHEMA}, {names}")
    for stage, text in zip(kept[:3], (long, long, long.replace("  ", "").replace("  ", "")), strict=True):  # the blanks are a string that repeats
        assert {x["doc_id"]: x["text"] for x in stage} == {1: rows[0][1], 4: text} and stage[0].__fields__ == P.COLUMNS
    assert {x["doc_id"] for x in kept[3]} == {1, 4}


def test_learned_list_rejects_what_labels_call_bad(spark, tmp_path):
    """Documents full of symbols are labelled bad: others like them go, clean ones stay."""
    r = random.Random(4)
    bad = lambda i: " ".join(w + ("#" if r.random() < 0.6 else "") for w in prose(i).split())
    rows = [(i, bad(i) if i % 2 else prose(i), "en", "s", 1) for i in range(400)]
    kept = whole_run(spark, tmp_path, rows, [(i, 1 - i % 2, 0) for i in range(300)])
    assert {x["doc_id"] for x in kept[0]} == set(range(0, 400, 2))


def test_run_deletes_what_stages_store(spark, tmp_path):
    from pathlib import Path

    from goldseam.store import shared_dir

    spark.createDataFrame([(1, prose(1), "en", "s", 1)], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    tables = lambda: set(Path(shared_dir(spark).removeprefix("file://"), "goldseam").glob("*"))
    before = tables()
    assert {x["doc_id"] for x in P.run(spark, str(tmp_path)).collect()} == {1}
    assert [p.name.rpartition("-")[0] for p in tables() - before] == ["packing"]
