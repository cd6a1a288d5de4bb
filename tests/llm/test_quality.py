import random
import re

from pyspark.sql import functions as F

from goldseam.llm import quality

WHITE = " \t\n\x0b\x0c\r"


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {j for v in windows.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if x.strip(WHITE)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_statistics_against_brute_force(spark, docs):
    r = random.Random(5)
    texts = [None, "", " \n\t", "a", "a\xa0b \x1c c", "x " * 8, "x " * 9, "one two\n\none two\n \n \none two ", "é#*|| <>$%&", "a b c d e f g h " * 2 + "z " + "a b c d e f g h i", "long word " * 40000]
    texts += [r.choice([" ", "\n", " \x0b"]).join(r.choices("ab", k=r.randint(1, 60))) for _ in range(60)]
    texts += ["\n".join(" ".join(r.choices(["p", "q", "rst"], k=r.randint(0, 5))) for _ in range(20)) for _ in range(20)]
    got = quality.statistics(docs([*enumerate(texts), (None, "null id"), (1, "")])).collect()
    have = {r["doc_id"]: tuple(r)[1:] for r in got if r["doc_id"] is not None}
    assert have == {i: brute(t) for i, t in enumerate(texts)}
    assert len(got) == len(texts) + 2


def test_learns_and_keeps_the_clean(spark, docs):
    r = random.Random(6)
    words = [f"w{i}x" * r.randint(1, 2) for i in range(400)]
    rows, labels = [], []
    for i in range(900):
        w = r.choices(words, k=r.randint(30, 80))
        bad = i % 5 == 0
        rows.append((i, " ".join(x + "*#" * (r.random() < 0.7) if bad else x for x in w)))
        if i % 2:
            labels.append((i, 1 - bad, 0))
    labels += [(5000, 0, 0), (3, None, 0)]
    out = quality.quality_rules(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    wrong = sum(x["kept"] == (x["doc_id"] % 5 == 0) for x in out)  # half of them were never labelled
    assert len(out) == 900 and wrong <= 5
    assert {x["rule"] for x in out} >= {None, 1}


def test_without_labels_or_rows(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.quality_rules(docs([(1, "a " * 10), (2, " ".join(map(str, range(50))))]), labels).collect()
    assert sorted((r["doc_id"], r["kept"], r["rule"]) for r in out) == [(1, False, 0), (2, True, None)]
    assert quality.quality_rules(docs([]), labels).count() == 0


def test_plan_has_no_python(spark, docs):
    plan = quality.quality_rules(docs([(1, "a")]), spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange hash", plan)
    assert F is not None
