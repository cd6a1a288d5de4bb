import re

from goldseam.llm import licences

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for p, label in BASE.items():
        p = p.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_against_brute_force(spark, docs):
    texts = [None, "", "...", "MIT License", "mit\n-license é", "the MİT license", "smit license", "Apache License, version 2; apache  license", "GNU General Public License", "general public general public license mit license", "x " * 50000 + "mit license", "permit license mit", "ＭIT license", "mit licenses"]
    got = {r["doc_id"]: r for r in licences.scan(docs([*enumerate(texts), (None, "mit license")])).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_templates_found_by_position(spark, docs):
    bsd, mit = licences.TEMPLATES["bsd"][0], licences.TEMPLATES["mit"][0]
    scrambled = " ".join(sorted(bsd.split()))
    filler = [(100 + i, "some other words that use source and the software in any form") for i in range(30)]
    rows = [(1, "start of file\n * " + bsd.upper().replace(" ", "\n * ")), (2, scrambled), (3, mit), (4, mit.replace("permission", "promise")), (5, "x " + bsd.replace("met", "MET") + " y " + mit)]
    got = {r["doc_id"]: r["labels"] for r in licences.scan(docs([*rows, *filler])).collect()}
    assert (got[1], got[2], got[3], got[4], got[5]) == ("bsd", "", "mit", "", "bsd,mit")
    assert not any(got[i] for i, _ in filler)


def test_file_with_all_templates(spark, docs):
    every = "\n\n".join(t for t, _ in licences.TEMPLATES.values())
    some = " and ".join(licences.TEMPLATES[k][0] for k in ("mit", "apache", "gpl", "bsd", "cc"))
    filler = [(100 + i, "some other words that use source and the software in any form") for i in range(30)]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licences.scan(docs([(1, every), (2, some), *filler])).collect()}
    assert got[1] == (",".join(sorted(licences.TEMPLATES)), 1.0)
    assert got[2] == ("apache,bsd,cc,gpl,mit", 1.0)


def test_empty_table_and_plan(spark, docs):
    out = licences.scan(docs([]))
    assert out.count() == 0
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().toString())
