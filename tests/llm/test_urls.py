import random

import pytest

from goldseam.llm import urls


def brute(url, rules):
    host, path = urls.parse(url)
    fit = [(v, h + p) for v, h, p in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit, key=lambda r: len(r[1]))[::-1] if fit else (None, "allow")))


@pytest.mark.parametrize("url, host, path", [(None, "", ""), ("", "", ""), ("no scheme/x", "", ""), ("http://A.Com", "a.com", ""), ("http://É.com?x=/y", "É.com", ""), ("http://a.b/c//d#e?f", "a.b", "/c//d"), ("x://?q", "", ""), ("a://b://c/d", "b:", "//c/d")])
def test_parse(url, host, path):
    assert urls.parse(url) == (host, path)


def test_against_brute_force(spark):
    r = random.Random(3)
    rules = [*urls.RULES, ("block", "blog.example.com", "/en/a"), ("block", "", "/never"), ("allow", "org", "/x/y/"), ("block", "example.org", "/")]
    hosts = ["example.com", "www.example.com", "notexample.com", "x.net", "net", "blog.example.com", "EXAMPLE.org", "", "com", "a.b.example.com."]
    rows = [(i, f"https://{r.choice(hosts)}{r.choice(['', '/', '/en', '/en/', '/en/abc', '/es/1', '/x/y/z', '/never', '/x//y'])}{r.choice(['', '?q', '#f'])}") for i in range(400)]
    rows += [(1, None), (None, "http://x.net/es/"), (7, "http://x.net/es/" + "long/" * 50000)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "page_id long, url string, host string")
    got = sorted((tuple(x) for x in urls.filter_urls(df, rules).collect()), key=repr)
    want = []
    for i, u in rows:
        host, path, rule, verdict = brute(u, rules)
        want.append((i, host, path, rule, verdict))
    assert got == sorted(want, key=repr)
    assert urls.filter_urls(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1, 2, 4])
def test_long_lists_are_judged_trie_by_trie(spark, monkeypatch, most):
    rules = [*urls.RULES, ("block", "blog.example.com", "/en/a"), ("allow", "org", "/x/y/"), ("block", "example.org", "/")]
    rows = [(i, f"http://{h}{p}") for i, (h, p) in enumerate((h, p) for h in ("example.com", "www.example.com", "blog.example.com", "x.net", "example.org") for p in ("", "/", "/en/", "/en/abc", "/es/1", "/x/y/z"))]
    df = spark.createDataFrame(rows, "page_id long, url string")
    want = sorted(tuple(x) for x in urls.filter_urls(df, rules).collect())
    monkeypatch.setattr(urls, "MOST_RULES", most)
    assert sorted(tuple(x) for x in urls.filter_urls(df, rules).collect()) == want
    assert [(i, *brute(u, rules)) for i, u in rows] == want


def test_many_rules_of_one_folder():
    """Told by a lookup for each length of their ends, not one by one."""
    import time

    from goldseam.llm.urls import Trie

    trie = Trie([("block", "ex.com", f"/a/x{i}") for i in range(100_000)] + [("allow", "ex.com", "/a/x77y")])
    assert trie.find("www.ex.com", "/a/x77yz") == ("allow", "ex.com/a/x77y") and trie.find("ex.com", "/a/x123456") == ("block", "ex.com/a/x12345")
    assert trie.find("ex.com", "/a/y") is None and trie.find("ex.com", "/a") is None
    began = time.process_time()
    for i in range(2000):
        trie.find("ex.com", f"/a/x{i}/page")
    assert (time.process_time() - began) / 2000 < 100e-6
