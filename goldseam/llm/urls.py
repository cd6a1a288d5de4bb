"""URL filters: a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import load, prepare

#: The rules of the query: what they do, host and path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Rules that one broadcast trie may hold; longer lists are judged in several passes.
MOST_RULES = 1_000_000

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def parse(url: str | None) -> tuple[str, str]:
    """(host, path) of a url; both empty if it is null or has no ://."""
    rest = (url or "").partition("://")
    if not rest[1]:
        return "", ""
    rest = rest[2]
    cut = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, slash, path = rest[:cut].partition("/")
    return host.translate(LOWER), slash + path


class Trie:
    """Rules by host labels from the right, then by path segments.

    A node of the host trie holds the root of a path trie for rules of exactly
    that host.  A path is walked segment by segment; what follows a rule's last
    slash is a tail that the next segment must start with.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        """Of rules with the same host and path, the last counts."""
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.translate(LOWER).split(".")) if host else ():
                node = node.setdefault(("h", label), {})
            *segments, tail = path.split("/")
            node = node.setdefault("path", {})
            for s in segments:
                node = node.setdefault(("p", s), {})
            node.setdefault("tails", {})[tail] = (verdict, host + path)
            node.setdefault("lengths", set()).add(len(tail))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The verdict and text of the longest rule that fits; of equally long ones that of the longest host."""
        node, best = self.root, None
        segments = path.split("/")
        for label in (None, *(reversed(host.split(".")) if host else ())):
            node = node if label is None else node.get(("h", label))
            if node is None:
                break
            at = node.get("path")
            for s in segments:
                if at is None:
                    break
                if tails := at.get("tails"):
                    # tails of one node differ in nothing else, so the longest is the longest rule: one lookup for each length there is
                    if "order" not in at:
                        at["order"] = sorted(at["lengths"], reverse=True)
                    rule = next((tails[s[:n]] for n in at["order"] if n <= len(s) and s[:n] in tails), None)
                    if rule and (best is None or len(rule[1]) >= len(best[1])):
                        best = rule
                at = at.get(("p", s))
        return best


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row.

    rules are (allow or block, host, path); a rule fits its host and all
    subdomains if the url's path starts with the rule's, and the longest wins,
    whichever verdict it has.  Where none fits, rule is null and verdict the
    default.  Null urls and such without :// have empty host and path, and no
    rule with a host fits them.  Each row is judged by itself without a shuffle,
    so repeated rows, null ids, extra columns, urls of any length and empty
    tables need no special care.  A trie of MOST_RULES rules at most is broadcast;
    a longer list is judged trie by trie in one pass over the rows, and the
    longest of their answers wins, a later one of equal length if its host is not
    shorter, as within a trie.
    """
    rules = list(rules)
    spark = pages.sparkSession
    prepare(spark)
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    kind = source.schema["id"].dataType.simpleString()
    out = source.select("id", "url", F.lit(None).cast("string").alias("rule"), F.lit(0).alias("labels"), F.lit(default).alias("verdict"))
    for at in range(0, max(1, len(rules)), MOST_RULES):
        out = out.mapInArrow(_judge(spark.sparkContext.broadcast(Trie(rules[at : at + MOST_RULES]))), f"id {kind}, url string, rule string, labels int, verdict string")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [parse(u) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p[0] for p in parts], pa.string()), pa.array([p[1] for p in parts], pa.string()), batch.column(2), batch.column(4)], ["id", "host", "path", "rule", "verdict"])

    return out.mapInArrow(split, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)


def _judge(trie):
    """A pass that replaces a row's rule by that of the broadcast trie, if it is longer, or as long with a host of as many labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = trie.value.find
        for batch in batches:
            cols: tuple[list, list, list] = [], [], []
            for url, *old in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                hit = find(*parse(url))
                if hit:
                    labels = len(hit[1].partition("/")[0].split("."))
                    if old[0] is None or (len(hit[1]), labels) >= (len(old[0]), old[1]):
                        old = [hit[1], labels, hit[0]]
                for c, x in zip(cols, old, strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], ["id", "url", "rule", "labels", "verdict"])

    return run


def op3_urls(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return filter_urls(load(spark, sf_dir, "pages"))


QUERIES = {"op3_urls": op3_urls}

ORACLE_SQL = {
    "op3_urls": r"""
with parts as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), split as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts
), rules(verdict, rhost, rpath) as (
  values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), best as (
  select s.page_id, coalesce(s.host, '') as host, coalesce(s.path, '') as path,
         max_by(r.rhost || r.rpath, length(r.rhost || r.rpath)) as rule, max_by(r.verdict, length(r.rhost || r.rpath)) as verdict
  from split s left join rules r on (s.host = r.rhost or ends_with(s.host, '.' || r.rhost)) and starts_with(s.path, r.rpath)
  group by all
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from best
"""
}
