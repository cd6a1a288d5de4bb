"""Ranked lexical search: WAND over document shards, whose heaps are merged."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from goldseam.llm.common import load, prepare, stored, temporary, texts

#: Runs of ASCII letters and digits and of everything beyond ASCII, in UTF-8 bytes; only A-Z are lower-cased.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Documents and postings of a shard at most; a document with more terms is a shard of its own.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 4_000_000
#: Shards that a task searches one after the other, carrying its heaps along.
SHARDS_A_TASK = 4
#: (item, term) rows that one pass over the index answers, so that what is broadcast stays bounded.
MOST_ASKED = 200_000
#: Documents among which pivots are selected at a time: the first stretch fills the heap, later ones grow to the second number.
FIRST, STRETCH = 512, 8192
#: Fixed values of the score.
GAIN, SCALE, LENGTH, FLAT, SLOPE = 1_000_000_000, 1000, 12, 75, 25


@dataclass(frozen=True)
class Index:
    """A table with a row for each shard and term (docs: ascending places in the shard, counts), and one without a term for the shard itself (ids, counts: terms of each document)."""

    table: DataFrame
    docs: int
    tokens: int


def terms_of(text: bytes) -> Counter:
    """The terms of a UTF-8 text and how often each occurs."""
    return Counter(TERM.findall(text.translate(LOWER)))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS) -> Index:
    """Index every term of every whole text where its row lies: nothing is shuffled.

    A null text has no terms, and a text without terms is no document.  Rows without
    an id take no part, as no result could name them; rows that repeat an id are
    documents of their own.  Extra columns are ignored, an empty table is an index
    of nothing.
    """
    source = texts(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    columns = ["shard", "term", "size", "tokens", "ids", "docs", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, number, rows, held = 0, {}, [], 0
        first = TaskContext.get().partitionId() << 32

        def shard(id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            rows.sort(key=lambda r: r[0])
            ids, words, counts = zip(*rows, strict=True)
            sizes = [len(w) for w in words]
            term, count = np.concatenate(words), np.concatenate(counts)
            order = np.argsort(term, kind="stable")  # places stay in ascending order
            place = np.repeat(np.arange(len(ids), dtype="<i4"), sizes)[order]
            ends = np.cumsum(np.bincount(term, minlength=len(number)))
            total = np.array([c.sum() for c in counts], "<i8")
            head = [[first + made], [None], [len(ids)], [int(total.sum())], [list(ids)], [None], [total.tobytes()]]
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.list_(id_type), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(head, kinds, strict=True)], columns)
            names = [w.decode("utf-8", "replace") for w in number]
            count = count[order]
            for lo in range(0, len(names), 4096):
                some = names[lo : lo + 4096]
                edges = np.concatenate([[ends[lo - 1] if lo else 0], ends[lo : lo + 4096]])
                offsets = pa.py_buffer(((edges - edges[0]) * 4).astype("<i4").tobytes())
                lists = [pa.Array.from_buffers(pa.binary(), len(some), [None, offsets, pa.py_buffer(x[edges[0] : edges[-1]].astype("<i4").tobytes())]) for x in (place, count)]
                cols = [pa.array([first + made] * len(some), pa.int64()), pa.array(some), pa.array(np.diff(edges).astype(np.int32)), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.list_(id_type)), *lists]
                yield pa.RecordBatch.from_arrays(cols, columns)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if found := terms_of(text):
                    words = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found))
                    rows.append((i, words, np.fromiter(found.values(), np.int64, len(found))))
                    held += len(found)
                    if len(rows) >= shard_docs or held >= SHARD_POSTINGS:
                        yield from shard(batch.column(0).type)
                        made, number, rows, held = made + 1, {}, [], 0
        if rows:
            yield from shard(batch.column(0).type)

    table = stored(source.mapInArrow(run, f"shard long, term string, size int, tokens long, ids array<{kind}>, docs binary, counts binary"), "shards")
    sums = table.where("term is null").agg(F.sum("size"), F.sum("tokens")).first()
    return Index(table, sums[0] or 0, sums[1] or 0)


def wand(lists: list[tuple[int, int, np.ndarray, np.ndarray]], n: int, k: int, heap: list[tuple], ids: list) -> tuple[list[tuple], int]:
    """(heap, evaluated): the k best (-score, id) of `heap` and of a shard's n documents, and how many were scored.

    lists has a (weight, maximum impact, places, impacts) for each term.  A pivot is
    a document whose terms' maxima, times their weights, reach the heap's threshold;
    only pivots are scored.  They are selected a stretch of documents at a time.
    The lists of the largest maxima propose documents; the others, whose maxima
    together stay below the threshold, can't make a pivot alone, so they are only
    probed, by binary search, for what has been proposed and can still reach it.
    Equal scores reach the threshold, as another shard's id may be larger.
    """
    lists = sorted(lists, key=lambda x: -x[0] * x[1])
    most = [w * top for w, top, _, _ in lists]
    rest = np.cumsum([0, *most[::-1]])[::-1].tolist()  # the sum of the maxima from list j on
    at, step, evaluated = 0, FIRST, 0
    while at < n:
        floor = -heap[-1][0] if len(heap) == k else 1
        if rest[0] < floor:
            break
        end = min(n, at + step)
        lead = next((j for j, x in enumerate(rest) if x < floor), len(lists))
        upper = np.zeros(end - at, np.int64)
        for bound, (_, _, places, _) in zip(most[:lead], lists, strict=False):
            lo, hi = np.searchsorted(places, (at, end))
            upper[places[lo:hi] - at] += bound
        near = np.flatnonzero((upper > 0) & (upper + rest[lead] >= floor))
        for j in range(lead, len(lists)):
            if not len(near):
                break
            places = lists[j][2]
            found = np.searchsorted(places, near + at)
            upper[near] += most[j] * (places[np.minimum(found, len(places) - 1)] == near + at)
            near = near[upper[near] + rest[j + 1] >= floor]
        if len(near):
            evaluated += len(near)
            score = np.zeros(len(near), np.int64)
            for weight, _, places, impacts in lists:
                found = np.minimum(np.searchsorted(places, near + at), len(places) - 1)
                score += weight * impacts[found] * (places[found] == near + at)
            cut = max(floor, np.partition(score, -k)[-k] if len(score) > k else 1)
            best = np.flatnonzero(score >= cut)
            heap = nsmallest(k, [*heap, *((-s, ids[p]) for s, p in zip(score[best].tolist(), (near[best] + at).tolist(), strict=True))])
        at, step = end, min(2 * step, STRETCH)
    return heap, evaluated


def search(index: Index, items: DataFrame, k: int = 20, item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id", most_asked: int = MOST_ASKED) -> DataFrame:
    """(item_col, rank, id_col, score): the k documents of highest score above 0 for each item, ties to smaller ids.

    The items are a stated batch of queries against all documents.  They are
    answered in batches of about most_asked terms, whose terms, weights and item
    numbers are broadcast; each batch reads its terms' postings once.  These are
    dealt by shard, a few shards to a task; a task carries its heaps from shard to
    shard and sends on at most k rows an item, which meet by rank.

    Every row of items is an item by itself, also if it repeats another's id.  A
    null text has no terms and no result.  All but the logarithm is whole-number
    arithmetic of 64 bits, enough for 10^17 documents times terms of one of them.
    The result reads tables in the shared folder: store it in a block of temporary()
    to have them deleted.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    spark = items.sparkSession
    prepare(spark)
    kind = index.table.schema["ids"].dataType.elementType.simpleString()
    asked_items = stored(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text")), "items")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, w.decode("utf-8", "replace"), n) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w, n in terms_of(t).items()]
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64()), strict=True)], ["item", "term", "n"])

    asked = stored(asked_items.select("item", "text").mapInArrow(counted, "item long, term string, n long"), "asked")
    batches = max(1, -(-asked.count() // most_asked))
    found = None
    for b in range(batches):
        part = asked.where(F.pmod(F.xxhash64("item"), F.lit(batches)) == b).collect()  # about most_asked rows
        some = stored(_batch(index, part, k, kind), "heaps")
        found = some if found is None else found.unionByName(some)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked_items.select("item", item_col), "item").select(item_col, "rank", F.col("id").alias(id_col), "score")


def _batch(index: Index, asked: list, k: int, kind: str) -> DataFrame:
    """(item, id, score): each task's k best for the (item, term, n) rows of a batch."""
    spark = index.table.sparkSession
    terms = spark.createDataFrame([(t,) for t in sorted({r["term"] for r in asked})], "term string")
    hits = index.table.where("term is not null").join(F.broadcast(terms), "term", "left_semi")
    held = {r["term"]: r["df"] for r in hits.groupBy("term").agg(F.sum("size").alias("df")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * index.docs + 2) / (2 * df + 1))) for t, df in held.items()}
    queries: dict[int, list[tuple[str, int]]] = {}
    for r in asked:
        if weight.get(r["term"]):
            queries.setdefault(r["item"], []).append((r["term"], weight[r["term"]] * r["n"]))
    shared = spark.sparkContext.broadcast((queries, index.docs, index.tokens))
    shards = index.table.where("term is null")
    count = shards.count()
    tasks = max(1, min(count, max(2 * spark.sparkContext.defaultParallelism, count // SHARDS_A_TASK)))
    columns = ["shard", "term", "ids", "docs", "counts"]
    dealt = shards.select(columns).unionByName(hits.select(columns)).repartition(tasks, "shard").sortWithinPartitions("shard", "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, n_docs, n_tokens = shared.value
        heaps: dict[int, list[tuple]] = {}
        ids, norm, lists = [], None, {}

        def searched() -> None:
            for item, words in queries.items():
                if own := [(w, *lists[t]) for t, w in words if t in lists]:
                    heaps[item], _ = wand(own, len(ids), k, heaps.get(item, []), ids)

        for batch in batches:
            id_type = batch.column(2).type.value_type
            for term, names, docs, counts in zip(batch.column(1).to_pylist(), *(batch.column(c) for c in (2, 3, 4)), strict=True):
                if term is None:  # a shard's own row comes first
                    searched()
                    ids, lists = names.as_py(), {}
                    norm = FLAT + SLOPE * np.frombuffer(counts.as_buffer(), "<i8") * n_docs // n_tokens
                    continue
                places, count = np.frombuffer(docs.as_buffer(), "<i4"), np.frombuffer(counts.as_buffer(), "<i4").astype(np.int64)
                impacts = GAIN * count // (SCALE * count + LENGTH * norm[places])
                lists[term] = (int(impacts.max()), places, impacts)
        searched()
        rows = [(item, i, -s) for item, heap in heaps.items() for s, i in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), id_type, pa.int64()), strict=True)], ["item", "id", "score"])

    return dealt.mapInArrow(run, f"item long, id {kind}, score long")


def op13_wand(spark, sf_dir: str) -> DataFrame:
    """The twenty best documents of each benchmark item."""
    with temporary(spark) as result:
        index = build_index(load(spark, sf_dir, "documents"))
        return result(search(index, load(spark, sf_dir, "benchmark")), "ranked")


QUERIES = {"op13_wand": op13_wand}

ORACLE_SQL = {
    "op13_wand": r"""
with d as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents where doc_id is not null
), c as (
  select count(*) as n_docs, sum(len(w))::bigint as n_terms from d where len(w) > 0
), doc as (
  select row_number() over () as row, doc_id, w, 75 + (25 * len(w) * n_docs) // n_terms as m from d, c where len(w) > 0
), post as (
  select row, term, count(*) as tf from (select row, unnest(w) as term from doc) group by all
), terms as (
  select term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::bigint as weight from (select term, count(*) as df from post group by term), c
), items as (
  select row_number() over () as item, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from benchmark
), asked as (
  select item, item_id, term, count(*) as n from (select item, item_id, unnest(w) as term from items) group by all
), scored as (
  select item, item_id, row, doc_id, sum(n * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
  from asked join terms using (term) join post using (term) join doc using (row) group by all
), ranked as (
  select *, row_number() over (partition by item order by score desc, doc_id)::int as rank from scored where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 20
"""
}
