"""Ranked retrieval for whole batches of questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldseam.config import EngineError
from goldseam.functions import text as T
from goldseam.store import stored

#: Fixed values of the ranking function: term saturation, length weight, floor of negative weights.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Terms of questions that one pass over the index answers, so that what is broadcast stays bounded.
MOST_ASKED = 200_000
#: Chunks of a block of postings.
BLOCK = 4096
#: Tasks of a search, or twice the session's cores if these are more: each keeps k rows a question.
TASKS = 32
#: Chunks of a block and queries of a group that one matrix product compares.
CHUNKS, ASKED = 4096, 512
#: Fixed value: words of a passage that a pair model reads.
MODEL_WORDS = 512
#: Passages that one automaton holds, letters of all that it has to compare, and first letters of each that it seeks.
PATTERNS, LETTERS, HEAD = 100_000, 32_000_000, 64
#: Words in a row by which passages and texts meet.
SHARED = 3


@dataclass(frozen=True)
class Bm25Index:
    """blocks (ids, lengths, words, sizes, places, counts: the postings of up to BLOCK chunks side by side), terms(term, df, idf), corpus(n, avgdl) and chunks(chunk_id), written once."""

    blocks: DataFrame
    terms: DataFrame
    corpus: DataFrame
    chunks: DataFrame


def build_index(chunks: DataFrame) -> Bm25Index:
    """Index (chunk_id, text).  A term whose raw weight is negative gets EPSILON times the mean raw weight of all terms.

    A task counts the terms of the batches that it reads and packs them into
    blocks: nothing is shuffled before document frequencies.  No chunks, or chunks
    without any term, raise EngineError: they have no mean length.
    """
    words = chunks.select("chunk_id", T.tokens(T.nfkc(F.col("text"))).alias("w"))
    kind = chunks.schema["chunk_id"].dataType.simpleString()

    def counted(batch: pa.RecordBatch) -> tuple:
        """(ids, lengths, different words, and of each posting its word's number, its row and its count)."""
        lists = batch.column(1)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        coded = lists.flatten().dictionary_encode()
        n = max(len(batch), 1)
        keys = coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(len(batch)), lengths)
        keys, counts = np.unique(keys, return_counts=True)
        return batch.column(0), lengths, coded.dictionary, keys // n, keys % n, counts.astype("<i4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def packed() -> pa.RecordBatch:
            ids, lengths, each, codes, places, counts = zip(*held, strict=True)
            words = pa.concat_arrays(each).dictionary_encode()
            numbers = np.split(words.indices.to_numpy(), np.cumsum([len(x) for x in each])[:-1])
            code = np.concatenate([n[c] for n, c in zip(numbers, codes, strict=True)])
            first = np.cumsum([0, *map(len, ids)])
            place = np.concatenate([p + lo for p, lo in zip(places, first, strict=False)]).astype("<i4")
            order = np.argsort(code, kind="stable")  # places stay in ascending order
            cols = [[x for i in ids for x in i.to_pylist()], np.concatenate(lengths).tolist(), words.dictionary.to_pylist(), np.bincount(code, minlength=len(words.dictionary)).tolist()]
            cols += [place[order].tobytes(), np.concatenate(counts)[order].tobytes()]
            kinds = [pa.list_(ids[0].type), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, kinds, strict=True)], ["ids", "lengths", "words", "sizes", "places", "counts"])

        for batch in batches:
            for lo in range(0, len(batch), BLOCK):
                part = batch.slice(lo, BLOCK)
                if held and sum(len(x[0]) for x in held) + len(part) > BLOCK:
                    yield packed()
                    held = []
                held.append(counted(part))
        if held:
            yield packed()

    table = stored(words.mapInArrow(run, f"ids array<{kind}>, lengths array<int>, words array<string>, sizes array<int>, places binary, counts binary"), "postings")
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)
    corpus = stored(table.agg(F.sum(F.size("ids")).alias("n"), (F.sum(total) / F.sum(F.size("ids"))).alias("avgdl")), "corpus")
    if not corpus.first()["avgdl"]:
        raise EngineError("no chunk has a term to index")
    pairs = table.select(F.explode(F.arrays_zip("words", "sizes")).alias("x")).select(F.col("x.words").alias("term"), F.col("x.sizes").alias("n"))
    raw = pairs.groupBy("term").agg(F.sum("n").alias("df")).crossJoin(corpus.select("n"))
    raw = raw.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = raw.agg((EPSILON * F.avg("raw")).alias("floor"))
    terms = raw.crossJoin(floor).select("term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    return Bm25Index(table, stored(terms, "terms"), corpus, chunks.select("chunk_id"))


def ranked(scored: DataFrame, k: int, by: str = "qid", digits: int = 6) -> DataFrame:
    """The k best (by, chunk_id, score) rows with their rank: by rounded score, ties to smaller ids."""
    if k <= 0:
        raise ValueError("k must be positive")
    order = Window.partitionBy(by).orderBy(F.round("score", digits).desc(), F.col("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("score", F.round("score", digits))


class Postings:
    """A block's postings as (places, parts, largest part) by term; a part is what a term of weight 1 adds to a chunk's score."""

    def __init__(self, row: dict, avgdl: float, asked: list[str]):
        ids = row["ids"].as_py()
        order = sorted(range(len(ids)), key=ids.__getitem__)
        #: ascending, so that ties go to smaller ids
        self.ids = [ids[i] for i in order]
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        norm = K1 * (1 - B + B * row["lengths"].values.to_numpy() / avgdl)
        ends = np.cumsum(row["sizes"].values.to_numpy())
        places, counts = (np.frombuffer(row[c].as_py(), "<i4") for c in ("places", "counts"))
        self.terms = {}
        for term, at in zip(asked, pc.index_in(pa.array(asked, pa.string()), row["words"].values).to_pylist(), strict=True):
            if at is not None:
                lo, hi = ends[at - 1] if at else 0, ends[at]
                place, tf = places[lo:hi], counts[lo:hi].astype(np.float64)
                parts = tf * (K1 + 1) / (tf + norm[place])
                sort = np.argsort(rank[place])
                self.terms[term] = (rank[place][sort], parts[sort], float(parts.max()))

    def best(self, words: list[tuple[str, float]], k: int, least: float, own) -> list[tuple[float, object]]:
        """The (score, id) of the block's chunks that have a word, the k best of those that reach `least`; `own` is no candidate.

        Lists are taken by descending bound (weight times largest part).  Once those
        left can't lift a chunk to `least` alone, they are only probed for the chunks
        seen so far, and chunks that can't reach it any more are dropped.
        """
        lists = sorted(((w * self.terms[t][2] if w > 0 else 0.0, w, *self.terms[t][:2]) for t, w in words if t in self.terms), key=lambda x: -x[0])
        rest = np.cumsum([0.0, *(x[0] for x in lists[::-1])])[::-1]
        if not lists or rest[0] < least:
            return []
        score, seen = np.zeros(len(self.ids)), np.zeros(len(self.ids), bool)
        near = None
        for (_, w, places, parts), left in zip(lists, rest, strict=False):
            if near is None and left < least:
                near = np.flatnonzero(seen)
            if near is None:
                score[places] += w * parts
                seen[places] = True
            else:
                near = near[score[near] + left >= least]
                at = np.minimum(np.searchsorted(places, near), len(places) - 1)
                score[near] += w * parts[at] * (places[at] == near)
        near = np.flatnonzero(seen) if near is None else near
        value = np.round(score[near], 6)
        if len(near) > k + 1:
            keep = value >= np.partition(value, -k - 1)[-k - 1]
            near, value = near[keep], value[keep]
        order = np.argsort(-value, kind="stable")[: k + 1]
        found = [(float(value[i]), self.ids[near[i]]) for i in order]
        return [x for x in found if own is None or x[1] != own][:k]


def few(table: DataFrame) -> DataFrame:
    """The table in a bounded number of partitions: rows kept by a task for each question don't grow with the questions and the table alike."""
    return table.coalesce(max(TASKS, 2 * table.sparkSession.sparkContext.defaultParallelism))


def bm25_search(index: Bm25Index, questions: DataFrame, k: int, backfill: bool = False, exclude_self: bool = False) -> DataFrame:
    """(qid, chunk_id, score, rank): the k best chunks of each (qid, question); a term counts as often as the question has it.

    Questions are answered in batches of about MOST_ASKED terms, which are broadcast.
    A task scores its blocks one after the other, keeps the k best a question and
    skips what its bounds prove to stay below them, so what is shuffled is at most k
    rows for each question and task, whose number few() bounds.

    backfill: a question with terms but fewer than k matches is filled up with the
    smallest other ids at score 0, as a scan over every chunk would give.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    spark = questions.sparkSession
    terms = questions.select("qid", F.explode(T.tokens(T.nfkc(F.col("question")))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
    counted = stored(terms, "counted")
    known = index.terms.select("term", "idf").join(counted.select("term"), "term", "left_semi")  # where few are asked, no other term of the index is moved
    asked = stored(counted.join(known, "term", "left"), "asked")
    avgdl = index.corpus.first()["avgdl"]
    first = index.chunks.orderBy("chunk_id").limit(2 * k)  # a question with fewer than k matches needs no more
    wanted = [r["chunk_id"] for r in first.collect()] if backfill else []
    batches = max(1, -(-asked.where("idf is not null").count() // MOST_ASKED))
    parts = []
    for b in range(batches):
        some = asked.where(F.col("idf").isNotNull() & (F.pmod(F.xxhash64("qid"), F.lit(batches)) == b)).collect()  # about MOST_ASKED rows
        words: dict = {}
        for r in some:
            words.setdefault(r["qid"], []).append((r["term"], r["qtf"] * r["idf"]))
        parts.append(_scored(index, words, k, avgdl, wanted, exclude_self, questions.schema["qid"].dataType.simpleString()))
    scored = reduce(DataFrame.unionByName, parts)
    if not backfill:
        return ranked(scored, k)
    scored = stored(scored.dropDuplicates(["qid", "chunk_id"]), "scored")
    zeros = asked.select("qid").distinct().crossJoin(first).join(scored, ["qid", "chunk_id"], "left_anti").withColumn("score", F.lit(0.0))
    return ranked(scored.unionByName(zeros), k)


def _scored(index: Bm25Index, words: dict, k: int, avgdl: float, wanted: list, exclude_self: bool, kind: str) -> DataFrame:
    """(qid, chunk_id, score): each task's k best chunks of every question, and those of `wanted` that match it."""
    asked = sorted({t for some in words.values() for t, _ in some})
    shared = index.blocks.sparkSession.sparkContext.broadcast((words, asked, set(wanted)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, asked, wanted = shared.value
        best: dict = {}
        also: list[tuple] = []
        for batch in batches:
            ids_type = batch.column(0).type.value_type
            for i in range(len(batch)):
                held = Postings({n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}, avgdl, asked)
                mine = [(p, x) for p, x in enumerate(held.ids) if x in wanted]
                for qid, some in words.items():
                    have = best.get(qid, [])
                    least = have[-1][0] - 1e-6 if len(have) == k else -np.inf  # scores are compared by six digits
                    own = qid if exclude_self else None
                    if found := held.best(some, k, least, own):
                        best[qid] = sorted(have + found, key=lambda x: (-x[0], x[1]))[:k]
                    for p, x in mine:
                        lists = [(w, *held.terms[t][:2]) for t, w in some if t in held.terms]
                        hits = [w * parts[a] for w, places, parts in lists if (a := np.searchsorted(places, p)) < len(places) and places[a] == p]
                        if hits and x != own:
                            also.append((qid, x, round(float(sum(hits)), 6)))
        rows = [(q, x, s) for q, some in best.items() for s, x in some] + also
        if rows:
            qids, ids, scores = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(qids, qid_type), pa.array(ids, ids_type), pa.array(scores, pa.float64())], ["qid", "chunk_id", "score"])

    qid_type = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()
    ids = index.blocks.schema["ids"].dataType.elementType.simpleString()
    return few(index.blocks).mapInArrow(run, f"qid {kind}, chunk_id {ids}, score double")


def blocks(table: DataFrame, id_col: str, rows: int, by: str | None = None) -> DataFrame:
    """(ids, vectors binary) of a table (id_col, vector): up to `rows` rows of a partition side by side, as doubles; null vectors go.

    With `by`, a column of whole numbers, a block holds rows that follow each other
    with one value of it, which is a third column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, at = [], [], None

        def packed() -> pa.RecordBatch:
            cols = [pa.array([ids], pa.list_(kind)), pa.array([np.array(vectors, np.float64).tobytes()], pa.binary()), pa.array([at], pa.int64())]
            return pa.RecordBatch.from_arrays(cols if by else cols[:2], ["ids", "vectors", "by"][: 3 if by else 2])

        for batch in batches:
            kind = batch.column(0).type
            for i, v, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (len(ids) == rows or b != at):
                    yield packed()
                    ids, vectors = [], []
                at = b
                ids.append(i)
                vectors.append(v)
        if ids:
            yield packed()

    kind = table.schema[id_col].dataType.simpleString()
    group = F.col(by).cast("long") if by else F.lit(None).cast("long")
    out = table.where("vector is not null").select(id_col, "vector", group).mapInArrow(run, f"ids array<{kind}>, vectors binary" + ", by long" * bool(by))
    return out.withColumnRenamed("by", by) if by else out


def dense_search(chunks: DataFrame, queries: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """(qid, chunk_id, score, rank) by cosine of unit vectors: a stated batch of queries against every chunk, in blocks.

    Chunks are packed into blocks where they lie and queries into groups; a pair of
    them is one matrix product, of which the k best a query leave the task, of few()
    tasks.  Spark broadcasts the groups' table if it is small, and pairs partitions
    beyond that.
    """
    left = blocks(few(chunks), "chunk_id", CHUNKS).toDF("ids", "vectors")
    right = stored(blocks(queries, "qid", ASKED), "asked").toDF("qids", "asked")
    return best_of_blocks(left.crossJoin(right), k, exclude_self)


def best_of_blocks(pairs: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """(qid, chunk_id, score, rank) of pairs of blocks (ids, vectors, qids, asked): a matrix product for each pair, of which the k best a query leave the task."""
    if k <= 0:
        raise ValueError("k must be positive")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, vectors, qids, asked in zip(*(batch.column(c) for c in ("ids", "vectors", "qids", "asked")), strict=True):
                chunk_ids, query_ids = np.array(ids.as_py()), np.array(qids.as_py())
                c, q = (np.frombuffer(v.as_py()).reshape(len(n), -1) for v, n in ((vectors, chunk_ids), (asked, query_ids)))
                if c.shape[1] != q.shape[1]:
                    raise ValueError(f"vectors of {c.shape[1]} and of {q.shape[1]} numbers")
                order = np.argsort(chunk_ids, kind="stable")  # so that ties go to smaller ids
                chunk_ids, scores = chunk_ids[order], np.round(q @ c[order].T, 6)
                if exclude_self:
                    scores[query_ids[:, None] == chunk_ids] = -np.inf
                least = -np.partition(-scores, k - 1, axis=1)[:, k - 1] if k < len(chunk_ids) else np.full(len(scores), -np.inf)
                rows = []
                for row, low in zip(scores, least, strict=True):
                    near = np.flatnonzero((row >= low) & (row > -np.inf))
                    rows.append(near[np.argsort(-row[near], kind="stable")[:k]])
                lengths, at = [len(r) for r in rows], np.concatenate(rows)
                found = (np.repeat(query_ids, lengths), chunk_ids[at], scores[np.repeat(np.arange(len(rows)), lengths), at])
                kinds = (batch.schema.field("qids").type.value_type, batch.schema.field("ids").type.value_type, pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), t) for x, t in zip(found, kinds, strict=True)], ["qid", "chunk_id", "score"])

    kinds = [pairs.schema[c].dataType.elementType.simpleString() for c in ("qids", "ids")]
    return ranked(pairs.select("ids", "vectors", "qids", "asked").mapInArrow(best, f"qid {kinds[0]}, chunk_id {kinds[1]}, score double"), k)


def containing(chunks: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, chunk_id) of the chunks (chunk_id, text) that hold a passage (qid, question) word for word.

    Up to PATTERNS passages of LETTERS letters in all are sought by an automaton,
    which is broadcast and reads every text once where it lies; no text is shuffled.
    Of more passages, those of SHARED + 2 words or more have that many whole words
    inside, which stand in a row in every text that holds them: hashes of such runs
    meet by a join, and what meets is verified.  The shorter ones are sought by as
    many automata as they need.  An empty passage is in no text.
    """
    words = lambda c: F.filter(F.split(c, "\\s+"), lambda w: w != "")
    asked = passages.select("qid", "question", words(F.col("question")).alias("w")).where(F.length("question") > 0)
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("question")).alias("letters")).first()
    kind = asked.schema["qid"].dataType.simpleString()
    if size["n"] <= PATTERNS and (size["letters"] or 0) <= LETTERS:
        return _sought(chunks, asked.select("qid", "question").collect(), kind)
    run = lambda w, i: F.xxhash64(*[F.get(w, i + k) for k in range(SHARED)])
    keyed = asked.where(F.size("w") >= SHARED + 2).select("qid", "question", run(F.col("w"), F.lit(1)).alias("key"))
    held = chunks.select("chunk_id", "text", words(F.col("text")).alias("w")).where(F.size("w") >= SHARED)
    held = held.select("chunk_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - SHARED), lambda i: run(F.col("w"), i)))).alias("key"))
    met = held.join(keyed.select("qid", "key"), "key").select("qid", "chunk_id").distinct()
    near = met.join(passages, "qid").join(chunks.select("chunk_id", "text"), "chunk_id")
    long = near.where(F.expr("contains(text, question)")).select("qid", "chunk_id")
    short = stored(asked.where(F.size("w") < SHARED + 2).select("qid", "question"), "short")
    batches = -(-short.count() // PATTERNS)
    parts = [_sought(chunks, short.where(F.pmod(F.xxhash64("qid"), F.lit(batches)) == b).collect(), kind) for b in range(batches)]
    return reduce(DataFrame.unionByName, parts, long)


def _sought(chunks: DataFrame, patterns: list, kind: str) -> DataFrame:
    """(qid, chunk_id) of the chunks that hold one of the patterns (qid, question), by one automaton over their first HEAD letters; what follows is compared in place."""
    shared = chunks.sparkSession.sparkContext.broadcast([(r["qid"], r["question"]) for r in patterns])

    @F.pandas_udf(f"array<{kind}>")
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        owners: dict[str, dict[str, list]] = {}
        for qid, text in shared.value:
            owners.setdefault(text[:HEAD], {}).setdefault(text, []).append(qid)
        automaton = ahocorasick.Automaton()
        for head in owners:
            automaton.add_word(head, head)
        if owners:
            automaton.make_automaton()

        def within(t: str) -> list:
            found: set[str] = set()
            for end, head in automaton.iter(t):
                found.update(x for x in owners[head] if x not in found and t.startswith(x, end + 1 - len(head)))
            return sorted({q for x in found for q in owners[x[:HEAD]][x]})

        for texts in batches:
            yield pd.Series([within(t) if t and owners else [] for t in texts])

    return chunks.select("chunk_id", F.explode(held("text")).alias("qid")).select("qid", "chunk_id")


def rrf(arms: DataFrame, k: int = 60, depth: int | None = None) -> DataFrame:
    """(qid, chunk_id, score, rank) of (list_id, qid, chunk_id, rank): the sum of 1 / (k + rank); an id pays once a list, by its best rank."""
    if k <= 0:
        raise ValueError("k must be positive")
    cut = arms if depth is None else arms.where(F.col("rank") <= depth)
    once = cut.groupBy("qid", "list_id", "chunk_id").agg(F.min("rank").alias("rank"))
    fused = once.groupBy("qid", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order)).withColumn("score", F.round("score", 9))


def lexical_score(question: str, passage: str):
    """A deterministic pair score: the share of the question's different words that the passage has."""
    q = F.array_distinct(T.tokens(F.col(question)))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, T.tokens(F.col(passage)))) / F.size(q)).otherwise(F.lit(0.0))


def truncated(text: Column, words: int) -> Column:
    """The first so many words of a text, as they stand in it."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit("(\\s*\\S+)"), 1), 1, words), "")


def pair_model(make: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], words: int = MODEL_WORDS) -> Callable:
    """A scorer for rerank() from make(), which a task calls once for the model: a function from (question, text) pairs to scores, in batches; texts are cut to so many words."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for questions, texts in batches:
            pairs = list(zip(questions.fillna(""), texts.fillna(""), strict=True))
            yield pd.Series(model(pairs) if pairs else [], dtype="float64")

    return lambda question, passage: run(F.col(question), truncated(F.col(passage), words))


def weighted_score(question: str, passage: str, long: int = 6):
    """lexical_score in which words of at least `long` letters count twice: the stand-in for a second, tuned checkpoint."""
    q, p = F.array_distinct(T.tokens(F.col(question))), T.tokens(F.col(passage))
    count = lambda w: F.size(w) + F.size(F.filter(w, lambda x: F.length(x) >= long))
    return F.when(F.size(q) > 0, count(F.array_intersect(q, p)) / count(q)).otherwise(F.lit(0.0))


def rerank(found: DataFrame, questions: DataFrame, texts: DataFrame, depth: int, k: int, scorer: Callable = lexical_score) -> DataFrame:
    """The first `depth` of each list, scored anew as (question, text) pairs, cut to k; a missing text counts as empty.

    Only the texts of what was found meet the pairs: lists that are stored and small are broadcast, and no other text is moved.
    """
    cut = found.where(F.col("rank") <= depth).select("qid", "chunk_id")
    held = texts.select("chunk_id", "text").join(cut.select("chunk_id"), "chunk_id", "left_semi")
    pairs = cut.join(questions.select("qid", "question"), "qid").join(held, "chunk_id", "left")
    pairs = pairs.withColumn("text", F.coalesce("text", F.lit("")))
    return ranked(pairs.select("qid", "chunk_id", scorer("question", "text").alias("score")), k)
