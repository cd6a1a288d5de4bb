"""Exact top-k inner products by an impact-ordered, score-at-a-time index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from goldseam.llm.common import load, prepare, stored, temporary

#: Vectors of a block of the index.
BLOCK = 16_384
#: Components are quantised to multiples of this for the order of postings.
STEP = 8
#: Shares of the largest impact down to which each round reads postings.
ROUNDS = (0.5, 0.25, 0.1, 0.0, -float("inf"))
#: Postings that are read in the time in which a vector is rescored.
PER = 4


class Index:
    """Postings of a block: for each component the vectors in the order of its quantised value."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        self.rows, self.ids, self.vectors = rows, ids, vectors
        level = vectors // STEP  # rounds down: a component lies in [STEP * level, STEP * level + STEP - 1]
        self.order = np.argsort(level, axis=0, kind="stable").T.copy()
        self.levels = np.take_along_axis(level.T, self.order, axis=1)

    def search(self, q: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best vectors but that of row `own`, ties to smaller ids: exact.

        Segments of postings are read by descending impact (query component times
        quantised value), in rounds; accumulators hold what was read.  After each
        round a vector's score is at most its accumulator, and the round's limit for
        each component that hasn't been read, and the quantisation error.  The k
        best accumulators, rescored, give a score that k vectors reach; the bound
        proves which vectors stay below it.  Reading stops when the others are
        rescored from their components sooner than the postings left are read.
        """
        n, dims = self.vectors.shape
        acc, seen = np.zeros(n, np.int64), np.zeros(n, np.int32)
        error = int(np.maximum(q * (STEP - 1), 0).sum())
        lo, hi = np.zeros(dims, np.int64), np.full(dims, n)
        top = np.maximum(q * STEP * self.levels[:, 0], q * STEP * self.levels[:, -1]).max() if n else 0
        possible = np.arange(n)
        for share in ROUNDS:
            limit = share * top if np.isfinite(share) else None
            for d in np.flatnonzero(q):
                if lo[d] >= hi[d]:
                    continue
                row = self.levels[d]
                if q[d] > 0:  # high values have the highest impact: read from the end
                    cut = 0 if limit is None else int(np.searchsorted(row, limit / (q[d] * STEP)))
                    part, hi[d] = slice(max(cut, lo[d]), hi[d]), max(min(cut, hi[d]), lo[d])
                else:
                    cut = n if limit is None else int(np.searchsorted(row, limit / (q[d] * STEP), side="right"))
                    part, lo[d] = slice(lo[d], min(cut, hi[d])), min(max(cut, lo[d]), hi[d])
                at = self.order[d, part]
                acc[at] += q[d] * STEP * row[part]
                seen[at] += 1
            unread = np.count_nonzero(q) - seen
            upper = acc + error + (0 if limit is None else unread * max(limit, 0) if limit >= 0 else 0)
            if n > 4 * k:
                best = np.argpartition(-acc, k)[: k + 1]
                exact = self.vectors[best] @ q
                exact = np.sort(exact[self.rows[best] != own])[::-1]
                if len(exact) >= k:
                    possible = np.flatnonzero(upper >= exact[k - 1])
                    if PER * len(possible) <= max(int((hi - lo)[q != 0].sum()), 4 * k * PER):
                        break
        possible = possible[self.rows[possible] != own]
        scores = self.vectors[possible] @ q if 2 * len(possible) < n else (self.vectors @ q)[possible]
        order = np.lexsort((self.ids[possible], -scores))[:k]
        return self.ids[possible][order], scores[order]


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id_col, score): for every vector whose id is divisible by `every`, the k others of largest inner product.

    Components become floor(scale * x), x as double.  Vectors that are null or hold
    a null or a component that isn't finite take no part, nor do rows without an id;
    an empty vector has the score 0 with all; of vectors of different lengths, the
    shorter counts as padded with zeros.  Ties go to smaller ids; a query's own row
    is no candidate; rows that repeat an id are candidates, and queries, each by itself.
    Fewer candidates than k give fewer rows, an empty table gives none.  Extra
    columns are ignored.

    Vectors are dealt to blocks by hash, and every query to each block (the stated
    query set against all rows, in blocks).  A task gets a block's vectors before the
    queries: it indexes them once and answers a batch of queries at a time, so
    vectors are shuffled once, whatever the number of queries.  What leaves it is at
    most k rows a query and block, cut again by rank before they meet.
    """
    spark = vectors.sparkSession
    prepare(spark)
    v = F.col(vector_col)
    whole = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    table = whole.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"), F.monotonically_increasing_id().alias("row"))
    with temporary(spark) as result:
        return result(_ranked(stored(table, "vectors"), every, k).withColumnRenamed("vec_id", id_col), "top-k")


def _ranked(table: DataFrame, every: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of a table (id, v, row) of whole numbers."""
    size = table.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    dims, blocks = size[1] or 0, max(1, -(-size[0] // BLOCK))
    own = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int")
    rows = table.select(own.alias("block"), F.lit(False).alias("query"), "row", "id", "v")
    asked = table.where(F.col("id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("query"), "row", "id", "v")
    dealt = rows.unionByName(asked).repartitionById(blocks, "block").sortWithinPartitions("block", "query")  # a task for each block

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index = None, None
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of the block's vectors, until its index is made

        def matrix(vectors: pa.ListArray) -> np.ndarray:
            m = np.zeros((len(vectors), dims), np.int64)
            lengths = vectors.value_lengths().to_numpy()
            m[np.arange(dims) < lengths[:, None]] = vectors.flatten().to_numpy()
            return m

        def answers(rows: np.ndarray, ids: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            found = [index.search(q, k, row) for row, q in zip(rows.tolist(), m, strict=True)]
            lengths = [len(x[1]) for x in found]
            cols = (np.repeat(rows, lengths), np.repeat(ids, lengths), *(np.concatenate([x[c] for x in found]) for c in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["row", "query_id", "vec_id", "score"])

        for batch in batches:
            block, query = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            own, ids, m = batch.column(2).to_numpy(), batch.column(3).to_numpy(), matrix(batch.column(4))
            # a batch may hold the end of one block and the start of the next
            cuts = np.flatnonzero(np.diff(block * 2 + query)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                if lo == hi:
                    continue
                if block[lo] != at:
                    at, index, held = block[lo], None, []
                if not query[lo]:
                    held.append((own[lo:hi], ids[lo:hi], m[lo:hi]))
                    continue
                if index is None:
                    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, dims), np.int64))
                    index, held = Index(*(np.concatenate(x) for x in zip(none, *held, strict=True))), []
                yield answers(own[lo:hi], ids[lo:hi], m[lo:hi])

    pairs = dealt.mapInArrow(search, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    best = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def op4_topk(spark, sf_dir: str) -> DataFrame:
    """The five best partners of every fiftieth vector."""
    return top_k(load(spark, sf_dir, "embeddings"))


QUERIES = {"op4_topk": op4_topk}

ORACLE_SQL = {
    "op4_topk": """
with v as (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.row, q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.row <> c.row
), r as (
  select *, row_number() over (partition by row order by score desc, vec_id)::int as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""
}
