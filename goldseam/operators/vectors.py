"""An inverted-file index of vectors: lists around centers, of which a query probes the nearest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldseam.operators import retrieval as R
from goldseam.operators.ingest import index_lists
from goldseam.store import stored

#: Vectors that the centers are fitted on, about, and lists at most: both bound what is broadcast and how long fitting takes, not what is indexed.
SAMPLE, MOST_LISTS = 65_536, 16_384
#: Vectors of a file: a list with more has several, so no task gathers a whole one.
FILE_ROWS = 262_144
#: Rounds of fitting.
ROUNDS = 10
#: Lists up to which MLlib seeds the centers: it compares all candidates, twice as many as lists, on the driver, which grows with their square.
SEEDED = 128


@dataclass(frozen=True)
class VectorIndex:
    """vectors(chunk_id, vector, ..., list), in a folder for each list, and the centers, a row of unit length for each list."""

    vectors: DataFrame
    centers: np.ndarray

    @property
    def lists(self) -> int:
        return len(self.centers)


def fitted(vectors: DataFrame, lists: int, sample: int = SAMPLE, seed: int = 42) -> np.ndarray:
    """Centers of at most `lists` clusters by cosine, fitted on about `sample` of the vectors (chunk_id, vector), those of least hash.

    Fewer different vectors than lists give fewer centers; none but zeros, or one
    list, give a single center.  Up to SEEDED lists are seeded by k-means||, more by
    vectors of the sample.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    long = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x) > 0
    shape = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dims")).first()
    if lists == 1 or not shape["n"]:
        return np.zeros((1, shape["dims"] or 0))
    share = 1 << 30
    least = min(share, -(-share * sample // shape["n"]))
    some = stored(vectors.where(long & (F.pmod(F.xxhash64("chunk_id", F.lit(seed)), F.lit(share)) < least)).select("chunk_id", "vector"), "sample")
    if some.isEmpty():
        return np.zeros((1, shape["dims"]))
    if lists > SEEDED:
        return _rounds(some, lists, seed)
    model = KMeans(k=lists, seed=seed, maxIter=ROUNDS, distanceMeasure="cosine", featuresCol="at").fit(some.select(array_to_vector("vector").alias("at")))
    centers = np.array(model.clusterCenters())
    return centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-300)


def _rounds(some: DataFrame, lists: int, seed: int) -> np.ndarray:
    """Centers by Lloyd's rounds from `lists` different vectors of the sample (chunk_id, vector), those of least hash.

    Tasks sum up the unit vectors next to each center as matrix products; the driver
    gets a row for each list that a task has met, fewer than the sample has.
    """
    first = some.groupBy("vector").agg(F.min(F.xxhash64("chunk_id", F.lit(seed + 1))).alias("at")).orderBy("at", "vector").limit(lists)
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    centers = unit(np.array([r["vector"] for r in first.collect()], np.float64))
    dealt = stored(some.repartition(some.sparkSession.sparkContext.defaultParallelism), "dealt")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sums, met = shared.value, None, set()
        for batch in batches:
            if not len(batch):
                continue
            v = unit(_matrix(batch.column(0)))
            sums = np.zeros(c.shape) if sums is None else sums
            lists = (v @ c.T).argmax(axis=1)
            np.add.at(sums, lists, v)
            met.update(lists.tolist())
        at = sorted(met)
        for lo in range(0, len(at), 1024):
            yield pa.RecordBatch.from_arrays([pa.array(at[lo : lo + 1024], pa.int64()), pa.array([sums[i].tobytes() for i in at[lo : lo + 1024]], pa.binary())], ["list", "sum"])

    for _ in range(ROUNDS):
        shared = some.sparkSession.sparkContext.broadcast(centers)
        sums = np.zeros(centers.shape)
        for r in sorted(dealt.select("vector").mapInArrow(summed, "list long, sum binary").collect(), key=lambda r: (r["list"], r["sum"])):
            sums[r["list"]] += np.frombuffer(r["sum"])
        moved = np.linalg.norm(sums, axis=1, keepdims=True) > 0  # a center without vectors stays
        centers = np.where(moved, unit(sums), centers)
        shared.unpersist()
    return centers


def _matrix(lists: pa.Array) -> np.ndarray:
    """The vectors of a column, a row each; of different lengths, ValueError."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of different lengths")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), -1 if len(sizes) and sizes[0] else 0)


def nearest(table: DataFrame, id_col: str, centers: np.ndarray, probes: int) -> DataFrame:
    """The table with a row for each of the `probes` lists whose centers have the largest inner product with its vector; null vectors go."""
    shared = table.sparkSession.sparkContext.broadcast(centers)  # MOST_LISTS rows at most
    names = table.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            if not len(batch):
                continue
            v = _matrix(batch.column(names.index("vector")))
            if c.shape[1] and v.shape[1] != c.shape[1]:
                raise ValueError(f"vectors of {v.shape[1]} numbers for an index of {c.shape[1]}")
            v = v if c.shape[1] else v[:, :0]  # the index of an empty table
            near = v @ c.T
            lists = near.argmax(axis=1)[:, None] if probes == 1 else np.argsort(-near, axis=1, kind="stable")[:, :probes]
            rows = batch.take(pa.array(np.repeat(np.arange(len(batch)), lists.shape[1])))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(lists.ravel().astype(np.int64))], [*names, "list"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    return table.where("vector is not null").mapInArrow(run, f"{fields}, list long")


def build(chunks: DataFrame, lists: int | None = None, sample: int = SAMPLE, seed: int = 42, path: str | None = None) -> VectorIndex:
    """Index every vector of (chunk_id, vector, ...): each lies in the list of its nearest center.

    Without a number of lists there is one for every thousand vectors, MOST_LISTS at
    most.  The centers come from what is there, so build the index after loading.
    With a path it is written there for load(), else to the shared folder.
    """
    if lists is not None and (isinstance(lists, bool) or not isinstance(lists, int) or lists <= 0):
        raise ValueError("lists must be a positive whole number")
    held = chunks.where("vector is not null")
    centers = fitted(held, lists or min(MOST_LISTS, index_lists(held.count())), sample, seed)
    placed = stored(nearest(held, "chunk_id", centers, 1), "placed")
    files = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).alias("files"))
    dealt = placed.join(F.broadcast(files), "list").withColumn("file", F.pmod(F.xxhash64("chunk_id"), "files"))  # a row for each list
    out = dealt.repartition("list", "file").select(*placed.columns)
    if path is None:
        return VectorIndex(stored(out, "lists", ("list",)), centers)
    spark = chunks.sparkSession
    out.write.option("compression", "zstd").partitionBy("list").parquet(f"{path}/vectors")
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centers)]
    spark.createDataFrame(rows, "list int, center array<double>").coalesce(1).write.parquet(f"{path}/centers")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields]
    spark.createDataFrame([(", ".join(fields),)], "schema string").coalesce(1).write.json(f"{path}/schema")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> VectorIndex:
    """The index that build() wrote to a path."""
    schema = spark.read.json(f"{path}/schema").first()["schema"]
    centers = [r["center"] for r in spark.read.parquet(f"{path}/centers").orderBy("list").collect()]  # MOST_LISTS at most
    return VectorIndex(spark.read.schema(schema).parquet(f"{path}/vectors"), np.array(centers, np.float64).reshape(len(centers), -1))


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int = 1, corpus: str | None = None, exclude_self: bool = False) -> DataFrame:
    """(qid, chunk_id, score, rank): the k best of the lists that each (qid, vector) probes, scored exactly.

    Only the folders of probed lists are read.  Blocks of a list's vectors meet
    blocks of its queries by a join on the list, and a task sends on the k best a
    query.  As many probes as lists compare every vector.  `corpus` keeps to the
    chunks of one corpus_id.
    """
    if isinstance(probes, bool) or not isinstance(probes, int) or probes <= 0:
        raise ValueError("probes must be a positive whole number")
    asked = stored(nearest(queries.select("qid", "vector"), "qid", index.centers, probes), "probed")
    wanted = [r["list"] for r in asked.select("list").distinct().collect()]  # MOST_LISTS at most
    held = index.vectors.where(F.col("list").isin(wanted))
    if corpus is not None:
        held = held.where(F.col("corpus_id") == corpus)
    left = R.blocks(held, "chunk_id", R.CHUNKS, "list").toDF("ids", "vectors", "list")
    right = R.blocks(asked.repartition("list").sortWithinPartitions("list"), "qid", R.ASKED, "list").toDF("qids", "asked", "list")
    # many probes write the same vectors again and again, so that files look small enough to be sent through the driver
    return R.best_of_blocks(left.join(right.hint("merge"), "list"), k, exclude_self)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of the exact (qid, chunk_id) pairs that were found; 1 where there are none."""
    hit = exact.join(found.select("qid", "chunk_id", F.lit(1).alias("hit")), ["qid", "chunk_id"], "left")
    return hit.agg(F.coalesce(F.count("hit") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(1.0)).alias("recall"))
