"""Metrics of ranked lists, and the statistics that compare them."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldseam.config import EngineError
from goldseam.operators.ranks import numbered
from goldseam.store import stored

#: Fixed value: recall at 10 above this is audited for leaks before it is reported.
TRIPWIRE = 0.95
#: Values that a task of the bootstrap holds.
VALUES = 1_000_000


def outcomes(questions: DataFrame, found: DataFrame, gold: DataFrame, k: int, lanes: DataFrame | None = None) -> DataFrame:
    """(lane_id, qid, hit, rr) for every lane and question: a question without results is a miss, never absent."""
    lanes = lanes if lanes is not None else found.select("lane_id").distinct()
    first = found.where(F.col("rank") <= k).join(gold, ["qid", "chunk_id"], "left_semi").groupBy("lane_id", "qid").agg(F.min("rank").alias("first"))
    every = questions.select("qid").distinct().crossJoin(F.broadcast(lanes))  # a row for each lane
    joined = every.join(first, ["lane_id", "qid"], "left")
    return joined.select("lane_id", "qid", F.col("first").isNotNull().alias("hit"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, agreement and Cohen's kappa of two boolean raters; 0 where chance alone explains all, or without rows."""
    s = pairs.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("po"), F.avg(F.col(a).cast("double")).alias("pa"), F.avg(F.col(b).cast("double")).alias("pb"))
    s = s.withColumn("pc", F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb")))
    k = F.when(F.coalesce(F.col("pc"), F.lit(1.0)) >= 1, 0.0).otherwise((F.col("po") - F.col("pc")) / (1 - F.col("pc")))
    return s.select("n", F.coalesce("po", F.lit(0.0)).alias("agreement"), k.alias("kappa"))


def paired(out: DataFrame, a: str, b: str) -> DataFrame:
    """(qid, hit_a, hit_b, rr_a, rr_b); questions that only one lane answers raise EngineError."""
    left = out.where(F.col("lane_id") == a).select("qid", F.col("hit").alias("hit_a"), F.col("rr").alias("rr_a"))
    right = out.where(F.col("lane_id") == b).select("qid", F.col("hit").alias("hit_b"), F.col("rr").alias("rr_b"))
    both = left.join(right, "qid", "full")
    if both.where("hit_a is null or hit_b is null").limit(1).count():
        raise EngineError("the lanes answer different questions")
    return both


def binomial_tail(n, at_least):
    """The sum of C(n, i) / 2^n for i >= at_least, by a running sum of logarithms: no factorials, and no underflow of 1 / 2^n."""

    def step(acc, i):
        c = acc["c"] + F.log((n - i + 1) / i)
        return F.struct(c.alias("c"), (acc["t"] + F.when(i >= at_least, F.exp(c)).otherwise(0.0)).alias("t"))

    none = n * F.log(F.lit(0.5))
    start = F.struct(none.alias("c"), F.when(at_least <= 0, F.exp(none)).otherwise(F.lit(0.0)).alias("t"))
    return F.aggregate(F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>")), start, step)["t"]


def mcnemar(pairs: DataFrame) -> DataFrame:
    """One row: wins of either side and the exact two-sided p value."""
    d = pairs.agg(F.count_if(F.col("hit_a") & ~F.col("hit_b")).cast("int").alias("a_only"), F.count_if(~F.col("hit_a") & F.col("hit_b")).cast("int").alias("b_only"))
    n = F.col("a_only") + F.col("b_only")
    tail = binomial_tail(n, F.greatest("a_only", "b_only"))
    return d.select("a_only", "b_only", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)).alias("p_value"))


def bootstrap(pairs: DataFrame, value: str, resamples: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """One row: mean difference and the percentile interval of `resamples` means of questions drawn with replacement.

    Draw i of resample b takes the question whose place is the MD5 of (seed, b, i)
    modulo n, so the draws are the same on every engine and in any order.

    Values lie in blocks of at most VALUES, in the order of their questions; a task
    holds a block, draws for its group of resamples and adds up what falls into the block.
    So a row for each resample and block is all that is made, however many
    questions there are.
    """
    placed = stored(numbered(pairs.select("qid", F.col(value).alias("v")), "qid"), "values")
    n = placed.count()
    if not n:
        raise EngineError("no pairs to resample")
    spark = pairs.sparkSession
    block = placed.groupBy(F.floor(F.col("place") / VALUES).alias("block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "v"))), lambda x: x["v"]).alias("v"))
    tasks = spark.sparkContext.defaultParallelism * 2
    groups = min(resamples, 8 * tasks)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, at, v in zip(*batch.columns, strict=True):
                values, first = v.values.fill_null(0).to_numpy(), at.as_py() * VALUES
                own = np.arange(group.as_py(), resamples, groups)
                sums = np.zeros(len(own))
                for lo in range(0, n, VALUES):
                    draws = [b"%d" % i for i in range(lo, min(n, lo + VALUES))]
                    for k, b in enumerate(own.tolist()):
                        head = f"{seed}:{b}:".encode()
                        places = np.frombuffer(b"".join([md5(head + i).digest()[:4] for i in draws]), ">u4").astype(np.int64) % n - first
                        sums[k] += values[places[(places >= 0) & (places < len(values))]].sum()
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(sums)], ["b", "s"])

    pairs_of = spark.range(0, groups, 1, tasks).withColumnRenamed("id", "group").crossJoin(stored(block, "blocks")).repartition(tasks, "group")
    sums = pairs_of.mapInArrow(drawn, "b long, s double")
    means = sums.groupBy("b").agg((F.sum("s") / n).alias("m"))
    ci = means.agg(F.expr(f"percentile(m, {alpha / 2})").alias("low"), F.expr(f"percentile(m, {1 - alpha / 2})").alias("high"))
    return placed.agg(F.avg("v").alias("mean")).crossJoin(ci)


def decide(interval: DataFrame, fired: DataFrame) -> DataFrame:
    """One row (verdict, mean, low, high) of a bootstrap() row and tripwire() rows: the interval decides alone, and nothing is said while a tripwire has fired."""
    leak = fired.agg(F.coalesce(F.bool_or("fired"), F.lit(False)).alias("leak"))
    said = F.when(F.col("leak"), "withheld").when(F.col("low") > 0, "improvement").when(F.col("high") < 0, "regression").otherwise("no detectable difference")
    return interval.crossJoin(leak).select(said.alias("verdict"), "mean", "low", "high")


def detectable_wins(out: DataFrame) -> DataFrame:
    """(lane_id, wins): the questions that each lane misses, the most that a challenger can win against it."""
    return out.groupBy("lane_id").agg(F.count_if(~F.col("hit")).alias("wins"))


def changed(pairs: DataFrame) -> DataFrame:
    """(qid, change): the questions that only the second lane of paired() answers are won, those that only the first does are lost."""
    return pairs.where("hit_a <> hit_b").select("qid", F.when(F.col("hit_b"), "won").otherwise("lost").alias("change"))


def tripwire(out: DataFrame, threshold: float = TRIPWIRE) -> DataFrame:
    """(lane_id, threshold, observed, fired): recall above the threshold asks for an audit before it is reported."""
    return out.groupBy("lane_id").agg(F.avg(F.col("hit").cast("int")).alias("r")).select("lane_id", F.lit(threshold).alias("threshold"), F.round("r", 4).alias("observed"), (F.col("r") > threshold).alias("fired"))
