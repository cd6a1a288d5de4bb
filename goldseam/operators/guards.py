"""Guards against leaks from the test split into training data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldseam.config import LeakageError
from goldseam.functions import text as T


def _told(questions: DataFrame, name: str) -> DataFrame:
    return questions.select(T.normalised_question(F.col("question")).alias("text")).distinct().withColumn(name, F.lit(True))


def classified(asked: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """asked with `kind`: a question of the test split is forbidden (even if it is in both), one of neither unknown, others allowed.

    Questions are the same if they differ in case and white space only.
    """
    named = asked.withColumn("text", T.normalised_question(F.col("question")))
    joined = named.join(_told(test, "in_test"), "text", "left").join(_told(train, "in_train"), "text", "left")
    kind = F.when(F.col("in_test"), "forbidden").when(F.col("in_train"), "allowed").otherwise("unknown")
    return joined.select(*asked.columns, kind.alias("kind"))


def train_only(asked: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """The questions (qid, question), unless one of them is of the test split or of none: then LeakageError before anything is retrieved."""
    bad = classified(asked, train, test).where("kind <> 'allowed'").select("qid", "kind").limit(5).collect()
    if bad:
        raise LeakageError("questions that mining must not see: " + ", ".join(f"{r['qid']} ({r['kind']})" for r in bad))
    return asked


def check_all_asked(asked: DataFrame, train: DataFrame) -> None:
    """LeakageError if a train question was never retrieved for: a miner that skips rows makes a weaker set silently."""
    missing = _told(train, "t").join(_told(asked, "a"), "text", "left_anti")
    if missing.limit(1).count():
        raise LeakageError("train questions were left out")


def leaks(rows: DataFrame) -> DataFrame:
    """One row for (qid, question, chunk_id, split): qids, questions and gold chunks that both splits hold, and qids that a split repeats.

    A row is a gold chunk of a question; a qid is repeated if it has two questions.
    """
    sides = lambda c, n: rows.select(c.alias("x"), "split").distinct().groupBy("x").agg(F.count(F.lit(1)).alias("k")).agg(F.count_if(F.col("k") > 1).alias(n))
    twice = rows.select("qid", "split", "question").distinct().groupBy("qid", "split").agg(F.count(F.lit(1)).alias("k")).agg(F.count_if(F.col("k") > 1).alias("repeated_qids"))
    out = sides(F.col("qid"), "shared_qids")
    for c, n in ((T.normalised_question(F.col("question")), "shared_questions"), (F.col("chunk_id"), "shared_chunks")):
        out = out.crossJoin(sides(c, n))  # one row each
    return out.crossJoin(twice)


def check_no_leaks(rows: DataFrame) -> None:
    found = {k: v for k, v in leaks(rows).first().asDict().items() if v}
    if found:
        raise LeakageError(f"the splits aren't apart: {found}")


def pair_faults(pairs: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """(fault, n) of training pairs (qid, question, chunk_id, text): test qids, qids of no split, test questions, empty texts."""
    test_ids, train_ids = (x.select("qid").distinct().withColumn(n, F.lit(True)) for x, n in ((test, "is_test"), (train, "is_train")))
    joined = pairs.join(test_ids, "qid", "left").join(train_ids, "qid", "left").withColumn("key", T.normalised_question(F.col("question")))
    joined = joined.join(_told(test, "leaked").withColumnRenamed("text", "key"), "key", "left")
    faults = {"test_qid": F.col("is_test"), "unknown_qid": F.col("is_train").isNull() & F.col("is_test").isNull(), "test_question": F.col("leaked"), "empty_text": F.trim(F.coalesce("text", F.lit(""))) == ""}
    counts = joined.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in faults.items()])
    return counts.select(F.explode(F.create_map(*[x for n in faults for x in (F.lit(n), F.col(n))])).alias("fault", "n"))


def check_pairs(pairs: DataFrame, train: DataFrame, test: DataFrame) -> None:
    """LeakageError if the pairs themselves have a fault, however they were made."""
    found = {r["fault"]: r["n"] for r in pair_faults(pairs, train, test).collect() if r["n"]}  # four rows
    if found:
        raise LeakageError(f"the training pairs have faults: {found}")
