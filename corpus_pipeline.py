"""A training corpus from documents: quality rules, near-dedup, removal of repeats, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
stage's result as Parquet in the shared folder and rereads it as the next one's
docs.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldseam.llm.minhash import near_duplicates
from goldseam.llm.packing import pack
from goldseam.llm.quality import labelled_sample, learn, statistics, verdict
from goldseam.llm.suffixes import remove_repeats
from goldseam.store import load, stored, temporary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Bytes of a repeated string that goes: 50 words of three letters and a space, so that no passage of over 50 longer words is missed.
PASSAGE = 200


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list rejects."""
    sample = labelled_sample(load(spark, sf_dir, "labels"))
    wanted = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")
    kept, _ = verdict(learn(statistics(wanted), F.broadcast(sample)))
    held = docs.select(F.struct(*COLUMNS).alias("doc"), "doc_id", "text")
    return statistics(held, keep=("doc",)).where(kept).select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component (five-word shingles, similarity 0.8): that of smallest id.

    Rows are documents of their own, numbered here, whatever their ids: of rows that
    repeat an id and are near copies one stays, others with different texts all do;
    null ids come after all others, and ties go to the row that is read first.
    """
    rows = stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows")
    found = near_duplicates(rows.select("row", "text"), 5, 0.8, id_col="row").select("row", "component_id")
    many = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("component_id")
    members = found.join(many, "component_id", "left_semi").join(rows.select("row", "doc_id"), "row")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    gone = members.join(first, "component_id").where(F.col("row") != F.col("first.row")).select("row")
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings of PASSAGE that occur twice, their first copy included; bytes of a character that a cut splits go too.

    Near copies are gone by now, so what still repeats is boilerplate and passages
    spliced into other texts: no document has a better claim to them than another.
    """
    held = docs.select("doc_id", "text", F.struct("lang", "source").alias("doc"))
    cut = remove_repeats(held, PASSAGE, keep=("doc",), whole=True)
    return cut.select("doc_id", F.col("kept").cast("string").alias("text"), "doc.*").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens in the sources' proportions, a row for each piece."""
    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality rules", quality), ("minhash near-dedup", near_dedup), ("suffix-array dedup", repeats), ("packing", packing)]

#: SQL can't express the learned list or the MinHash candidates; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces; what the stages store in between is deleted."""
    docs = load(spark, sf_dir, "documents")
    with temporary(spark) as result:
        for name, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        name, last = STAGES[-1]
        return result(last(spark, docs, sf_dir), name)
