"""JSON-lines tables with explicit schemas, and folders of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldseam.config import EngineError

#: Fixed value: the file types that are documents (PDF needs a reader of its own).
SUFFIXES = ("txt", "md", "mdx")

GOLD_SCHEMA = "qid string, question string, gold_chunk_ids array<string>, source_doc string, query_type string, status string"


def read_split(spark: SparkSession, path: str, schema: str = GOLD_SCHEMA, statuses: tuple[str, ...] | None = None) -> DataFrame:
    """Gold rows in qid order, with `statuses` only those of them; rows without a gold chunk raise EngineError, which names some."""
    rows = spark.read.schema(schema).json(path)
    if statuses is not None:
        rows = rows.where(F.col("status").isin(*statuses))
    if bad := rows.where("gold_chunk_ids is null or size(gold_chunk_ids) = 0").select("qid").limit(5).collect():
        raise EngineError(f"rows without gold chunks: {', '.join(str(r['qid']) for r in bad)}")
    return rows.orderBy("qid")


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def discover(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """(source_doc, text) of every text or markdown file below a folder, in the order of their paths relative to it.

    A folder that isn't there raises EngineError.  Files of other types are passed
    over; with `strict` they raise EngineError, which names some.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise EngineError(f"there is no folder {folder}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    inner = F.substring_index("path", folder.rstrip("/") + "/", -1)
    readable = F.lower("path").rlike(f"\\.({'|'.join(SUFFIXES)})$")
    if strict and (other := files.where(~readable).select(inner.alias("p")).limit(5).collect()):
        raise EngineError(f"no documents: {', '.join(r['p'] for r in other)}")
    return files.where(readable).select(inner.alias("source_doc"), F.decode("content", "UTF-8").alias("text")).orderBy("source_doc")


def read_hand_map(spark: SparkSession, path: str, schema: str = "also array<string>, why string") -> DataFrame:
    """(qid, fields of the schema) of a JSON object of entries by qid; keys that start with _ are notes. A path without a file has no entries."""
    jvm = spark._jvm.org.apache.hadoop.fs
    at = jvm.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], f"qid string, {schema}")
    whole = spark.read.text(path, wholetext=True)
    entries = whole.select(F.explode(F.from_json("value", f"map<string, struct<{_struct(schema)}>>")).alias("qid", "entry"))
    return entries.where(~F.col("qid").startswith("_")).select("qid", "entry.*")


def _struct(schema: str) -> str:
    """A column list as the fields of a struct type."""
    return ", ".join(f"{name}: {kind}" for name, kind in (x.strip().split(" ", 1) for x in schema.split(", ")))


def read_qids(spark: SparkSession, path: str) -> DataFrame:
    """(qid) of a file of one a line; blank lines and those that start with # are none."""
    return spark.read.text(path).where(~F.col("value").startswith("#")).select(F.regexp_replace("value", "^\\s+|\\s+$", "").alias("qid")).where("qid <> ''").distinct()


#: The fields of audit decisions and of judge records.
AUDIT_SCHEMA = "qid string, human_verdict string, screen_verdict string, screen_rule string, agreed boolean, question string, blind boolean, decided_at string, queue_kind string, second_verdict string, agreed_with_second boolean"
JUDGE_SCHEMA = "qid string, lane_id string, question string, answer string, chunk_ids array<string>, grounded boolean, verdicts array<struct<n:int,sentence:string,supported:boolean,reason:string>>"


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit decisions; of several on one question, the last decided counts."""
    rows = spark.read.schema(AUDIT_SCHEMA).json(path)
    newest = rows.groupBy("qid").agg(F.max_by(F.struct(*rows.columns), F.coalesce("decided_at", F.lit(""))).alias("r"))
    return newest.select("r.*")


def read_judged(spark: SparkSession, path: str) -> DataFrame:
    """Judge records with their verdicts."""
    return spark.read.schema(JUDGE_SCHEMA).json(path)
