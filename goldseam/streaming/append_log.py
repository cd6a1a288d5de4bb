"""Resumable append logs as a stream of files, each batch exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from goldseam import versions


def append(spark: SparkSession, sink: str, rows: DataFrame, name: str) -> bool:
    """Add rows to the log as the entry of that name, unless it has one; whether they were added.

    The rows are written to a folder of their own first and count from the moment
    its name is committed, so a writer that fails or loses a race adds nothing.
    """
    if name in versions.names(spark, f"{sink}/commits"):
        return False
    folder, path = versions.staged(sink)
    rows.write.parquet(path)
    return versions.claim(spark, f"{sink}/commits/{name}", folder)


def read_log(spark: SparkSession, sink: str, schema: str, key: str | None = None) -> DataFrame:
    """The rows of all committed entries; with a key, one row for each: that of the first entry by name that has it."""
    entries = [n for n in versions.names(spark, f"{sink}/commits") if not n.startswith("_")]
    out = spark.createDataFrame([], f"{schema}, entry string")
    if entries:
        named = spark.createDataFrame([(n, versions.content(spark, f"{sink}/commits/{n}")) for n in entries], "entry string, folder string")
        paths = [f"{sink}/versions/{r['folder']}" for r in named.collect()]
        rows = spark.read.schema(schema).parquet(*paths).withColumn("folder", F.element_at(F.split(F.input_file_name(), "/"), -2))
        out = rows.join(F.broadcast(named), "folder").drop("folder")  # a row for each batch
    if key:
        first = out.groupBy(key).agg(F.min_by(F.struct(*out.columns), "entry").alias("r"))
        out = first.select("r.*")
    return out.drop("entry")


def resume(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, key: str = "qid") -> StreamingQuery:
    """Work on every new row of the JSON files under source and append the results to the log at sink, then stop.

    A batch is committed under its number, so one that is repeated after a failure,
    or that two runs race for, counts once.  Keys that the log already holds are
    skipped; read_log() with the key gives one row for each.
    """

    def batch(rows: DataFrame, number: int) -> None:
        out = work(rows.dropDuplicates([key]))
        if versions.names(spark, f"{sink}/commits"):
            done = read_log(spark, sink, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields))
            out = out.join(done.select(key), key, "left_anti")
        append(spark, sink, out, f"{number:012}")

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
