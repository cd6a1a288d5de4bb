"""Cutting lineage through tables in the folder that driver and executors share.

Every iterative or multi-pass operator writes its intermediate result once and
reads it back.  The files survive the loss of any executor, and a retried task
reads exactly the rows that the first attempt saw.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The tables of the innermost block of temporary(); None outside of any.
_open: ContextVar[list[str] | None] = ContextVar("open tables", default=None)
#: Rows and bytes that one Arrow batch may hold, so that neither long texts nor large tables fill a worker's memory.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table, always through Spark's own reader."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """A table of fewer files than the session has cores, dealt to all of them: each file may be one row group, which one task reads.

    Larger inputs are left as they lie; only small ones are shuffled.  `of` is the
    table that df selects rows of, if df reads others too.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    # the names of the files stay in the JVM, which has listed them to plan the scan
    return df.repartition(cores) if len((of or df)._jdf.inputFiles()) < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset, a local master uses a folder of the warehouse; on a cluster
    no folder can be guessed that all executors see, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def stored(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write df as a table in the shared folder, a folder for each value of the columns `by`, and return the table."""
    spark = df.sparkSession
    prepare(spark)
    path = f"{shared_dir(spark)}/goldseam/{label}-{uuid.uuid4().hex}"
    if (tables := _open.get()) is not None:
        tables.append(path)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables by path, wherever they are."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that are stored in the block are deleted at its end, but for those stored by the function it yields."""
    outer, own = _open.get(), []
    token = _open.set(own)

    def keep(df: DataFrame, label: str) -> DataFrame:
        inner = _open.set(outer)
        try:
            return stored(df, label)
        finally:
            _open.reset(inner)

    try:
        yield keep
    finally:
        _open.reset(token)
        dropped(spark, own)
