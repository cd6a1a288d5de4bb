"""Places in an order, and a digest that depends on it, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldseam.store import stored

#: Fixed values of the digest: leaves or nodes of a node, and levels above the leaves.
FANOUT, LEVELS = 1024, 4


def numbered(rows: DataFrame, *keys: str, name: str = "place") -> DataFrame:
    """The rows with their place from 0 in the order of the keys: counted within ranges of it, whose first places are the sizes before them."""
    ranges = stored(rows.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    first = sizes.select("__range", F.coalesce(before, F.lit(0)).alias("__first"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*keys)) - 1
    return ranges.withColumn("__within", within).join(F.broadcast(first), "__range").withColumn(name, F.col("__first") + F.col("__within")).drop("__range", "__n", "__first", "__within")


def ordered_digest(files: DataFrame, path: str, content: Column, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """One row (files, digest): a SHA-256 over all (path, content) in the order of their paths.

    A leaf is the hash of a path, a zero byte and the content; a node is the hash of
    `fanout` leaves or nodes that follow each other, so a byte or a path that
    changes, and a file that comes, goes or moves, changes the digest.  The tree has
    as many levels whatever the number of files, and each is an aggregate by place.
    No files give the hash of nothing.
    """
    leaf = F.sha2(F.concat(F.col(path).cast("binary"), F.lit(b"\0"), F.coalesce(content, F.lit("")).cast("binary")), 256)
    nodes = numbered(files.select(F.col(path).alias("path"), leaf.alias("hash")), "path", "hash").select("place", "hash")
    total = files.agg(F.count(F.lit(1)).alias("files"))
    for _ in range(levels):
        listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "hash"))), lambda x: x["hash"]), "")
        nodes = nodes.groupBy(F.floor(F.col("place") / fanout).alias("place")).agg(listed.alias("hashes")).select("place", F.sha2("hashes", 256).alias("hash"))  # fanout rows a group
    return total.crossJoin(nodes.agg(F.first("hash").alias("hash"))).select("files", F.coalesce("hash", F.sha2(F.lit(""), 256)).alias("digest"))
