"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldseam.store import dropped, stored, temporary


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Minimum labels travel along the edges, and each round also jumps from a label
    to that label's own label, so a chain of length d needs about log2(d) rounds.
    Each round is written to the shared folder, the one before it deleted; only a
    count of changed labels reaches the driver.  Null ends and self loops add no
    link (a self loop still lists its node); an empty table gives an empty table.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    with temporary(spark) as keep:
        both = stored(both.distinct(), "edges")
        labels = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")), "labels")
        while True:
            near = both.join(labels.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
            step = labels.join(near, "u").select("u", F.col("l").alias("old"), F.least("l", "m").alias("l"))
            step = stored(step, "step")
            jump = step.select(F.col("u").alias("l"), F.col("l").alias("ll"))
            nxt = stored(step.join(jump, "l", "left").select("u", "old", F.coalesce("ll", "l").alias("l")), "labels")
            if nxt.where("l <> old").limit(1).count() == 0:
                return keep(nxt.select(F.col("u").alias("node"), F.col("l").alias("component")), "components")
            dropped(spark, [t._jdf.inputFiles()[0].rsplit("/", 1)[0] for t in (labels, step)])
            labels = nxt.select("u", "l")
