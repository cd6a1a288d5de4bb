"""Queries over the inverted-file index of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from goldseam.operators import retrieval as R
from goldseam.operators import vectors as V
from goldseam.plans import retrieval as P
from goldseam.plans.inputs import K, shared
from goldseam.store import load

QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: Lists of the queries' index, so that the small tables have several.
LISTS = 64
#: Probes whose recall is measured.
PROBES = (4, 16, 32, 40, LISTS)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def vectors(spark, d):
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("corpus_id"))


def asked(spark, d):
    """Every fiftieth vector is a query."""
    return vectors(spark, d).where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("qid"), "vector")


def index(spark, d):
    return shared(spark, d, "vector-index", lambda: V.build(vectors(spark, d), LISTS))


@query(P.ORACLE_SQL["dense_topk"])
def vector_index_topk(spark, d):
    """A probe of every list is a search of every vector."""
    return V.search(index(spark, d), asked(spark, d), K, probes=LISTS, exclude_self=True)


@query("""select qid, chunk_id, score, rank::int as rank from (select *, row_number() over (partition by qid order by score desc, chunk_id) as rank from (
 select q.vec_id as qid, c.vec_id as chunk_id, round(list_inner_product(c.embedding::double[], q.embedding::double[]), 6) as score from embeddings q join embeddings c on q.vec_id % 50 = 0 and c.label = 3)) where rank <= 10""")
def vector_index_corpus(spark, d):
    """The chunks of one corpus only, the question's own row among them."""
    return V.search(index(spark, d), asked(spark, d), K, probes=LISTS, corpus="3")


@query()
def vector_index_recall(spark, d):
    """The share of the exact ten best that so many probes find; no SQL, as the lists come from k-means."""
    exact = R.dense_search(vectors(spark, d), asked(spark, d), K)
    rows = [V.recall(V.search(index(spark, d), asked(spark, d), K, p, exclude_self=True), exact).select(F.lit(p).alias("probes"), F.lit(LISTS).alias("lists"), F.round("recall", 4).alias("recall")) for p in PROBES]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out
