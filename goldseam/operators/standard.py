"""The six lanes over one corpus: lexical, dense, fused, reranked, by a hypothetical passage, and reranked by a second checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldseam.config import Settings
from goldseam.operators import embedding as N
from goldseam.operators import retrieval as R
from goldseam.operators.completion import Completion, replied
from goldseam.operators.lanes import Answer, Lane, Registry, stage

ASK = "Write a short passage, as documentation would have it, that answers the question.\n\nQuestion: "


def six_lanes(chunks: DataFrame, index: R.Bm25Index, vectors: DataFrame, writer: Callable[[DataFrame], Completion], settings: Settings | None = None, embedder: N.Embedder = N.hashed, scorer: Callable = R.lexical_score, tuned: Callable = R.weighted_score) -> Registry:
    """The lanes in their order, over chunks (chunk_id, text), their lexical index and their vectors (chunk_id, vector).

    writer gets the lexical hits (qid, chunk_id, rank) and gives the completion that
    writes hypothetical passages; a model ignores the hits.  Such a passage is
    embedded as text, without the instruction for queries, and searched with; the
    lexical arm and the reranker keep the question.  A question without a passage is
    a failed one: it never falls back to the question itself.  scorer and tuned are
    two checkpoints of one lane; nothing else differs between them.
    """
    s = settings or Settings()
    registry = Registry()

    def lexical(asked: DataFrame) -> DataFrame:
        return stage("bm25", R.bm25_search(index, asked, s.retrieve_depth))

    def dense(asked: DataFrame, prefix: str) -> DataFrame:
        embedded = stage("embed", N.embed_queries(asked, embedder, prefix))
        return stage("vectors", R.dense_search(vectors, embedded, s.retrieve_depth, exclude_self=False))

    def fused(*arms: DataFrame) -> DataFrame:
        named = [a.select(F.lit(i).alias("list_id"), "qid", "chunk_id", "rank") for i, a in enumerate(arms)]
        both = named[0]
        for more in named[1:]:
            both = both.unionByName(more)
        return stage("rrf", R.rrf(both, s.rrf_k))

    def cut(found: DataFrame, k: int) -> DataFrame:
        return found.where(F.col("rank") <= k)

    def reranked(score: Callable) -> Callable:
        def retrieve(asked: DataFrame, k: int) -> DataFrame:
            both = fused(lexical(asked), dense(asked, N.QUERY_PREFIX))
            return stage("rerank", R.rerank(both, asked, chunks, s.rerank_depth, k, score))

        return retrieve

    def hypothetical(asked: DataFrame, k: int) -> Answer:
        hits = lexical(asked)
        said = stage("hyde", replied(asked.withColumn("prompt", F.concat(F.lit(ASK), "question")), writer(hits), "passages"))
        good = asked.join(said.where("reply.error is null").select("qid", F.col("reply.text").alias("passage")), "qid")
        passages = good.select("qid", F.col("passage").alias("question"))
        both = fused(hits.join(good.select("qid"), "qid", "left_semi"), dense(passages, ""))
        usage = said.select("qid", "reply.error", "reply.prompt_tokens", "reply.completion_tokens")
        return Answer(stage("rerank", R.rerank(both, asked, chunks, s.rerank_depth, k, scorer)), usage)

    registry.add(Lane("bm25", "BM25", lambda asked, k: cut(lexical(asked), k)))
    registry.add(Lane("dense", "Dense", lambda asked, k: cut(dense(asked, N.QUERY_PREFIX), k)))
    registry.add(Lane("hybrid_rrf", "Hybrid", lambda asked, k: cut(fused(lexical(asked), dense(asked, N.QUERY_PREFIX)), k)))
    registry.add(Lane("hybrid_rerank", "Hybrid, reranked", reranked(scorer)))
    registry.add(Lane("hyde", "Hypothetical passage", hypothetical))
    registry.add(Lane("hybrid_rerank_tuned", "Hybrid, reranked by the tuned checkpoint", reranked(tuned)))
    return registry
