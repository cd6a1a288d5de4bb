"""Vectors of texts: a seam for models, and a default that needs none."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldseam.functions import text as T
from goldseam.operators import retrieval

#: Fixed value: the instruction that queries carry and passages don't.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
#: Dimensions of the default embedder.
DIMS = 64

Embedder = Callable[[Column], Column]


def hashed(text: Column, dims: int = DIMS) -> Column:
    """The default embedder: each word adds 1 or -1 to the dimension that its MD5 names.  Null counts as empty: zeros."""

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            words = lists.flatten().dictionary_encode()
            slot = np.array([int(md5(w.encode()).hexdigest()[:8], 16) % (2 * dims) for w in words.dictionary.to_pylist()], np.int64)
            at = np.repeat(np.arange(len(lists)) * 2 * dims, lists.value_lengths().to_numpy()) + slot[words.indices.to_numpy()]
            counts = np.bincount(at, minlength=len(lists) * 2 * dims).reshape(-1, 2, dims)
            added = (counts[:, 0] - counts[:, 1]).astype(np.float64)
            norm = np.sqrt((added * added).sum(axis=1, keepdims=True))
            unit = added / np.where(norm > 0, norm, 1.0)
            yield pa.ListArray.from_arrays(np.arange(0, unit.size + 1, dims, dtype=np.int32), unit.ravel())

    return run(T.tokens(F.coalesce(text, F.lit(""))))


def model_embedder(make: Callable[[], Callable[[list[str]], np.ndarray]]) -> Embedder:
    """An embedder from make(), which a worker calls once a task for the model: a function from texts to rows of numbers."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            v = np.asarray(model([t or "" for t in texts]), np.float64).reshape(len(texts), -1)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.Series(list(v / np.where(n > 0, n, 1.0)))

    return run


def embed_chunks(chunks: DataFrame, embedder: Embedder = hashed, text_col: str = "text") -> DataFrame:
    """The chunks with a column `vector` of length 1, that of their bare text."""
    return chunks.withColumn("vector", embedder(F.col(text_col)))


def embed_queries(questions: DataFrame, embedder: Embedder = hashed, prefix: str = QUERY_PREFIX) -> DataFrame:
    """The questions with the vector of their text behind the prefix; an empty prefix adds nothing."""
    return questions.withColumn("vector", embedder(F.concat(F.lit(prefix), F.coalesce("question", F.lit("")))))


def prefix_arms(chunks: DataFrame, questions: DataFrame, k: int, embedder: Embedder = hashed, prefix: str = QUERY_PREFIX) -> DataFrame:
    """(lane_id, qid, chunk_id, score, rank) of the dense lane, its queries with the prefix and without it."""
    found = [retrieval.dense_search(chunks, embed_queries(questions, embedder, p), k, exclude_self=False).select(F.lit(name).alias("lane_id"), "qid", "chunk_id", "score", "rank") for name, p in (("with_prefix", prefix), ("without_prefix", ""))]
    return found[0].unionByName(found[1])
