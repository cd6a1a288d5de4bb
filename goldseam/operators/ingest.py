"""Documents to overlapping, stably identified chunks, and the chunk table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldseam.config import SlugCollision
from goldseam.functions import text as T
from goldseam.store import prepare


def model_spans(vocab_file: str) -> Callable[[Column, int, int], Column]:
    """The characters (start, end) of a text's windows of tokens by a vocabulary file of the tokenizers library, which a worker loads once; tokens of no character are dropped.

    Only windows leave the worker, and a batch holds few texts: neither keeps the
    tokens of more than one text.
    """

    def windows(text: Column, size: int, overlap: int) -> Column:
        @F.pandas_udf("array<struct<start:int,end:int>>")
        def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(vocab_file)
            model.encode_special_tokens = True  # their strings in a text are ordinary text

            def cut(t: str) -> list[dict]:
                tokens = [x for x in model.encode(t, add_special_tokens=False).offsets if x[1] > x[0]]
                stride = size - overlap
                parts = (tokens[i : i + size] for i in range(0, max(len(tokens) - size + stride, 1), stride)) if tokens else ()
                return [{"start": min(a for a, _ in p), "end": max(b for _, b in p)} for p in parts]

            for texts in batches:
                # a text at a time: the offsets of a batch of long ones would fill the worker
                yield pd.Series([cut(t or "") for t in texts], dtype=object)

        return spans(text)

    return windows


def chunk_by_spans(docs: DataFrame, size: int, overlap: int, spans: Callable[[Column, int, int], Column], check: bool = True) -> DataFrame:
    """chunk_documents() whose windows hold `size` tokens of a model: a chunk goes from the first character of its first token to the last of its last."""
    prepare(docs.sparkSession)
    named = _named(docs, check)
    cut = named.select("*", F.posexplode(spans(F.col("text"), size, overlap)).alias("chunk_index", "at"))
    body = F.substring("text", F.col("at.start") + 1, F.col("at.end") - F.col("at.start"))
    return cut.select(T.chunk_id(F.col("slug"), F.col("chunk_index")).alias("chunk_id"), "source_doc", "chunk_index", body.alias("text"), F.col("at.start").alias("start_char"), F.col("at.end").alias("end_char"))


def _named(docs: DataFrame, check: bool) -> DataFrame:
    named = docs.select("source_doc", "text", T.slug(F.col("source_doc")).alias("slug"))
    if check and named.select("slug", "source_doc").distinct().groupBy("slug").count().where("count > 1 or slug = ''").limit(1).count():
        raise SlugCollision("sources with an empty or a common slug")
    return named


def chunk_documents(docs: DataFrame, size: int, overlap: int, check: bool = True) -> DataFrame:
    """(chunk_id, source_doc, chunk_index, text, start_char, end_char) from (source_doc, text), whole words at a time.

    Texts are slices of the original.  Two sources with one slug raise SlugCollision.
    """
    named = _named(docs, check)
    parts = named.withColumn("words", F.regexp_extract_all("text", F.lit("(\\s*\\S+)"), 1))
    windows = parts.select("*", F.posexplode(T.window_starts(F.size("words"), size, overlap)).alias("chunk_index", "first"))
    lead = F.length(F.array_join(F.slice("words", 1, F.col("first")), ""))
    body = F.array_join(F.slice("words", F.col("first") + 1, size), "")
    cut = windows.select("source_doc", "slug", "chunk_index", lead.alias("lead"), body.alias("body"))
    clean = F.regexp_replace("body", "^\\s+", "")
    start = F.col("lead") + F.length("body") - F.length(clean)
    return cut.select(T.chunk_id(F.col("slug"), F.col("chunk_index")).alias("chunk_id"), "source_doc", "chunk_index", clean.alias("text"), start.alias("start_char"), (start + F.length(clean)).alias("end_char"))


def ingest_report(chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks, and the least, upper median and largest length."""
    sized = chunks.select("source_doc", F.length("text").alias("n"))
    ranked = sized.groupBy("n").agg(F.count(F.lit(1)).alias("c"))  # lengths are few: no list of all chunks is gathered
    total = ranked.agg(F.sum("c").alias("total"))
    from pyspark.sql import Window

    upto = ranked.withColumn("upto", F.sum("c").over(Window.orderBy("n")))
    median = upto.crossJoin(total).where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("n").alias("median_chars"))
    base = sized.agg(F.countDistinct("source_doc").alias("documents"), F.count(F.lit(1)).alias("chunks"), F.min("n").alias("min_chars"), F.max("n").alias("max_chars"))
    return base.crossJoin(median)


#: Fixed value: vectors for which an index has a list.
LIST_ROWS = 1000


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The table after new rows replace those of equal key and the others are added; of new rows that repeat a key, one is taken."""
    new = new.dropDuplicates([key])
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def index_lists(rows: int) -> int:
    """Lists of an inverted-file index for so many vectors: one for every thousand (a fixed value), one at least."""
    if rows < 0:
        raise ValueError("rows must not be negative")
    return max(1, rows // LIST_ROWS)


def prune(table: DataFrame, keep: DataFrame, corpus: str, key: str = "chunk_id") -> DataFrame:
    """The table without that corpus's rows whose key isn't kept; other corpora stay."""
    kept = table.where(F.col("corpus_id") == corpus).join(keep.select(key).distinct(), key, "left_semi")
    return table.where(F.col("corpus_id") != corpus).unionByName(kept.select(table.columns))


#: Why a source file is left out, in order: fixed values.
SKIP_REASONS = ("reference", "boilerplate", "fixture", "subdirectory", "too_small")


def skip_reason(path, n_bytes, least: int = 500, folders: tuple[str, ...] | None = None):
    """The first reason to leave a file out, or null; with `folders`, files below any other top folder go, but pages at the top stay."""
    top = F.regexp_extract(path, "^([^/]*)/", 1)
    return (
        F.when(path.rlike("(^|/)(api|reference)(/|$)"), "reference")
        .when(F.lower(path).rlike("(^|/)(license|changelog|contributing|code_of_conduct)[^/]*$"), "boilerplate")
        .when(path.rlike("(^|/)(tests?|fixtures)(/|$)"), "fixture")
        .when(path.contains("/") & ~top.isin(*folders) if folders is not None else F.lit(False), "subdirectory")
        .when(n_bytes < least, "too_small")
    )
