"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from goldseam.store import BATCH_BYTES, BATCH_ROWS, load, prepare, shared_dir, stored, temporary  # noqa: F401  (re-exported)

#: The six ASCII characters that end a word.
WHITE = " \t\n\x0b\x0c\r"

def texts(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the wanted columns, the text as bytes (null: none), so that extra columns never matter."""
    from pyspark.sql import functions as F

    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"), *[F.col(c) for c in more])
