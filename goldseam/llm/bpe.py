"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import load, prepare, texts

#: A single space between two characters that aren't white space: every match of
#: the pattern ends before it and the next one starts with it, whatever surrounds it.
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Characters after which a text is cut at the next safe boundary.
PIECE = 1 << 16
#: White space as the pattern means it, so much in a row that the pattern's search for its end is not to be relied on.
BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")
#: A pattern whose only match is the whole text.
ONE = r"(?s:.+)"


class SafeEncoder:
    """Encodes texts whole, long ones in pieces of at least PIECE characters that end at safe boundaries.

    encode(text) gives the ids as little-endian numbers of the given type; a text
    without a safe boundary is never cut.

    A match of the pattern never goes from other characters into white space, and a
    run of white space is one match, but for its last character if other ones
    follow, which start with it.  So a long run is encoded as the one match it is
    (single does that) without the pattern, whose search in it would need a stack as
    deep as the run is long.
    """

    def __init__(self, encode: Callable[[str], list[int]], single: Callable[[str], list[int]], dtype: str = "<u4"):
        self.ids = lambda text: np.array(encode(text), dtype).tobytes()
        self.one = lambda text: np.array(single(text), dtype).tobytes()

    def encode(self, text: str) -> bytes:
        out, at = [], 0
        for run in BLANK.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += [self.cut(text[at : run.start()]), self.one(text[run.start() : end])]
            at = end
        return b"".join([*out, self.cut(text[at:])]) if at else self.cut(text)

    def cut(self, text: str) -> bytes:
        out, at = [], 0
        while len(text) - at > PIECE and (cut := SAFE.search(text, at + PIECE)):
            out.append(self.ids(text[at : cut.start()]))
            at = cut.start()
        return b"".join([*out, self.ids(text[at:])]) if at else self.ids(text)


@lru_cache(4)
def encoding(rank_file: str, pattern: str = public_tokenizers.PATTERN):
    """The library's encoding for a file of base64 tokens and ranks, without special tokens."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(2)
def encoder(rank_file: str, pattern: str = public_tokenizers.PATTERN) -> SafeEncoder:
    # the second encoding is made for the first long run of white space, which most workers never meet
    return SafeEncoder(encoding(rank_file, pattern).encode_ordinary, lambda text: encoding(rank_file, ONE).encode_ordinary(text))


def encode(docs: DataFrame, rank_file: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) for every row, in any order.

    A null or empty text has no ids.  Repeated rows, null ids and extra columns
    are no special case: each row is encoded by itself, in one pass without a
    shuffle, and an empty table gives an empty one.  Texts of any length are
    encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_file, pattern)
        for batch in batches:
            rows = [enc.encode(t.decode("utf-8", "replace")) for t in batch.column("text").to_pylist()]
            offsets = np.cumsum([0, *(len(r) // 4 for r in rows)]).astype(np.int32)
            values = np.frombuffer(b"".join(rows), "<u4").astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column("id"), ids], ["id", "ids"])

    source = texts(docs, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, rank_file: str, id_col: str = "doc_id", ids_col: str = "ids", more: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *more, decoded binary): the raw bytes of each row's ids; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            out = [enc.decode_bytes(x or []) for x in lists.to_pylist()]
            cols = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "ids"]
            names = [n for n in batch.schema.names if n != "ids"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.binary())], [*names, "decoded"])

    prepare(encoded.sparkSession)
    source = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"), *more)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "ids")
    return source.mapInArrow(run, f"{fields}, decoded binary").withColumnRenamed("id", id_col)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = encode(load(spark, sf_dir, "documents"), ranks)
    ids = ids.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"))
    back = decode(ids, ranks, more=("n_tokens", "ids_sha256"))
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op5_bpe": op5_bpe}
