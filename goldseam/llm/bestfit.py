"""Best-fit packing by minimum bin slack: each sequence gets the fullest combination of pieces that are left."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import load, stored, temporary, texts
from goldseam.llm.packing import WINDOW, tokenizer

#: Pieces among which combinations are sought: some ten thousand sequences, of which only the last ones lack choice.
GROUP = 131_072
#: Bytes of ids that leave a task at a time.
OUT_BYTES = 8 << 20


def fullest(counts: list[int], lengths: list[int], room: int) -> list[int]:
    """The lengths, longest first, whose sum comes nearest to room; counts has how often each may be taken, lengths those to be had in ascending order.

    Bit s of a number says that s is the sum of some of the lengths seen so far.
    A length joins by a shift, once for each piece of it; the search ends when room
    itself is reached.  What a sum is made of is read backwards from the numbers.
    """
    reach, whole, steps = 1, (2 << room) - 1, []
    for n in reversed(lengths[: bisect_right(lengths, room)]):
        for _ in range(min(counts[n], room // n)):
            more = (reach | reach << n) & whole
            if more == reach:
                break
            steps.append((n, reach))
            reach = more
        if reach >> room:
            break
    left, taken = reach.bit_length() - 1, []
    for n, before in reversed(steps):
        if not before >> left & 1:
            taken.append(n)
            left -= n
    return taken[::-1]


def fill(lengths: np.ndarray, window: int) -> Iterator[list[int]]:
    """The sequences, as lists of places in `lengths`, which are at most window.

    Each sequence starts with the longest piece left, so that long pieces don't
    remain alone at the end, and the fullest combination for the room beside it is
    sought and removed.  As long as all its pieces are there it stays the fullest,
    so it is repeated without another search.
    """
    order = np.argsort(lengths, kind="stable")
    kinds, first = np.unique(lengths[order], return_index=True)
    own = {n: places[::-1].tolist() for n, places in zip(kinds.tolist(), np.split(order, first[1:]), strict=True)} if len(kinds) else {}
    counts = [0] * (window + 1)
    for n, places in own.items():
        counts[n] = len(places)
    alive = sorted(own)
    while alive:
        longest = alive[-1]
        counts[longest] -= 1
        taken = [longest, *fullest(counts, alive, window - longest)]
        counts[longest] += 1
        need = {n: taken.count(n) for n in taken}
        for _ in range(min(counts[n] // m for n, m in need.items())):
            yield [own[n].pop() for n in taken]
        for n, m in need.items():
            counts[n] = len(own[n])
            if not counts[n]:
                alive.remove(n)


def pack_best_fit(docs: DataFrame, vocab_file: str, window: int = WINDOW, end_id: int = 2, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (id_col, piece, start, length, ids, sequence_id, offset) of sequences of at most `window` tokens.

    ids holds little-endian 32-bit ids.  A document is its text's ids and end_id.
    One longer than a window is cut into pieces of a window each, the first of them
    shorter if need be; a piece of a whole window is a sequence by itself.  All
    other pieces are dealt by hash to groups of about `group` pieces, and minimum
    bin slack fills the sequences of a group: a task holds a length and a number
    for each piece, never the ids, which meet their places by a join.  A sequence's
    number is that of its first piece.

    Null and empty texts are one end_id.  Rows that repeat an id, and null ids, are
    packed once for each row.  A text of any length is encoded whole by one task.
    Extra columns are ignored, an empty table gives no pieces.  The result reads a
    table in the shared folder: store it in a block of temporary() to have that
    deleted.
    """
    source = texts(docs, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    columns = ["key", "id", "piece", "start", "length", "ids"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, dtype = tokenizer(vocab_file)
        size = np.dtype(dtype).itemsize
        end, key = np.array([end_id], dtype).tobytes(), TaskContext.get().partitionId() << 33

        def packed(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
            kinds = [pa.int64(), id_type, pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], columns)

        for batch in batches:
            rows, held = [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = ids(text.decode("utf-8", "replace")) + end
                n = len(data) // size
                starts = [0, *range(n % window or window, n, window)]
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    rows.append((key, i, piece, a, b - a, data[a * size : b * size]))
                    key, held = key + 1, held + (b - a) * size
                    if held >= OUT_BYTES:
                        yield packed(rows, batch.column(0).type)
                        rows, held = [], 0
            if rows:
                yield packed(rows, batch.column(0).type)

    pieces = stored(source.mapInArrow(cut, f"key long, id {kind}, piece int, start long, length long, ids binary"), "pieces")
    short = pieces.where(F.col("length") < window)
    groups = max(1, -(-short.count() // group))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key", kind="stable")  # the same sequences whatever the order of arrival
        keys, lengths = frame["key"].to_numpy(), frame["length"].to_numpy()
        out = [(keys[p], keys[places[0]], offset) for places in fill(lengths, window) for p, offset in zip(places, np.cumsum([0, *lengths[places[:-1]]]).tolist(), strict=True)]
        return pd.DataFrame(out, columns=["key", "sequence_id", "offset"])

    dealt = short.select("key", "length", F.pmod(F.xxhash64("key"), F.lit(groups)).alias("group"))
    placed = dealt.groupBy("group").applyInPandas(solve, "key long, sequence_id long, offset long")
    alone = pieces.where(F.col("length") == window).withColumns({"sequence_id": F.col("key"), "offset": F.lit(0).cast("long")})
    both = alone.unionByName(short.join(placed, "key"))

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(3).to_pylist()
            ids = pa.array([np.frombuffer(x, f"<u{len(x) // n}").astype("<u4").tobytes() for x, n in zip(batch.column(4).to_pylist(), lengths, strict=True)], pa.binary())
            yield batch.set_column(4, "ids", ids)

    final = both.select("id", "piece", "start", "length", "ids", "sequence_id", "offset")
    return final.mapInArrow(wide, final.schema).withColumnRenamed("id", id_col)


def op12_bestfit(spark, sf_dir: str) -> DataFrame:
    """All documents packed into few sequences, a row for each piece."""
    with temporary(spark) as result:
        pieces = pack_best_fit(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
        return result(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"), "best-fit")


QUERIES = {"op12_bestfit": op12_bestfit}
