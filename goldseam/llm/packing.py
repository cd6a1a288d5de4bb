"""Mixture-controlled packing: deficit round-robin over source queues."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from fractions import Fraction
from functools import lru_cache
from heapq import heapify, heappop, heapreplace
from itertools import groupby

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from goldseam.llm.bpe import ONE, SafeEncoder
from goldseam.llm.common import load, stored, temporary, texts

#: Tokens of a sequence, sequences of a partition, tokens that a queue saves up before it is served, and queues of sources without a target, if there are more of them.
WINDOW, SPAN, QUANTUM, QUEUES = 1024, 1024, 128, 256


@lru_cache(1)
def tokenizer(vocab_file: str):
    """ids(text) -> bytes of 16- or 32-bit ids, as the tokenizers library gives them without added special tokens.

    A byte-level BPE is a table of byte strings whose ids are their merge ranks, so
    texts go through the quicker library with the same table; one that holds one
    of the file's special tokens goes through tokenizers itself.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    # what few texts need is made for the first of them, so that workers stay small
    own = lru_cache(1)(lambda: Tokenizer.from_file(vocab_file))
    with open(vocab_file, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec.get("added_tokens", [])]
    # the printable stand-ins of a byte-level vocabulary: visible Latin-1 characters for themselves, the others from U+0100 on
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    encoding = lru_cache(2)(lambda pattern: tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))
    dtype = "<u2" if max(spec["model"]["vocab"].values()) < 1 << 16 else "<u4"
    enc = SafeEncoder(encoding(public_tokenizers.PATTERN).encode_ordinary, lambda text: encoding(ONE).encode_ordinary(text), dtype)

    def ids(text: str) -> bytes:
        if any(s in text for s in special):
            return np.array(own().encode(text, add_special_tokens=False).ids, dtype).tobytes()
        return enc.encode(text)

    return ids, dtype


class Mixture:
    """What each queue has given when so many tokens are packed, at target proportions for as long as it lasts.

    All queues start together, each at the rate of its weight.  When one runs dry,
    the others go on in the same proportions to each other.  If weights are the
    queues' own sizes, all run dry together.
    """

    def __init__(self, q: dict[str, int], weight: dict[str, float]):
        self.q, self.weight, self.total = q, {k: Fraction(weight[k]) for k in q}, sum(q.values())
        lasts = {k: n / self.weight[k] for k, n in q.items()}
        #: (tokens packed, time) where a queue runs dry; between them the tokens grow evenly in time
        self.turns, at, w, alive = [(Fraction(0), Fraction(0))], Fraction(0), Fraction(0), sum(self.weight.values())
        for t in sorted(set(lasts.values())):
            w += (t - at) * alive
            alive -= sum(self.weight[k] for k in q if lasts[k] == t)
            at = t
            self.turns.append((w, at))

    def time(self, w: int) -> Fraction:
        """When w tokens are packed, if tokens could be split."""
        i = max(1, min(bisect_left(self.turns, (Fraction(w), Fraction(0))), len(self.turns) - 1))
        (w0, t0), (w1, t1) = self.turns[i - 1], self.turns[i]
        return t0 + (w - w0) * (t1 - t0) / (w1 - w0)

    def exact(self, name: str, w: int) -> Fraction:
        """The tokens of a queue among the first w, as a fraction."""
        return min(Fraction(self.q[name]), self.weight[name] * self.time(w))

    def bounds(self, w: int) -> dict[str, int]:
        """The whole tokens of each queue among the first w.

        Token n of a queue falls due when the queue has earned n, at n / weight; all
        tokens stand in the order in which they fall due, those due together in the
        order of the queues' names, and the first w of them count.  So no queue
        ever gives back a token as w grows, whatever its weight, and each is within
        a few tokens of exact.
        """
        t = self.time(w)
        out = {k: min(n, int(self.weight[k] * t)) for k, n in self.q.items()}
        due = [((out[k] + 1) / self.weight[k], k) for k, n in self.q.items() if out[k] < n]
        heapify(due)
        for _ in range(w - sum(out.values())):  # fewer than there are queues
            _, k = due[0]
            out[k] += 1
            if out[k] < self.q[k]:
                heapreplace(due, ((out[k] + 1) / self.weight[k], k))
            else:
                heappop(due)
        return out


def rounds(queues: dict[str, int], share: dict[str, float], debt: dict[str, float], window: int, quantum: int) -> Iterator[list[tuple[str, int]]]:
    """Deficit round-robin: what each window takes of each queue, in order, until all queues are empty.

    Before each window every queue earns its share of it, among those that still
    have tokens.  The queues are served
    from the largest deficit down while they have saved up a quantum; the largest
    that still have tokens fill the rest on credit, which later windows pay back.
    """
    left = dict(queues)
    names = [k for k in left if left[k]]
    while names:
        alive = sum(share[k] for k in names)
        for k in names:
            debt[k] += share[k] / alive * window
        room, took = window, []
        while room and names:
            k = max(names, key=debt.__getitem__)
            n = min(room, left[k], max(quantum, int(debt[k])))
            took.append((k, n))
            left[k] -= n
            debt[k] -= n
            room -= n
            if not left[k]:
                names.remove(k)
        yield took


def mixed(rows: list[tuple], sources: Iterable[str], quantum: int) -> list[tuple]:
    """A shared queue's slices (id, start, doc_tokens, ids) dealt anew: its sources take turns by deficit round-robin."""
    own: dict[str, list[tuple]] = {}
    for name, row in zip(sources, rows, strict=True):
        own.setdefault(name, []).append(row)
    if len(own) < 2:
        return rows
    left = {k: sum(len(x[3]) for x in v) // 4 for k, v in own.items()}
    total, out = sum(left.values()), []
    at = {k: [0, 0] for k in own}  # the slice and the place in it
    for took in rounds(left, {k: n / total for k, n in left.items()}, dict.fromkeys(own, 0.0), quantum, quantum):
        for k, n in took:
            while n:
                piece, place = at[k]
                i, start, doc_n, ids = own[k][piece]
                take = min(n, len(ids) // 4 - place)
                out.append((i, start + place, doc_n, ids[4 * place : 4 * (place + take)]))
                at[k] = [piece, place + take] if place + take < len(ids) // 4 else [piece + 1, 0]
                n -= take
    return out


def pack(docs: DataFrame, vocab_file: str, window: int = WINDOW, end_id: int = 0, quantum: int = QUANTUM, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text", queue_col: str = "source", targets: dict[str, float] | None = None) -> DataFrame:
    """Pieces (id_col, start, length, ids, doc_tokens, sequence_id, offset) of sequences of `window` tokens.

    ids holds little-endian 32-bit ids.  A document is its text's ids and end_id.
    Each source is a queue, a null source the queue of the empty name.  Beyond
    QUEUES sources, sources share queues by hash: such a queue holds documents by
    how far they are in their own source, so each stretch of it has all sources in
    proportion, and a partition serves its sources by deficit round-robin in turn.

    targets are the sources' shares of each window; sources that it doesn't name
    share what it leaves of 1 by their tokens, and it must leave something for
    them.  A source that runs dry before the others leaves its share to them in
    their proportions.  Without targets, each source's is its share of all tokens,
    so all run dry together.  Every sequence but the tail is full.  Partition j covers the sequences from j * span on and starts
    with the deficits that the exact shares leave at its first token, so deficits
    carry across partitions although each is packed by itself, in bounded memory.
    The tail of fewer than `window` tokens is cut into powers of two and needs no
    padding.  Null and empty texts are one end_id; repeated rows and ids are
    packed once for each row; a document of any length is cut over partitions; an
    empty table gives no pieces.  Texts are tokenised once, into a shared table.
    """
    queue = F.coalesce(F.col(queue_col).cast("string"), F.lit(""))
    shared = docs.select(queue.alias("queue")).distinct().limit(QUEUES + 1).count() > QUEUES
    named = [k for k in targets or {}]
    if any(x <= 0 for x in (targets or {}).values()):
        raise ValueError("targets must be positive")
    shares = "#" * (1 + max(map(len, named), default=0))  # longer than any name, so no shared queue is named like a source
    group = F.when(F.col("queue").isin(named), F.col("queue")).otherwise(F.concat(F.lit(shares), F.pmod(F.xxhash64("queue"), F.lit(QUEUES)).cast("string"))) if shared else F.col("queue")
    source = texts(docs.withColumn("__queue", queue), id_col, text_col, "__queue")
    kind = source.schema["id"].dataType.simpleString()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, dtype = tokenizer(vocab_file)
        end = np.array([end_id], dtype).tobytes()
        seen: dict[str, int] = {}
        chunk = TaskContext.get().partitionId()
        for batch in batches:
            out = [ids(t.decode("utf-8", "replace")) + end for t in batch.column(1).to_pylist()]
            count = [len(x) // np.dtype(dtype).itemsize for x in out]
            offs = []
            keys = batch.column(2).to_pylist()
            for k, n in zip(keys, count, strict=True):
                offs.append(seen.get(k, 0))
                seen[k] = offs[-1] + n
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(out), pa.int32()), batch.column(2), pa.array(offs, pa.int64()), batch.column(0), pa.array(count, pa.int64()), pa.array(out, pa.binary())], ["chunk", "queue", "off", "id", "n", "ids"])

    table = stored(source.mapInArrow(tokens, f"chunk int, queue string, off long, id {kind}, n long, ids binary"), "tokens")
    sizes = table.groupBy("queue", "chunk").agg(F.sum("n").alias("m"))
    before = F.sum("m").over(Window.partitionBy("queue").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    base = stored(sizes.withColumn("base", F.coalesce(before, F.lit(0))).select("queue", "chunk", "base", "m"), "queues")
    q = {r["queue"]: r["m"] for r in base.groupBy(group.alias("queue")).agg(F.sum("m").alias("m")).collect()}  # 2 * QUEUES rows at most
    total = sum(q.values())
    rest = total - sum(q.get(k, 0) for k in named)
    spare = 1 - sum(map(Fraction, (targets or {}).values()))
    if rest and spare <= 0:
        raise ValueError("targets leave nothing for sources that they don't name")
    mix = Mixture(q, {k: Fraction(targets[k]) if k in named else Fraction(n, rest) * spare for k, n in q.items()})
    unit = window * span
    parts = max(1, total // unit)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, dtype = tokenizer(vocab_file)
        size = np.dtype(dtype).itemsize
        at_start = lru_cache(1 << 12)(lambda j: q if j >= parts else mix.bounds(j * unit))
        edge = lambda k, j: at_start(j)[k]
        for batch in batches:
            out: list[tuple] = []
            for k, of, i, n, ids, at in zip(*(batch.column(c).to_pylist() for c in ("queue", "of", "id", "n", "ids", "at")), strict=True):
                lo, hi = 0, parts
                while hi - lo > 1:  # the last partition that starts at or before the document
                    mid = (lo + hi) // 2
                    lo, hi = (mid, hi) if edge(k, mid) <= at else (lo, mid)
                start = 0
                while start < n:
                    stop = min(n, edge(k, lo + 1) - at)
                    if stop > start:
                        out.append((lo, k, of, at + start, i, start, n, ids[start * size : stop * size]))
                        start = stop
                    lo += 1
            cols = list(zip(*out, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), batch.column("id").type, pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["part", "queue", "of", "at", "id", "start", "n", "ids"])

    def serve(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        _, dtype = tokenizer(vocab_file)
        j = int(key[0])
        frame = frame.sort_values(["queue", "at"], kind="stable")
        flow, at = {}, {}
        for k, rows in groupby(zip(frame["queue"], frame["id"], frame["start"], frame["n"], frame["ids"], strict=True), key=lambda r: r[0]):
            flow[k] = [(i, int(s), int(n), np.frombuffer(ids, dtype).astype("<u4").tobytes()) for _, i, s, n, ids in rows]
            if shared:
                flow[k] = mixed(flow[k], frame.loc[frame["queue"] == k, "of"], quantum)
            at[k] = [0, 0]  # the slice and the place in it
        lengths = {k: sum(len(x[3]) for x in v) // 4 for k, v in flow.items()}
        share = {k: float(mix.weight[k]) for k in flow}
        given = mix.bounds(j * unit)
        debt = {k: float(mix.exact(k, j * unit) - given[k]) for k in flow}
        out: list[tuple] = []
        seq = j * span
        for took in rounds(lengths, share, debt, window, quantum):
            n_all = sum(n for _, n in took)
            rooms = [window] if n_all == window else [1 << b for b in range(n_all.bit_length() - 1, -1, -1) if n_all >> b & 1]
            offset = 0
            for k, n in took:
                while n:
                    piece, place = at[k]
                    i, start, doc_n, ids = flow[k][piece]
                    take = min(n, len(ids) // 4 - place, rooms[0] - offset)
                    out.append((i, start + place, take, ids[4 * place : 4 * (place + take)], doc_n, seq, offset))
                    at[k] = [piece, place + take] if place + take < len(ids) // 4 else [piece + 1, 0]
                    n -= take
                    offset += take
                    if offset == rooms[0]:
                        rooms.pop(0)
                        seq, offset = seq + 1, 0
        frame = pd.DataFrame(out, columns=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        if frame["id"].isna().any():
            frame["id"] = frame["id"].astype("Int64" if frame["id"].dropna().map(type).eq(int).all() else object)
        return frame

    at = (F.col("base") + F.col("off")).alias("at")
    if shared:
        # a document's place in its queue: by how far it is in its source, each source with a phase of its own
        whole = base.withColumn("all", F.sum("m").over(Window.partitionBy("queue")))
        phase = F.pmod(F.xxhash64("of", F.lit("phase")), F.lit(1 << 20)) / (1 << 20)
        far = table.join(whole, ["queue", "chunk"]).select(group.alias("queue"), F.col("queue").alias("of"), "id", "n", "ids", at, "all")
        far = far.withColumn("far", (F.col("at") + F.col("n") * phase) / F.col("all")).withColumn("cell", F.floor(F.col("far") * parts))
        until = F.sum("m").over(Window.partitionBy("queue").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
        cells = far.groupBy("queue", "cell").agg(F.sum("n").alias("m")).select("queue", "cell", F.coalesce(until, F.lit(0)).alias("until"))
        inside = F.sum("n").over(Window.partitionBy("queue", "cell").orderBy("far", "of", "at").rowsBetween(Window.unboundedPreceding, -1))
        far = far.withColumn("inside", F.coalesce(inside, F.lit(0))).join(cells, ["queue", "cell"])
        placed = far.select("queue", "of", "id", "n", "ids", (F.col("until") + F.col("inside")).alias("at"))
    else:
        placed = table.join(base, ["queue", "chunk"]).select("queue", F.lit(None).cast("string").alias("of"), "id", "n", "ids", at)
    sliced = placed.mapInArrow(slices, f"part long, queue string, of string, at long, id {kind}, start long, n long, ids binary")
    pieces = sliced.groupBy("part").applyInPandas(serve, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return pieces.withColumnRenamed("id", id_col)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed, a row for each piece."""
    with temporary(spark) as result:
        pieces = pack(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
        return result(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"), "packed")


QUERIES = {"op8_packing": op8_packing}
