"""Suffix-array removal of long repeated byte strings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import load, prepare, stored, temporary

#: Bytes of a string that counts as repeated, and of the strings that choose anchors.
LENGTH, LEAD = 400, 16
#: Suffixes that a bucket holds on average, and that are sorted together.
BUCKET, SORTED = 20_000, 16_384
#: Suffixes that may share a lead and be sorted together; beyond, the lead is split by the bytes around it.
PART = 2_048
#: Bytes of a text that anchors are chosen in at once, and rows that leave a worker at once.
SEGMENT, ROWS = 1 << 20, 8_192

_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def anchors(text: bytes, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, stretches) of suffixes that stand for all others, a segment of the text after the other.

    Of every `length`-byte window, the leftmost LEAD-byte string of least hash is
    chosen.  The choice depends on the window alone, so equal windows have their
    anchor at the same place in them: to find all windows that occur twice it is
    enough to compare suffixes at anchors, forwards and backwards.  Places inside
    a periodic stretch are left out, but for one at either end (see periodic).
    """
    last = -1
    w = length - LEAD + 1
    mask = np.uint64((1 << 24) - 1)
    for at in range(0, len(text) - length + 1, SEGMENT):
        x = np.frombuffer(text, np.uint8, min(SEGMENT + length - 1, len(text) - at), at)
        g, size = x.astype(np.uint64) + np.uint64(1), 1
        while size < LEAD:
            g = g[:-size] * np.uint64(pow(int(_M), size, 1 << 64)) + g[size:]
            size *= 2
        g = _mix(_mix(g))
        key = (g & ~mask) | np.arange(len(g), dtype=np.uint64)
        padded = np.full(-(-len(key) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(key)] = key
        rows = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(x) - length + 1
        best = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & mask).astype(np.int64)
        best = best[np.flatnonzero(np.diff(best, prepend=-1))]
        best = best[best + at > last]
        if len(best):
            last = int(best[-1]) + at
        kept, stretches = periodic(x, best, length)
        yield kept + at, stretches + at


def periodic(x: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places that are needed, stretches as rows of start and stop) of a segment with these anchors.

    In a stretch of four lengths or more that repeats with period d, d at most a
    length, every window of `length` bytes occurs twice, so all of it goes.  Where
    anchors follow each other at distance d in it, their surroundings are equal:
    the first and the last whose surroundings lie in the stretch stand for those
    between them.  A text of one byte has a few anchors a segment, not one a byte.
    """
    none = np.empty((0, 2), np.int64)
    d = np.diff(places)
    edge = np.flatnonzero(np.diff(d, prepend=0, append=0))
    low, high = places[edge[:-1]], places[edge[1:]]  # of runs at one distance
    long = np.flatnonzero(high - low >= 4 * length)
    needed, out = np.ones(len(places), bool), []
    for r in long.tolist():
        a, b, step = int(low[r]), int(high[r]), int(d[edge[r]])
        breaks = np.flatnonzero(x[a : b - step] != x[a + step : b]) + a
        for u, v in zip([a, *(breaks + 1).tolist()], [*(breaks + step).tolist(), b], strict=True):
            if v - u >= 4 * length:
                out.append((u, v))
                inside = np.flatnonzero((places >= u + length) & (places <= v - length))
                needed[inside[1:-1]] = False
    return places[needed], np.array(out, np.int64) if out else none


def multikey_order(words: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """The order of rows by group and then by their words, most significant first.

    Three-way multikey quicksort, a token of eight bytes at a time, over all open
    partitions at once: rows whose partition has one member drop out, the others
    are split by their next token.
    """
    order = np.argsort(groups, kind="stable")
    gid = np.cumsum(np.diff(groups[order], prepend=groups[order[:1]]) != 0)
    for k in range(words.shape[1]):
        same = np.concatenate([[False], gid[1:] == gid[:-1], [False]])
        live = np.flatnonzero(same[1:] | same[:-1])
        if not len(live):
            break
        token = words[order[live], k]
        new = np.lexsort((token, gid[live]))
        order[live], token = order[live[new]], token[new]
        split = np.zeros(len(gid), np.int64)
        split[live[1:]] = (token[1:] != token[:-1]) & (live[1:] == live[:-1] + 1)
        gid = np.cumsum((np.diff(gid, prepend=gid[:1]) != 0) | (split > 0))
    return order


def repeated(group: np.ndarray, before: list[bytes], after: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) per suffix: how far before its place its nearest and its farthest repeated window start; most is -1 without one.

    before and after are the bytes on either side of each place, those of windows
    that the suffix answers for; suffixes of a group share their lead.  They are
    sorted within their groups, neighbours' common prefixes measured.  Windows that
    start b bytes before are equal where the suffixes agree in length - b bytes,
    thus lie in one run of the sorted order, and agree in b bytes backwards.
    """
    n, back = len(after), max(1, *map(len, before))
    wide = -(-length // 8) * 8
    fore = np.frombuffer(b"".join(a.ljust(wide, b"\0") for a in after), np.uint8).reshape(n, wide)
    rear = np.frombuffer(b"".join(x[::-1].ljust(back, b"\0") for x in before), np.uint8).reshape(n, back)
    la, lb = np.array([len(a) for a in after]), np.array([len(x) for x in before])
    order = multikey_order(fore.view(">u8"), group)
    fore, rear, la, lb, group = fore[order], rear[order], la[order], lb[order], group[order]
    same = fore[1:] == fore[:-1]
    lcp = np.where(same.all(axis=1), length, same.argmin(axis=1))
    lcp = np.minimum(np.minimum(lcp, length), np.minimum(la[1:], la[:-1]))
    lcp = np.where(group[1:] == group[:-1], lcp, 0)
    near = np.maximum(np.concatenate([[0], lcp]), np.concatenate([lcp, [0]]))
    least, most = np.full(n, length), np.full(n, -1)
    # of the suffixes whose neighbours share b bytes less than a length, those equal in b bytes backwards too
    backwards = np.zeros(n, np.int64)
    for b in range(back + 1):
        f = length - b
        if b:
            backwards = np.unique(backwards * 256 + rear[:, b - 1], return_inverse=True)[1]
        live = np.flatnonzero((la >= f) & (lb >= b) & (near >= f))
        if len(live) < 2:
            continue
        run = np.cumsum(np.concatenate([[0], lcp < f]))
        key = run[live] * n + backwards[live]
        o = np.argsort(key, kind="stable")
        k = key[o]
        eq = np.concatenate([[False], k[1:] == k[:-1], [False]])
        hit = live[o[eq[1:] | eq[:-1]]]
        least[hit] = np.minimum(least[hit], b)
        most[hit] = np.maximum(most[hit], b)
    back_to = np.empty(n, np.int64)
    back_to[order] = np.arange(n)
    return least[back_to], most[back_to]


def narrowed(place: int, before: bytes, after: bytes, reach: int, length: int = LENGTH) -> Iterator[tuple[int, bytes, bytes, bytes, int]]:
    """The two halves (place, before, after, lead, reach) of a suffix that answers for windows up to `reach` bytes before its place.

    Each answers for half of these windows, so all of its windows hold a lead that
    is longer by half the reach.  A half whose windows the text has no room for is
    left out; with reach 0, the lead is the only window, and equal in all that share it.
    """
    near = reach // 2
    for shift, left in ((0, near), (near + 1, reach - near - 1)):
        if shift <= len(before):
            ahead = (before[len(before) - shift :] + after)[:length]
            lead = ahead[: length - left]
            if len(lead) == length - left:
                behind = before[: len(before) - shift]
                yield place - shift, behind[max(0, len(behind) - left) :], ahead, lead, left


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def repeated_spans(keyed: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, spans array<struct<start, stop>>) of the texts (key, text binary) that hold a repeated string.

    A window that holds an anchor holds the half length from it on, or the half
    before it: so each anchor gives two suffixes whose leads, half a length each,
    must be shared.  Suffixes with equal surroundings are covered as far as windows
    reach, and one of them goes on for all; only those with a common lead but
    different surroundings are sorted and compared.
    """
    if length < 2 * LEAD:
        raise ValueError(f"length must be {2 * LEAD} at least")
    half = length // 2
    reach = length - half

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = xxhash.xxh3_64_intdigest
        names = ["lead", "around", "key", "place", "back", "ahead"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        rows: list[tuple] = []

        def full(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names)

        sign = lambda x: x - (1 << 64) if x >> 63 else x
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                k, t = k.as_py(), t.as_py()
                for p, stretches in anchors(t, length):
                    rows += [(None, None, k, a, 0, b - a) for a, b in stretches.tolist()]
                    q = np.union1d(p, p - half)
                    for q in q[(q >= 0) & (q + half <= len(t))].tolist():
                        lo, hi = max(0, q - reach), min(len(t), q + length)
                        rows.append((sign(h(t[q : q + half])), sign(h(t[lo:hi], q - lo)), k, q, q - lo, hi - q))
                        if len(rows) >= ROWS:
                            yield full(rows)
                            rows = []
        yield full(rows)

    found = stored(keyed.mapInArrow(find, "lead long, around long, key binary, place long, back long, ahead long"), "anchors")
    stretches = found.where("lead is null").select("key", F.col("place").alias("start"), (F.col("place") + F.col("ahead")).alias("stop"))
    # tasks combine counts before they shuffle, and Spark splits the semi joins' hot keys: no lead has to fit one task
    found = found.where("lead is not null")
    # (what is joined to is a table, as Spark splits a hot key only where both sides come straight from a shuffle)
    common = stored(found.groupBy("lead").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("lead"), "common")
    found = stored(found.join(common, "lead", "left_semi"), "shared")  # most leads are unique: little is left
    groups = found.groupBy("lead", "around").agg(F.count(F.lit(1)).alias("c"), F.first("key").alias("key"), F.first("place").alias("place"))
    groups = stored(groups, "surroundings")
    twins = found.where(F.col("back") + F.col("ahead") >= length).join(groups.where("c > 1").select("lead", "around"), ["lead", "around"], "left_semi")
    twins = twins.select("key", (F.col("place") - F.col("back")).alias("start"), (F.col("place") + F.col("ahead")).alias("stop")).unionByName(stretches)
    several = groups.groupBy("lead").agg(F.min("around").alias("low"), F.max("around").alias("high")).where("low <> high").select("lead")
    several = stored(several, "several")
    apart = groups.join(several, "lead", "left_semi").select("key", F.col("place").alias("start"), F.lit(None).cast("long").alias("stop"))
    # proven spans, and with a null stop the suffixes to compare
    picked = stored(twins.unionByName(apart), "picked")
    wanted = picked.where("stop is null").groupBy("key").agg(F.collect_set("start").alias("at"))

    names = ["key", "place", "before", "after", "lead", "reach"]
    kinds = [pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
    shape = "key binary, place long, before binary, after binary, lead binary, reach int"

    def suffixes_of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(rows), ROWS):
            cols = zip(*rows[i : i + ROWS], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names)

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t, at in zip(*(batch.column(c) for c in ("key", "text", "at")), strict=True):
                k, t, at = k.as_py(), t.as_py(), np.sort(at.values.to_numpy())
                for i in range(0, len(at), ROWS):
                    yield from suffixes_of([(k, q, t[max(0, q - reach) : q], t[q : q + length], t[q : q + half], reach) for q in at[i : i + ROWS].tolist()])

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("key", "place", "before", "after", "reach")), strict=True)
            yield from suffixes_of([(k, *x) for k, *row in rows for x in narrowed(*row, length)])

    # rows of equal id and text are one key, and one of them is enough
    one = keyed.join(wanted, "key").dropDuplicates(["key"])
    level = stored(one.mapInArrow(surroundings, shape), "suffixes")
    sure, ready = picked.where("stop is not null"), []
    while True:  # once, and again for every halving of the reach while a lead is too common
        sizes = level.groupBy("lead").agg(F.count(F.lit(1)).alias("c"))
        hot = stored(sizes.where(F.col("c") > PART).select("lead"), "hot-leads")
        if not hot.limit(1).count():
            ready.append(level)
            break
        ready.append(level.join(hot, "lead", "left_anti").select(*names))
        halves = level.join(hot, "lead", "left_semi").mapInArrow(narrow, shape)
        halves = halves.withColumn("behind", F.octet_length("before")).withColumn("around", F.md5(F.concat("before", "after")))
        halves = stored(halves, "halves")
        # two suffixes can be narrowed to one and the same, which is no repeat
        same = halves.groupBy("reach", "behind", "around").agg(F.min(F.struct(*names)).alias("one"), F.max(F.struct("key", "place")).alias("other"))
        same = stored(same, "surroundings")
        again = halves.join(same.where("one.key <> other.key or one.place <> other.place").select("reach", "behind", "around"), ["reach", "behind", "around"], "left_semi")
        ahead = F.octet_length("after")
        again = again.where(F.col("behind") + ahead >= length)
        sure = sure.unionByName(again.select("key", (F.col("place") - F.col("behind")).alias("start"), (F.col("place") + ahead).alias("stop")))
        halves = same.select("one.*")
        shared = halves.groupBy("lead").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("lead")
        level = stored(halves.join(shared, "lead", "left_semi").select(*names), "suffixes")
    suffixes = reduce(DataFrame.unionByName, ready)
    buckets = max(1, -(-suffixes.count() // BUCKET))
    # splitters are leads, so no two suffixes that share a window lie on either side of a boundary
    dealt = suffixes.repartitionByRange(buckets, "lead").sortWithinPartitions("lead")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            group = np.cumsum([0, *(a[4] != b[4] for a, b in zip(rows, rows[1:], strict=False))])
            least, most = repeated(group, [r[2] for r in rows], [r[3] for r in rows], length)
            hit = np.flatnonzero(most >= 0)
            places = np.array([r[1] for r in rows])
            keys = pa.array([rows[i][0] for i in hit.tolist()], pa.binary())
            return pa.RecordBatch.from_arrays([keys, pa.array(places[hit] - most[hit], pa.int64()), pa.array(places[hit] - least[hit] + length, pa.int64())], ["key", "start", "stop"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "place", "before", "after", "lead")), strict=True):
                if len(held) >= SORTED and held[-1][4] != row[4]:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    sure = sure.unionByName(dealt.mapInArrow(compare, "key binary, start long, stop long"))
    return sure.distinct().groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def _whole(t: bytes, a: int, b: int) -> bytes:
    """t[a:b] without the bytes at its ends of a character that reaches beyond them."""
    low, high = min(b, a + 3), max(a, b - 3)
    while 0 < a < low and t[a] & 0xC0 == 0x80:
        a += 1
    while high < b < len(t) and t[b] & 0xC0 == 0x80:
        b -= 1
    return t[a : max(a, b)]


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """(id_col, *keep, n_bytes, spans, kept) of every document: its UTF-8 bytes without repeated strings.

    A byte goes if a string of `length` bytes covers it that also starts anywhere
    else in the input, in the same document (overlaps count) or another; strings
    are those of whole documents before any removal.  spans are the maximal removed
    runs, kept the remaining bytes; with `whole`, without the bytes of characters
    that an edge of a span splits.  Null and empty texts, and texts of fewer than
    `length` bytes, lose nothing; repeated rows lose everything if they are long
    enough, null ids are no special case, extra columns are ignored, an empty table
    gives an empty one.

    Anchored suffixes (see anchors and repeated_spans) with a common lead are dealt
    to buckets by sampled splitters of their leading bytes, sorted there by multikey
    quicksort and compared with their neighbours.  A lead of more than PART suffixes
    is split by the bytes around it, again and again (see narrowed), until few
    share a lead or the lead is a whole window, which needs no comparison: neither
    a task's rows nor its memory grow with a common passage.  Boundaries lie
    between leads, so nothing is left to compare across them.  Intermediate
    tables are deleted once the spans are stored.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"), *keep)
    # a row is known by a 128-bit digest of its id and text: rows equal in both have equal spans
    named = F.concat(F.coalesce(F.col("id").cast("string").cast("binary"), F.lit(b"")), F.lit(b"\0"), F.col("text"))
    source = source.withColumn("key", F.unhex(F.md5(named)))
    with temporary(docs.sparkSession) as result:
        spans = result(repeated_spans(source.select("key", "text"), length), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged, left = [], []
            for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                m = _merged([(x["start"], x["stop"]) for x in s or ()])
                merged.append([{"start": a, "stop": b} for a, b in m])
                edges = [0, *(x for span in m for x in span), len(t)]
                left.append(b"".join(_whole(t, a, b) if whole else t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            cols = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in ("text", "spans")}
            cols["n_bytes"] = pa.array([len(t) for t in batch.column("text").to_pylist()], pa.int64())
            cols["spans"] = pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            cols["kept"] = pa.array(left, pa.binary())
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    joined = source.join(spans, "key", "left").select("id", *keep, "text", "spans")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields if f.name not in ("text", "spans"))
    return joined.mapInArrow(cut, f"{fields}, n_bytes long, spans array<struct<start long, stop long>>, kept binary").withColumnRenamed("id", id_col)


def op2_suffixes(spark, sf_dir: str) -> DataFrame:
    """What every document loses to repeated strings."""
    with temporary(spark) as result:
        out = remove_repeats(load(spark, sf_dir, "documents"))
        return result(out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")), "removed")


QUERIES = {"op2_suffixes": op2_suffixes}
