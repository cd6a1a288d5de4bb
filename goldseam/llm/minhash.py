"""Near-duplicates by b-bit MinHash: bands give candidates, bit counts estimate, full sets confirm."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import load, stored, temporary, texts
from goldseam.operators.components import connected_components

#: Bands and minima of a band.  A pair of similarity 0.8 shares none of 42 bands of 6 with a chance of 3 in a million.
BANDS, ROWS = 42, 6
#: Permutations of the packed signature, and low bits kept of each minimum.
PERMUTATIONS, BITS = 1536, 2
#: Standard deviations by which an estimate may fall short before a candidate is dropped.
SLACK = 4.0
#: Members of a bucket whose signatures are compared in one block, and members that one leader's task confirms.
BLOCK, MEMBERS = 2048, 2000
#: Pairs whose signatures lie side by side in memory at a time.
PAIRS = 16_384
#: Members and bytes of sets of a bucket that are compared exactly in one block.
EXACT, EXACT_BYTES = 1024, 8 << 20
#: Words that one worker's cache of hashes holds before it starts anew.
CACHE = 200_000


@lru_cache(2)
def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(count)
    return rng.integers(0, 1 << 32, count, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, count, np.uint32)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct n-word shingles; of all its words as one, if they are fewer."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, np.uint64(width))
    for k in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
    return np.unique(out)


def minima(s: np.ndarray, count: int) -> np.ndarray:
    """The minimum of each of so many permutations of a set's hashes."""
    a, b = _permutations(count)
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(count, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 64):
        v = x[at : at + 64, None] * a + b
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        np.minimum(out, v.min(axis=0), out=out)
    return out


def bands(m: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band's minima and number."""
    rows = m.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key


def pack(m: np.ndarray) -> np.ndarray:
    """The low BITS bits of the minima, one plane of PERMUTATIONS bits after the other, as 64-bit numbers."""
    return np.concatenate([np.packbits((m >> np.uint32(p) & np.uint32(1)).astype(np.uint8)) for p in range(BITS)]).view(np.uint64)


def least_matches(threshold: float) -> int:
    """Equal b-bit minima that a pair of that similarity has at least, but for SLACK standard deviations.

    Minima that differ agree in their low bits by chance, 1 time in 2^BITS, so the
    expected share of agreement is r + (1 - r) J; inverting it corrects for collisions.
    """
    r = 0.5**BITS
    c = r + (1 - r) * threshold
    return int(np.floor(PERMUTATIONS * c - SLACK * np.sqrt(PERMUTATIONS * c * (1 - c))))


def estimate(matches: np.ndarray | float) -> np.ndarray | float:
    """The collision-corrected similarity of pairs with so many equal b-bit minima."""
    r = 0.5**BITS
    return (matches / PERMUTATIONS - r) / (1 - r)


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w = PERMUTATIONS // 64
    x = a ^ b
    d = x[..., :w]
    for p in range(1, BITS):
        d = d | x[..., p * w : (p + 1) * w]
    return np.bitwise_count(d).sum(-1)


def signatures(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, digest, bands) of every row; digest is equal for equal sets, null for empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, keys = [], [], []
            for t in batch.column(1).to_pylist():
                s = shingle_set(t, n)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(bands(minima(s, BANDS * ROWS)).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "digest", "bands"])
        _words.clear()

    source = texts(docs, id_col, text_col)
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n long, digest binary, bands array<long>")


def _matches(a: str, b: str):
    """Equal b-bit minima of two sketch columns, by bit counts."""
    w = PERMUTATIONS // 64
    total = F.lit(PERMUTATIONS)
    for i in range(w):
        d = None
        for p in range(BITS):
            x = F.col(a)[p * w + i].bitwiseXOR(F.col(b)[p * w + i])
            d = x if d is None else d.bitwiseOR(x)
        total = total - F.bit_count(d)
    return total


def confirm(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) pairs whose full sets have at least that similarity.

    The set of a is sent once for every MEMBERS of its partners, and before them:
    a task reads its rows in order and holds one such set at a time.
    """
    percent = round(100 * threshold)
    load_of = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts"))
    heads = sets.join(load_of, sets["id"] == load_of["a"]).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "set")
    wide = pairs.join(load_of, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    tails = wide.join(sets.withColumnRenamed("id", "b"), "b").select("a", "part", "b", "set")
    rows = heads.unionByName(tails).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own = None, None
        for batch in batches:
            out = []
            for a, b, s in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "set")), strict=True):
                s = np.frombuffer(s, np.uint64)
                if b is None:
                    head, own = a, s
                    continue
                assert a == head
                if 100 * min(len(s), len(own)) < percent * max(len(s), len(own)):
                    continue
                both = np.concatenate([own, s])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(s) + len(own) - common):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _dealt(members: DataFrame, parts: Column, *carried: str) -> DataFrame:
    """Rows (key, i, j, own, *carried) such that every two members of a bucket meet in one pair of blocks (i, j), own being the row's block."""
    blocks = members.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).cast("int"))
    dealt = blocks.select("key", "own", *carried, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *carried)
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "own")


def _by_block(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple]]]:
    """(left, right, rows) of each pair of blocks: the places of either block's members in rows, which hold the columns."""
    held: list[tuple] = []

    def whole() -> tuple[np.ndarray, np.ndarray, list[tuple]]:
        own = np.array([r[3] for r in held])
        return np.flatnonzero(own == held[0][1]), np.flatnonzero(own == held[0][2]), [r[4:] for r in held]

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "own", *columns)), strict=True):
            if held and held[0][:3] != row[:3]:
                yield whole()
                held = []
            held.append(row)
    if held:
        yield whole()


def likeliest(members: DataFrame, least: int) -> DataFrame:
    """(key, a, b, m): for each member (key, id, size, component, sketch) of a bucket its likeliest partner of another component.

    Members without a partner whose b-bit minima agree in `least` places at least are
    left out.  A bucket of more than BLOCK members is cut into blocks by hash, and
    every pair of blocks is compared by a task of its own, in numpy: a row for each
    member of a block leaves it at most.
    """
    dealt = _dealt(members, F.ceil(F.col("size") / BLOCK).cast("int"), "id", "component", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right, rows in _by_block(batches, "id", "component", "sketch", "key"):
            ids, comps, sk = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.int64).view(np.uint64)
            out = []
            both_ways = ((left, right), (right, left)) if len(left) and len(right) and left[0] != right[0] else ((left, right),)
            for x_all, y in both_ways:
                for at in range(0, len(x_all), 128):
                    x = x_all[at : at + 128]
                    p, q = np.nonzero(comps[x][:, None] != comps[y])
                    # a few thousand pairs at a time: each pair's signatures are gathered side by side
                    each = [_differing(sk[x[p[lo : lo + PAIRS]]], sk[y[q[lo : lo + PAIRS]]]) for lo in range(0, len(p), PAIRS)]
                    m = PERMUTATIONS - np.concatenate([np.empty(0, np.uint64), *each]).astype(np.int64)
                    p, q, m = (v[m >= least] for v in (p, q, m))
                    order = np.lexsort((ids[y[q]], -m, p))
                    first = order[np.unique(p[order], return_index=True)[1]]
                    out.append(np.stack([ids[x[p[first]]], ids[y[q[first]]], m[first]], 1))
            found = np.concatenate(out) if out else np.empty((0, 3), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), rows[0][3])), *[pa.array(found[:, k].copy()) for k in range(3)]], ["key", "a", "b", "m"])

    return dealt.mapInArrow(run, "key long, a long, b long, m long")


def forests(members: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links between components that join all members (key, id, component, set) of a bucket that full sets link.

    Every two members of different components are compared exactly, block by block,
    unless links found in the block have joined them already: a block emits fewer
    rows than it has members, however many of their pairs are linked.
    """
    percent = round(100 * threshold)
    members = members.select("key", "id", "component", "set")
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum(F.octet_length("set")).alias("bytes"))
    parts = F.greatest(F.ceil(F.col("size") / EXACT), F.ceil(F.col("bytes") / EXACT_BYTES)).cast("int")
    dealt = _dealt(members.join(sizes, "key"), parts, "id", "component", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right, rows in _by_block(batches, "id", "component", "set"):
            out = []
            if len(left) and len(right):
                sets = [np.frombuffer(r[2], np.uint64) for r in rows]
                label = np.unique([r[1] for r in rows], return_inverse=True)[1]
                n = np.array([len(s) for s in sets])
                dense = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
                ends = np.cumsum(n)
                mark = np.zeros(int(dense.max()) + 1, np.int32)
                # rows are sorted by block, so the right block's sets lie side by side
                flat, starts = dense[ends[right[0]] - n[right[0]] : ends[right[-1]]], (ends - n)[right] - (ends[right[0]] - n[right[0]])
                for i in left.tolist():
                    near = 100 * np.minimum(n[i], n[right]) >= percent * np.maximum(n[i], n[right])
                    open_ = near & (label[right] != label[i]) & (right > i)
                    if not open_.any():
                        continue
                    mark[dense[ends[i] - n[i] : ends[i]]] = 1
                    common = np.add.reduceat(mark[flat], starts)
                    mark[dense[ends[i] - n[i] : ends[i]]] = 0
                    for j in right[open_ & (100 * common >= percent * (n[i] + n[right] - common))].tolist():
                        if label[i] != label[j]:
                            label[label == label[j]] = label[i]
                            out.append((rows[i][0], rows[j][0]))
            yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in out], pa.int64()), pa.array([max(x) for x in out], pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every document.

    Words are ended by ASCII white space, A-Z are lower-cased; a document's set is
    its distinct shingles, or all its words as one if they are too few.  Documents
    are linked if 100 * intersection >= 100 * threshold * union; component_id is
    the smallest id that links reach, kept says that it is the document's own.
    Null and empty texts have an empty set, no link and are kept.  Rows that repeat
    an id (and so its text) have a row each in one component.  Rows with a null
    id have a null component, no link and are kept.  Extra columns are ignored, and
    texts are taken whole.

    1. Every text is reduced to the keys of its bands of minima.
    2. Documents with equal sets are one class; only its smallest id goes on.
    3. Members of shared buckets get a longer signature of packed low bits.  In each
       bucket, every member is paired with the smallest.  What the bit counts don't
       rule out is confirmed on full sets and joined to components.
    4. In buckets that still hold several components, signatures are compared block
       by block.  First each member's likeliest partner of another component is
       confirmed, which joins what one leader left apart.  Then members that still
       have a likely partner are compared on full sets within the blocks, which
       emit only links that join components (see forests).
    Every pair of a bucket is thus in one component or was compared, so no link is
    lost that any band has seen, yet a bucket of like texts costs one comparison a
    member, and rows that leave a block never outnumber its members.  No step
    gathers links, buckets or components on the driver.  Intermediate tables are
    deleted once the result is stored.
    """
    with temporary(docs.sparkSession) as result:
        return result(_near_duplicates(docs, shingle_words, threshold, id_col, text_col), "near-duplicates")


def _near_duplicates(docs: DataFrame, shingle_words: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    sig = stored(signatures(docs, shingle_words, id_col, text_col), "signatures")
    known = sig.where("id is not null and n > 0")
    classes = stored(known.groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    reps = known.join(classes.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"])

    rows = reps.select("id", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stored(rows.join(shared, "key"), "members")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle_words) for t in batch.column(1).to_pylist()]
            sketches = [pack(minima(s, PERMUTATIONS)).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(sketches, pa.list_(pa.int64()))], ["id", "set", "sketch"])
        _words.clear()

    source = texts(docs, id_col, text_col).select(F.col("id").cast("long"), "text")
    likely = source.join(members.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    likely = stored(likely.mapInArrow(sets_of, "id long, set binary, sketch array<long>"), "sets")
    sketches, likely = likely.select("id", "sketch"), likely.select("id", "set")
    least = least_matches(threshold)
    pairs = members.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    left, right = sketches.toDF("a", "x"), sketches.toDF("b", "y")
    pairs = stored(pairs.join(left, "a").join(right, "b").where(_matches("x", "y") >= least).select("a", "b"), "pairs")
    links = stored(confirm(pairs, likely, threshold), "links")

    def still_open(found: DataFrame) -> DataFrame:
        """The members of buckets that hold several components, with their sketches."""
        now = members.join(found.toDF("id", "component"), "id", "left").select("key", "id", "size", F.coalesce("component", "id").alias("component"))
        open_keys = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
        open_keys = stored(open_keys, "open-keys")  # a table, so that Spark can split a hot key of the join
        return stored(now.join(open_keys, "key", "left_semi"), "open")

    found = connected_components(links)
    now = still_open(found)
    best = likeliest(now.join(sketches, "id"), least).groupBy("a").agg(F.max(F.struct("m", F.negative("b").alias("b"))).alias("top")).select("a", F.negative("top.b").alias("b"))
    best = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    more = stored(confirm(stored(best, "pairs"), likely, threshold), "links")
    if more.limit(1).count():
        links = links.unionByName(more)
        found = connected_components(links)
        now = still_open(found)
    doubtful = likeliest(now.join(sketches, "id"), least).select("key", F.col("a").alias("id")).distinct()
    last = stored(forests(now.join(doubtful, ["key", "id"], "left_semi").join(likely, "id"), threshold), "links")
    if last.limit(1).count():
        found = connected_components(links.unionByName(last))

    of_class = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = sig.select("id", "n", "digest").join(of_class, "digest", "left")
    own = F.coalesce(F.col("component_id"), F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), own).alias("component_id"), (F.col("id").isNull() | (own == F.col("id"))).alias("kept"))


def op10_minhash(spark, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document, by 2-word shingles."""
    return near_duplicates(load(spark, sf_dir, "documents"), shingle_words=2, threshold=0.8)


QUERIES = {"op10_minhash": op10_minhash}
