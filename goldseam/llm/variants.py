"""Spelling variants: words one edit apart, found by Aho-Corasick automata over the halves of all words."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import load, prepare, stored, temporary, texts

#: Runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8 bytes, A-Z lower-cased.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Code points and occurrences of a word at least, how many times as frequent a form is, and the share of runs that lose a code point.
LENGTH, OFTEN, TIMES, DAMAGED = 6, 5, 5, 199
#: Different words that a task counts before it sends on what it has.
HELD = 400_000
#: Words that share a segment before they are told by more of their code points, and entries of a shard.
GROUP, SHARD = 50_000, 200_000
#: Words of a node that are compared one by one.
LEAF = 12


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damaged: int = DAMAGED) -> DataFrame:
    """(word, n): the runs of all whole texts and how often each occurs.

    A run whose hash with its document's id is divisible by `damaged` has lost one
    code point, so that spellings to be found are in the text.  A null text has no
    runs, a null id counts as the empty string.  Tasks count before they send.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def sent() -> Iterator[pa.RecordBatch]:
            words = list(total)
            for lo in range(0, len(words), 1 << 16):
                some = words[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in some], pa.string()), pa.array([total[w] for w in some], pa.int64())], ["word", "n"])
            total.clear()

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                for w, n in Counter(RUN.findall(text.translate(LOWER))).items():
                    if (h := zlib.crc32(w, start)) % damaged == 0:
                        s = w.decode()
                        w = (s[: h % len(s)] + s[h % len(s) + 1 :]).encode()
                    total[w] += n
                if len(total) > HELD:
                    yield from sent()
        yield from sent()

    counted = texts(docs, id_col, text_col).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def apart_by_one(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes one of the other."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


class Node:
    """Words of one length that have all code points outside of [lo, hi) in common.

    A word that is one edit from one of them, and agrees with them outside, has one
    half of the part between untouched: so a node of many words is split by either
    half, each half once in front and once behind, until few words are left.
    """

    __slots__ = ("children", "hi", "lo", "words")

    def __init__(self, lo: int, hi: int):
        self.lo, self.hi, self.words, self.children = lo, hi, [], None

    def near(self, x: str, more: int) -> Iterator[tuple[str, int]]:
        """The (word, n) one edit from x, which has `more` code points more than the words: each once."""
        if len(self.words) <= LEAF or self.hi - self.lo < 2:
            yield from (w for w in self.words if apart_by_one(w[0], x))
            return
        mid = (self.lo + self.hi) // 2
        if self.children is None:
            self.children = {}, {}
            for w in self.words:
                for side, key, lo, hi in ((0, w[0][self.lo : mid], mid, self.hi), (1, w[0][mid : self.hi], self.lo, mid)):
                    self.children[side].setdefault(key, Node(lo, hi)).words.append(w)
        front = x[self.lo : mid]
        if (child := self.children[0].get(front)) is not None:
            yield from child.near(x, more)
        if (child := self.children[1].get(x[mid + more : self.hi + more])) is not None:
            yield from (w for w in child.near(x, more) if w[0][self.lo : mid] != front)  # else found in front


def first_way(word: str, x: str, lo: int, hi: int) -> bool:
    """Whether a pair meets first in the entry of `word` that leaves [lo, hi) open: no half in front was untouched where the way went behind."""
    a, z = 0, len(word)
    while (a, z) != (lo, hi):
        mid = (a + z) // 2
        if lo >= mid:
            a = mid
        elif word[a:mid] == x[a:mid]:
            return False
        else:
            z = mid
    return True


class Shard:
    """An automaton over the segments of entries (word, n, front, behind): the word's first `front` and last `behind` code points."""

    def __init__(self, entries: list[tuple[str, int, int, int]]):
        import ahocorasick

        segments: dict[str, dict[tuple, Node]] = {}
        for word, n, front, behind in entries:
            # the longer part is looked for, the other one is told by the node
            at_front = front >= behind
            cut = len(word) - behind
            segment, other = (word[:front], word[cut:]) if at_front else (word[cut:], word[:front])
            nodes = segments.setdefault(segment, {})
            nodes.setdefault((at_front, len(word), front, behind, other), Node(front, cut)).words.append((word, n))
        self.automaton = ahocorasick.Automaton()
        for segment, nodes in segments.items():
            self.automaton.add_word(segment, (len(segment), list(nodes.items())))
        if segments:
            self.automaton.make_automaton()

    def near(self, x: str) -> Iterator[tuple[str, int]]:
        """The (word, n) of the shard's entries that x meets first there, one edit from it."""
        size = len(x)
        for end, (length, nodes) in self.automaton.iter(x):
            for (at_front, n, front, behind, other), node in nodes:
                more = size - n
                if -1 <= more <= 1 and (end == length - 1 if at_front else end == size - 1):
                    if other and (x[size - behind :] if at_front else x[:front]) != other:
                        continue
                    yield from (w for w in node.near(x, more) if first_way(w[0], x, node.lo, node.hi))


def halves(words: DataFrame, length: int) -> DataFrame:
    """(word, n, more, front, behind): for each word the halves of itself (more = 0), and those that words one code point longer or shorter have if it holds them."""
    own = words.select("word", "n", F.explode(F.expr("array(-1, 0, 1)")).alias("more")).where(F.length("word") - F.col("more") >= length)
    size = F.length("word") - F.col("more")  # code points of the words that it may be near to
    front = F.floor(size / 2).cast("int")
    zero = F.lit(0)
    return own.select("word", "n", "more", F.explode(F.array(F.struct(front.alias("front"), zero.alias("behind")), F.struct(zero.alias("front"), (size - front).alias("behind")))).alias("e")).select("word", "n", "more", "e.front", "e.behind")


def keyed(entries: DataFrame) -> DataFrame:
    """With the hash of what an entry holds: words that may be near have one of them in common."""
    size = F.length("word") - F.col("more")
    return entries.withColumn("key", F.xxhash64(size, "front", "behind", F.expr("substring(word, 1, front)"), F.expr("right(word, behind)")))


def near_words(words: DataFrame, length: int = LENGTH, group: int = GROUP, shard: int = SHARD) -> DataFrame:
    """(word, n_near, best): of (word, n), the words near another one, how many it is near to, and best (less = -n, near) of the most frequent.

    Two words of at least `length` code points are near if one inserted, deleted or
    replaced code point makes one of the other; then one of the two halves of either
    stands untouched at the front or at the end of the other.  Shards hold the
    segments of all words in an automaton, by a hash of the segment.  Every word is
    scanned by the shards that may hold a segment of it, at most six whatever their
    number; a segment that is found counts if it stands at its offset and the
    lengths differ by at most one, and then the distance is verified.  A pair counts
    where it meets first.  What leaves a shard is a row for each word, not a pair.

    A segment that more than `group` words share is replaced by longer ones: one half
    of what it leaves open, in front or behind.  That ends at one open code point,
    which bounds a segment's words by the letters there are.
    """
    spark = words.sparkSession
    prepare(spark)
    entries = keyed(halves(words, length))
    while True:
        open_ = F.length("word") - F.col("more") - F.col("front") - F.col("behind")
        sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("more") == 0, 1)).alias("held"), F.max(open_).alias("open"))
        many = stored(sizes.where((F.col("held") > 0) & (F.col("open") > 1) & ((F.col("held") > group) | (F.col("all") > 8 * group))).select("key"), "shared-segments")
        if many.isEmpty():
            break
        step = F.floor(open_ / 2).cast("int")
        longer = F.array(F.struct((F.col("front") + step).alias("front"), F.col("behind")), F.struct(F.col("front"), (F.col("behind") + open_ - step).alias("behind")))
        refined = entries.join(many, "key", "left_semi").select("word", "n", "more", F.explode(longer).alias("e")).select("word", "n", "more", "e.front", "e.behind")
        rest = entries.join(many, "key", "left_anti")
        entries = stored(rest.unionByName(keyed(refined)), "segments")
    shards = max(1, -(-(sizes.agg(F.sum("all")).first()[0] or 0) // shard))
    columns = [F.pmod("key", F.lit(shards)).cast("int").alias("shard"), F.col("more") != 0, "word", "n", "front", "behind"]
    dealt = entries.select(*columns).toDF("shard", "scan", "word", "n", "front", "behind").repartition(shards, "shard").sortWithinPartitions("shard", "scan", "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, automaton, own, last = None, [], None, set(), None

        def scanned(word: str, out: list[tuple]) -> None:
            found = list(automaton.near(word))
            if found:
                n, near = min((-n, w) for w, n in found)
                out.append((word, len(found), n, near))

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "less", "near"])

        def begun() -> pa.RecordBatch:
            """The automaton of the shard that is complete; its own words are the first that it scans."""
            nonlocal automaton, own, held
            out: list[tuple] = []
            automaton, own, held = Shard(held), {e[0] for e in held}, []
            for word in sorted(own):
                scanned(word, out)
            return batch_of(out)

        for batch in batches:
            out: list[tuple] = []
            for shard_, scan, word, n, front, behind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard_ != at:
                    if held:
                        yield begun()
                    at, automaton, last = shard_, None, None
                if not scan:
                    held.append((word, n, front, behind))
                    continue
                if automaton is None:
                    if not held:
                        continue  # a shard without segments
                    yield begun()
                if word != last and word not in own:
                    scanned(word, out)
                last = word
            yield batch_of(out)
        if held:
            yield begun()

    found = dealt.mapInArrow(run, "word string, n_near long, less long, near string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "near")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the links (word, form) lead in the end, by doubling: each round halves the ways that are left."""
    links = forms.select("word", F.col("form").alias("root"))
    while True:
        links = stored(links, "links")
        onward = links.toDF("root", "further")
        if links.join(onward, "root", "left_semi").isEmpty():
            return links
        links = links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"))


def variants(words: DataFrame, length: int = LENGTH, often: int = OFTEN, times: int = TIMES, group: int = GROUP, shard: int = SHARD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the (word, n) with `length` code points and `often` occurrences at least.

    A word's form is the most frequent of the words near it (ties: the smallest in
    the order of code points), if that has at least `times` its occurrences, else
    null; its root is where the forms lead, itself without one.  A form is more
    frequent than its word, so the ways end.  No words give an empty result, null
    words and counts take no part, and rows that repeat a word are added up.
    """
    own = stored(words.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n")).where((F.length("word") >= length) & (F.col("n") >= often)), "words")
    near = near_words(own, length, group, shard)
    form_n = -F.col("best.less")
    chosen = form_n >= times * F.col("n")
    told = own.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, form_n).alias("form_n"))
    told = stored(told, "forms")
    ends = roots(told.where("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_variants(spark, sf_dir: str) -> DataFrame:
    """The words of all documents with their spellings' forms and roots."""
    with temporary(spark) as result:
        return result(variants(count_words(load(spark, sf_dir, "documents"))), "variants")


QUERIES = {"op11_variants": op11_variants}
