"""Language-model scores: the likelihood of a text over all its segmentations into subwords."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log, log10

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import load, stored, temporary, texts

#: Bytes of text and different words that share one dictionary.
BLOCK_BYTES, BLOCK_WORDS = 48 << 20, 600_000
#: Bytes of a word that are looked at together.
CUT = 1 << 16
#: What starts a word in the vocabulary, and the name of the piece that ends a text.
SPACE, END = "▁".encode(), b"</s>"


@lru_cache(1)
def processor(model_file: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_file)


@lru_cache(1)
def pieces(model_file: str) -> dict[bytes, int]:
    """The vocabulary as bytes; byte pieces stand for their byte, control pieces are left out but for the end."""
    sp = processor(model_file)
    out = {END: sp.eos_id()}
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i):
            out.setdefault(bytes([int(sp.id_to_piece(i)[3:5], 16)]), i)
        elif not sp.is_control(i) and not sp.is_unknown(i):
            out[sp.id_to_piece(i).encode()] = i
    return out


def reaches(weights: dict[bytes, float]) -> dict[bytes, int]:
    """The length of the longest piece with each first two bytes."""
    out: dict[bytes, int] = {}
    for p in weights:
        out[p[:2]] = max(out.get(p[:2], 1), len(p))
    return out


def chances(weights: dict[bytes, float]) -> tuple[dict[bytes, float], int]:
    """The pieces' probabilities, and the bytes of which no product of them can underflow."""
    least = min(weights.values(), default=-1.0)
    return {p: exp(w) for p, w in weights.items()}, int(-650 / min(least, -1.0))


def likelihood(word: bytes, weights: dict[bytes, float], reach: dict[bytes, int], plain: tuple[dict[bytes, float], int] | None = None) -> float:
    """The log probability of a word: forward recursion over all ways to cut it into pieces.

    With `plain`, the chances() of the weights, words that are short enough sum up
    probabilities as they are; longer ones are taken in log space.
    """
    if plain is None or len(SPACE) + len(word) > plain[1]:
        return _ringed(word, weights, reach)
    get, long = plain[0].get, reach.get
    s = SPACE + word
    n = len(s)
    paths = [0.0] * (n + 1)
    paths[0] = 1.0
    for i in range(n):
        if forward := paths[i]:
            for j in range(i + 1, min(n, i + long(s[i : i + 2], 1)) + 1):
                if p := get(s[i:j]):
                    paths[j] += forward * p
    return log(paths[n]) if paths[n] else -np.inf


def _ringed(word: bytes, weights: dict[bytes, float], reach: dict[bytes, int]) -> float:
    """The log probability of a word: in log space.

    Scores are pushed forward into a ring as long as the longest piece, so that
    memory doesn't grow with the word.
    """
    n = len(SPACE) + len(word)
    ring = min(n, max(reach.values(), default=1)) + 1
    paths: list[list[float]] = [[0.0], *([] for _ in range(ring - 1))]
    get = weights.get
    for at in range(0, n + 1, CUT):
        # the bytes from `at` on that this round and its pieces need
        s = (SPACE + word[: at + CUT + ring])[at:] if at < len(SPACE) else word[at - len(SPACE) : at - len(SPACE) + CUT + ring]
        for i in range(at, min(n + 1, at + CUT)):
            terms = paths[i % ring]
            if not terms:
                continue
            forward = terms[0]
            if len(terms) > 1:
                top = max(terms)
                forward = top + log(sum([exp(t - top) for t in terms]))
            if i == n:
                return forward
            paths[i % ring] = []
            k = i - at
            for j in range(k + 1, min(n - at, k + reach.get(s[k : k + 2], 1)) + 1):
                if (w := get(s[k:j])) is not None:
                    paths[(at + j) % ring].append(forward + w)
    return -np.inf


def held_out(doc_id, folds: int, fold: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def score(docs: DataFrame, model_file: str, folds: int = 5, fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    A-Z are lower-cased; tokens are the words that ASCII white space ends, then one
    end.  Documents with crc32(id as text) mod folds = fold are held out, the others
    teach: word counts for the base, and weights for the pieces of the existing
    vocabulary, from their counts in its own segmentation of the words (half a
    count more for each).  score is the log10 marginal probability of a text: the
    product, over its words and the end, of the sum over all segmentations.  No
    piece crosses a word boundary, so each different word is scored once.

    Null and empty texts are just an end; a null id counts as an empty one and is
    never held out; repeated rows are scored, and teach, a row each; extra columns
    are ignored; texts are taken whole; an empty table gives an empty one, and
    without training documents every count is 0.

    A task codes its texts with a dictionary for each block of them.  Only the
    dictionaries are shuffled: to sum each word's counts, and to bring its scores
    back to the blocks.  The vocabulary of words is a table, never broadcast and
    never on the driver; what is broadcast is a weight for each piece of the file.
    """
    source = texts(docs, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        names = ["block", "id", "held", "n", "idx", "cnt", "word", "c"]
        known: dict[bytes, int] = {}
        taught: Counter = Counter()
        size = 0

        def rows_of(cols: dict, n: int, id_type: pa.DataType) -> pa.RecordBatch:
            kinds = [pa.int64(), id_type, pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(cols.get(c, [None] * n), k) if not isinstance(cols.get(c), pa.Array) else cols[c] for c, k in zip(names, kinds, strict=True)], names)

        def words_of(id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            all_words = list(known)
            for at in range(0, len(all_words), 10_000):
                part = all_words[at : at + 10_000]
                numbers = pa.array(range(at, at + len(part)), pa.int64())
                yield rows_of({"block": [block] * len(part), "n": numbers, "word": part, "c": [taught[w] for w in part]}, len(part), id_type)

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            cols: dict = {c: [] for c in ("block", "held", "n", "idx", "cnt")}
            for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = Counter(t.lower().split())
                held = held_out(i, folds, fold)
                if not held:
                    taught.update(counts)
                idx = np.fromiter((known.setdefault(w, len(known)) for w in counts), np.uint32, len(counts))
                cnt = np.fromiter(counts.values(), np.uint32, len(counts))
                for c, v in zip(cols, (block, held, int(cnt.sum()) + 1, idx.tobytes(), cnt.tobytes()), strict=True):
                    cols[c].append(v)
                size += len(t)
            yield rows_of(cols | {"id": batch.column(0)}, len(batch), id_type)
            if size >= BLOCK_BYTES or len(known) >= BLOCK_WORDS:
                yield from words_of(id_type)
                known, taught, size, block = {}, Counter(), 0, block + 1
        yield from words_of(id_type)

    table = stored(source.mapInArrow(code, f"block long, id {kind}, held boolean, n long, idx binary, cnt binary, word binary, c long"), "blocks")
    coded, words = table.where("word is null"), table.where("word is not null")
    counts = stored(words.groupBy("word").agg(F.sum("c").alias("c")), "vocabulary")
    taught = counts.where("c > 0").agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).first()
    ends = coded.where("not held").count()
    n_train, v_train = (taught["n"] or 0) + ends, taught["v"] + (ends > 0)

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model_file)
        for batch in batches:
            total: Counter = Counter()
            listed = batch.column(0).to_pylist()
            cut = sp.encode([w.decode("utf-8", "replace") for w in listed], num_threads=1)
            for ids, c in zip(cut, batch.column(1).to_pylist(), strict=True):
                for i in ids:
                    total[i] += c
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["piece", "c"])

    seen = counts.where("c > 0").mapInArrow(segment, "piece int, c long").groupBy("piece").agg(F.sum("c").alias("c")).collect()  # a row for each piece of the file at most
    by_id = {r["piece"]: r["c"] for r in seen}
    vocabulary = pieces(model_file)
    by_id[vocabulary[END]] = ends
    mass = sum(by_id.get(i, 0) for i in vocabulary.values()) + 0.5 * len(vocabulary)
    weights = {p: log((by_id.get(i, 0) + 0.5) / mass) for p, i in vocabulary.items()}
    end_score = weights[END] / log(10)
    shared = docs.sparkSession.sparkContext.broadcast({p: w for p, w in weights.items() if p != END})

    base = lambda c: log10((c + 0.5) / (n_train + 0.5 * (v_train + 1)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        reach, plain = reaches(w), chances(w)
        for batch in batches:
            listed, c = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = [likelihood(x, w, reach, plain) / log(10) for x in listed]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x > 0 for x in c]), pa.array([base(x) for x in c]), pa.array(out, pa.float64())], ["word", "known", "base", "lattice"])

    scored = stored(counts.mapInArrow(judge, "word binary, known boolean, base double, lattice double"), "scores")
    back = words.select(F.col("block").alias("of"), F.col("n").alias("i"), "word").join(scored, "word").select("of", "i", "known", "base", "lattice")

    def apply(docs: pd.DataFrame, dictionary: pd.DataFrame) -> pd.DataFrame:
        size = len(dictionary)
        known, lm, lat = np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
        i = dictionary["i"].to_numpy()
        known[i], lm[i], lat[i] = dictionary["known"], dictionary["base"], dictionary["lattice"]
        out = []
        for idx, cnt in zip(docs["idx"], docs["cnt"], strict=True):
            k, c = np.frombuffer(idx, np.uint32), np.frombuffer(cnt, np.uint32).astype(np.int64)
            out.append((int((known[k] * c).sum()) + int(ends > 0), float((lm[k] * c).sum()) + base(ends), float((lat[k] * c).sum()) + end_score))
        frame = pd.DataFrame({"id": docs["id"], "held_out": docs["held"], "n_tokens": docs["n"]}).reset_index(drop=True)
        frame[["n_known", "base_score", "score"]] = pd.DataFrame(out, columns=["n_known", "base_score", "score"])
        return frame

    wanted = coded.select("block", F.col("id").cast("string"), "held", "n", "idx", "cnt")
    result = wanted.groupBy("block").cogroup(back.groupBy("of")).applyInPandas(apply, "id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return result.select(F.col("id").cast(kind).alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")


def op6_lattice(spark, sf_dir: str) -> DataFrame:
    """The scores of every document under the 32,000-piece vocabulary."""
    with temporary(spark) as result:
        return result(score(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")), "lattice")


QUERIES = {"op6_lattice": op6_lattice}
