"""Scalar text expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def normalise_text(text: Column) -> Column:
    """Line ends become \\n, three or more of them two, white space around goes."""
    unix = F.regexp_replace(text, "\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(unix, "\n{3,}", "\n\n"), "^\\s+|\\s+$", "")


def slug(path: Column) -> Column:
    """A path without its last suffix, in lower case, all but a-z and 0-9 as single underscores."""
    bare = F.regexp_replace(F.regexp_replace(path, "\\\\", "/"), "\\.[^./]*$", "")
    return F.regexp_replace(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def chunk_id(slug: Column, index: Column) -> Column:
    """slug_ch_index, the index padded to three digits but never cut; a negative one raises."""
    number = F.when(index < 0, F.raise_error(F.lit("a chunk's index must not be negative"))).otherwise(index.cast("string"))
    return F.concat(slug, F.lit("_ch_"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit("([\\p{L}\\p{N}_]+)"), 1)


#: Characters of a text that NFKC leaves alone, whatever surrounds them: Latin letters without combining marks or compatibility forms, and most punctuation.
PLAIN = "\\u0000-\\u009F\\u00A1-\\u00A7\\u00A9\\u00AB-\\u00AE\\u00B0\\u00B1\\u00B6\\u00B7\\u00BB\\u00BF-\\u0131\\u0134-\\u013E\\u0141-\\u0148\\u014A-\\u017E\\u2010\\u2012-\\u2016\\u2018-\\u2023"


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """Compatibility forms folded (full-width letters, ligatures): only texts with a character beyond PLAIN leave the JVM.

    Matching against PLAIN takes about a microsecond a character, so only what is left of texts that aren't ASCII is matched.
    """
    beyond = F.regexp_replace(text, "[\\u0000-\\u007F]+", "").rlike(f"[^{PLAIN}]")
    return F.coalesce(_nfkc(F.when(F.octet_length(text) > F.char_length(text), F.when(beyond, text))), text)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, however often use refers to it."""
    return F.transform(F.array(value), use)[0]


def runs(values: Column) -> Column:
    """(term, tf) of a sorted array: its runs of equal values with their lengths; null for an empty one."""

    def counted(v: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: (i == 0) | (v[i] != F.get(v, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda i, k: F.struct(v[i].alias("term"), (F.coalesce(F.get(at, k + 1), F.size(v)) - i).cast("long").alias("tf"))))

    return F.when(F.size(values) > 0, let(values, counted))


def window_starts(count: Column, size: int, overlap: int) -> Column:
    """The starts of overlapping windows; the first that reaches the end is the last."""
    stride = size - overlap
    last = F.greatest(F.ceil((count - size) / stride), F.lit(0)).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * stride)).otherwise(F.array().cast("array<int>"))


def seeded(seed: int, *parts: Column) -> Column:
    """A portable pseudo-random sort key: the MD5 of the seed and the parts."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def judgement(reply: Column) -> Column:
    """True, false or null, as a line of the reply starts with YES, NO or neither."""
    word = F.upper(F.regexp_extract(reply, "(?im)^\\s*(yes|no)\\b", 1))
    return F.when(word == "YES", True).when(word == "NO", False)


def label_choice(reply: Column, count: int) -> Column:
    """The first number from 1 to 9 in a reply, if it is at most count and the reply doesn't say NONE."""
    trimmed = F.upper(F.trim(reply))
    digit = F.regexp_extract(reply, "\\b([1-9])\\b", 1)
    number = F.when(digit != "", digit.cast("int"))
    return F.when(~F.contains(F.substring(trimmed, 1, 12), F.lit("NONE")) & (number <= count), number)


def split_sentences(answer: Column) -> Column:
    """Sentences of an answer: cut after . ! ? before white space and a capital, digit or quote; some abbreviations don't end one."""
    safe = answer
    for short in ("e.g.", "i.e.", "etc."):
        safe = F.replace(safe, F.lit(short), F.lit(short.replace(".", "\u0001")))
    parts = F.split(safe, "(?<=[.!?])\\s+(?=[A-Z0-9`\"'(])")
    clean = F.transform(parts, lambda s: F.trim(F.regexp_replace(F.replace(s, F.lit("\u0001"), F.lit(".")), "\\s+", " ")))
    return F.filter(clean, lambda s: s != "")


def normalised_question(question: Column) -> Column:
    """A question without differences of case and with single spaces, for telling whether two are the same."""
    return F.lower(F.upper(F.regexp_replace(F.regexp_replace(question, "[\\s\\p{Z}]+", " "), "^ | $", "")))


def verdicts(reply: Column, sentences: Column) -> Column:
    """struct(error, verdicts array<struct(n, sentence, supported, reason)>) of a judge's reply about the sentences.

    The JSON object from the first { to the last } counts, whatever surrounds it.
    Without one, without a list of verdicts, or with another number of them than
    there are sentences, error says so and verdicts is null: none is guessed.
    """
    body = F.regexp_extract(reply, "(?s)\\{.*\\}", 0)
    parsed = F.from_json(body, "verdicts array<struct<supported:boolean,reason:string>>")
    rows = parsed["verdicts"]
    error = F.when(body == "", "no JSON object").when(F.get_json_object(body, "$").isNull(), "not valid JSON").when(rows.isNull(), "no list of verdicts").when(F.size(rows) != F.size(sentences), "another number of verdicts than sentences")
    read = F.transform(sentences, lambda s, i: F.struct((i + 1).alias("n"), s.alias("sentence"), F.coalesce(F.get(rows, i)["supported"], F.lit(False)).alias("supported"), F.trim(F.coalesce(F.get(rows, i)["reason"], F.lit(""))).alias("reason")))
    return F.struct(error.alias("error"), F.when(error.isNull(), read).alias("verdicts"))


def format_context(passages: Column) -> Column:
    """Passages numbered from 1, a blank line between them."""
    return F.array_join(F.transform(passages, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), t)), "\n\n")
