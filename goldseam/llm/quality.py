"""Quality rules: a learned decision list of threshold conjunctions, in DataFrame expressions only."""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import WHITE, load
from goldseam.llm.native import let, words

#: Labelled documents that a list is learned from at most: those of least hash.
SAMPLE = 20_000
#: Thresholds tried for each statistic and class, conditions of a rule, rules of a list.
CUTS, CONDITIONS, RULES = 16, 3, 8
#: The share of its documents that a rule must be right on, in the growing and in the pruning part.
PRECISION = 0.95
#: Words of a window, and the symbols counted.
WINDOW, SYMBOLS = 8, "#*$%&|<>"

#: The statistics that rules may test, as expressions of the base columns.
STATISTICS = {
    "n_words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    cut: float

    def sql(self) -> str:
        return f"({STATISTICS[self.statistic]}) {'>=' if self.above else '<'} {self.cut!r}D"


def _repeat_words(w: Column) -> Column:
    """Words in windows that occur twice or more in the text.

    Hashes tell whether any window may repeat; only then are windows compared as text.
    """
    n = F.size(w)

    def exact(w: Column) -> Column:
        keys = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.struct(F.concat_ws(" ", *[w[i + k] for k in range(WINDOW)]).alias("k"), i.alias("i"))))

        def starts(s: Column) -> Column:
            m = F.size(s)
            same = lambda j: ((j > 0) & (s[j]["k"] == s[F.greatest(j - 1, F.lit(0))]["k"])) | ((j < m - 1) & (s[j]["k"] == s[F.least(j + 1, m - 1)]["k"]))
            return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), m - 1), same), lambda j: s[j]["i"]))

        def covered(d: Column) -> Column:
            return F.when(F.size(d) < 2, 0).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(d) - 2, F.lit(0))), F.lit(WINDOW), lambda acc, j: acc + F.least(F.lit(WINDOW), d[j + 1] - d[j])))

        return let(let(keys, starts), covered)

    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[w[i + k] for k in range(WINDOW)]))
    return F.when(n <= WINDOW, 0).otherwise(let(hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(exact(w)))).cast("long")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of every row; a null text counts as empty."""
    text = F.coalesce(F.col("__text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.trim(line, F.lit(WHITE)) != "")
    counts = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    out = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), *[F.col(c).alias(f"__{c}_kept") for c in keep])
    out = out.select(
        F.col("__id").alias(id_col),
        *[F.col(f"__{c}_kept").alias(c) for c in keep],
        counts.alias("__counts"),
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    n, r = F.col("__counts.n_words"), F.col("__counts.n_repeat_words")
    failed = (n < 20) | (100 * r > 30 * n)
    return out.select(id_col, *keep, n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", r.alias("n_repeat_words"), failed.alias("base_failed"))


def _grow(rows: list[tuple], cuts: dict[str, list[float]]) -> list[tuple[int, bool, int]]:
    """Conditions (statistic, above, bin) of a rule: each the one of largest information gain among what the former leave."""
    rule: list[tuple[int, bool, int]] = []
    names = list(cuts)
    while len(rule) < CONDITIONS:
        bad, good = sum(r[1] for r in rows), sum(r[2] for r in rows)
        if not bad or not good:
            break
        best, gain = None, 1e-9
        for f, name in enumerate(names):
            hist = [[0, 0] for _ in range(len(cuts[name]) + 1)]
            for r in rows:
                hist[r[0][f]][0] += r[1]
                hist[r[0][f]][1] += r[2]
            b = g = 0
            for k in range(1, len(hist)):
                b, g = b + hist[k - 1][0], g + hist[k - 1][1]
                for above, p, n in ((False, b, g), (True, bad - b, good - g)):
                    if p and (v := p * (log2(p / (p + n)) - log2(bad / (bad + good)))) > gain:
                        best, gain = (f, above, k), v
        if best is None:
            break
        rule.append(best)
        rows = [r for r in rows if _holds([best], r)]
    return rule


def _holds(rule: list[tuple[int, bool, int]], row: tuple) -> bool:
    return all((row[0][f] >= k) == above for f, above, k in rule)


def _right(rule: list, rows: list[tuple]) -> tuple[int, int]:
    hit = [r for r in rows if _holds(rule, r)]
    return sum(r[1] for r in hit), sum(r[2] for r in hit)


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", bad_value: int = 0) -> list[list[Condition]]:
    """An ordered list of rules that reject, by sequential covering, from labelled rows of statistics().

    Statistics are cut at the quantiles of either class; the labelled rows are counted by bins on
    the executors, and a table of at most SAMPLE rows of counts reaches the driver.
    A rule grows on two thirds of the documents, loses its last conditions while
    that doesn't lower its worth on the others, and is taken only if both parts
    find it right on PRECISION of what it covers; covered rows then leave.
    Null labels, labels of unknown documents and rows that fail the base are no
    evidence; without any, the list is empty.
    """
    part = (F.pmod(F.xxhash64(F.lit(5), id_col), F.lit(3)) == 0).alias("prune")
    named = stats.where(~F.col("base_failed")).join(labels, id_col).select(part, (F.col(label_col) == bad_value).alias("bad"), *[F.expr(e).cast("double").alias(k) for k, e in STATISTICS.items()])
    named = named.persist()
    try:
        at = ", ".join(str(i / (CUTS - 1)) for i in range(CUTS))
        quantiles = named.groupBy("bad").agg(*[F.expr(f"percentile_approx({k}, array({at}), 10000)").alias(k) for k in STATISTICS]).collect()
        cuts = {k: sorted({x for r in quantiles for x in r[k]}) for k in STATISTICS}
        bins = [sum((F.when(F.col(k) >= c, 1).otherwise(0) for c in v), F.lit(0)).alias(k) for k, v in cuts.items()]
        cube = named.select("prune", "bad", *bins).groupBy("prune", *STATISTICS).agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).collect()
    finally:
        named.unpersist()
    parts: dict[bool, list[tuple]] = {False: [], True: []}
    for r in sorted(cube, key=lambda r: tuple(r)):
        parts[r["prune"]].append((tuple(r[k] for k in STATISTICS), r["bad"], r["good"]))
    out: list[list[Condition]] = []
    while len(out) < RULES and (rule := _grow(parts[False], cuts)):

        def worth(rule: list) -> float:
            p, n = _right(rule, parts[True])
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        if any(p < PRECISION * (p + n) or not p for p, n in (_right(rule, parts[k]) for k in parts)):
            break
        names = list(cuts)
        out.append([Condition(names[f], above, cuts[names[f]][k - 1]) for f, above, k in rule])
        parts = {k: [r for r in v if not _holds(rule, r)] for k, v in parts.items()}
    return out


def verdict(rules: list[list[Condition]]) -> tuple[Column, Column]:
    """(kept, rule): the list as an ordered conditional expression; the number of the first rule that holds, else null."""
    first = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        first = F.when(F.expr(" and ".join(c.sql() for c in rule)), k).otherwise(first)
    first = F.when(F.col("base_failed"), 0).otherwise(first)
    return first.isNull(), first


def labelled_sample(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", bound: int = SAMPLE) -> DataFrame:
    """At most `bound` labels, those of least hash: one for each document, its lowest."""
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias(label_col))
    return one.orderBy(F.xxhash64(id_col), id_col).limit(bound)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """statistics() of every document with kept and rule, judged by the base rules and then by a list learned from the labels.

    rule is 0 for a document that fails the base, the number of the first learned
    rule that rejects it, or null for one that is kept.  Null and empty texts have
    no words and fail the base.  Null ids, repeated rows and extra columns are no
    special case, texts of any length are judged whole, an empty table gives an
    empty one.  One pass without a shuffle, besides a pass over at most SAMPLE
    labelled documents, whose ids are few enough to be broadcast.
    """
    sample = labelled_sample(labels, id_col)
    wanted = docs.select(id_col, text_col).join(F.broadcast(sample.select(id_col)), id_col, "left_semi")
    rules = learn(statistics(wanted, id_col, text_col), F.broadcast(sample), id_col)
    kept, rule = verdict(rules)
    return statistics(docs, id_col, text_col, keep).withColumn("kept", kept).withColumn("rule", rule)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """The statistics of every document, and whether it is kept."""
    return quality_rules(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


QUERIES = {"op1_quality": op1_quality}
