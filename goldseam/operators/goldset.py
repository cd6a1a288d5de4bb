"""Question screening, adjudication, sampling and splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldseam.config import EngineError, LeakageError
from goldseam.functions import text as T
from goldseam.operators.components import connected_components
from goldseam.store import stored

#: Least length of a chunk, shares of code and of scaffolding above which it is left out.
LEAST_CHARS, CODE_SHARE, SCAFFOLD_SHARE = 200, 0.5, 0.5
#: Fixed value: a common run of more words than this gives the answer away.
LONGEST_RUN = 4


def _stripped(line: Column) -> Column:
    return F.regexp_replace(line, "^\\s+|\\s+$", "")


def _lines(text: Column) -> Column:
    """The lines of a text with their ends."""
    return F.filter(F.split(text, "(?<=\n)"), lambda s: s != "")


def _is_fence(line: Column) -> Column:
    return line.rlike("^\\s*(```|~~~)")


def symbol_dense(line: Column) -> Column:
    """A line of at least 8 characters of which less than three quarters are letters or white space."""
    return (F.length(line) >= 8) & (F.length(F.regexp_replace(line, "[^\\p{L}\\p{Z}\\s]", "")) / F.length(line) < 0.75)


def opens_inside_fence(text: Column) -> Column:
    """Whether a text's first fence line has no language: such a line closes a block that began earlier."""
    first = F.try_element_at(F.filter(_lines(text), _is_fence), F.lit(1))
    return F.coalesce(_stripped(first).isin("```", "~~~"), F.lit(False))


def non_prose_fraction(text: Column) -> Column:
    """The share of a text's characters on fence lines, between fences, on lines with an include directive or on symbol-dense lines; 1 if empty.

    A fold over the lines carries the fence's state, which opens_inside_fence starts.
    """

    def step(acc: Column, line: Column) -> Column:
        bad = _is_fence(line) | acc["inside"] | line.rlike("\\{\\*.*?\\*\\}") | symbol_dense(_stripped(line))
        return F.struct((_is_fence(line) != acc["inside"]).alias("inside"), (acc["n"] + F.when(bad, F.length(line)).otherwise(0)).alias("n"))

    state = F.aggregate(_lines(text), F.struct(opens_inside_fence(text).alias("inside"), F.lit(0).alias("n")), step)
    return F.when(F.length(text) == 0, 1.0).otherwise(state["n"] / F.length(text))


def scaffolding_fraction(text: Column) -> Column:
    """The share of a text's characters in a leading --- block, in leading `key: value` lines or in import statements; 1 if empty.

    The block ends with the next --- line; key lines count until the first other
    line that isn't blank, and not after a block; imports count anywhere.
    """
    numbered = F.transform(_lines(text), lambda line, i: F.struct(line.alias("line"), _stripped(line).alias("bare"), i.alias("i")))

    def step(acc: Column, x: Column) -> Column:
        rule = x["bare"] == "---"
        opens, held = (x["i"] == 0) & rule, acc["block"]
        own = x["line"].rlike("^\\s*import\\s+\\w+\\s+from\\s+['\"]") | (acc["leading"] & x["bare"].rlike("^[a-zA-Z][\\p{L}\\p{N}_-]*:\\s"))
        leading = F.when(opens, acc["leading"]).when(held, acc["leading"] & ~rule).otherwise(acc["leading"] & (own | (x["bare"] == "")))
        counted = acc["n"] + F.when(opens | held | own, F.length(x["line"])).otherwise(0)
        return F.struct((opens | (held & ~rule)).alias("block"), leading.alias("leading"), counted.alias("n"))

    state = F.aggregate(numbered, F.struct(F.lit(False).alias("block"), F.lit(True).alias("leading"), F.lit(0).alias("n")), step)
    return F.when(F.length(text) == 0, 1.0).otherwise(state["n"] / F.length(text))


def _edge_line(text: Column, place: int) -> Column:
    return _stripped(F.try_element_at(F.filter(_lines(text), lambda s: _stripped(s) != ""), F.lit(place)))


def opens_inside_code(text: Column) -> Column:
    """Whether a text starts within a code block or with a symbol-dense line."""
    return opens_inside_fence(text) | F.coalesce(symbol_dense(_edge_line(text, 1)), F.lit(False))


def closes_inside_code(text: Column) -> Column:
    """Whether a text ends within a code block, by the parity of its fences, or with a symbol-dense line."""
    odd = F.size(F.filter(_lines(text), _is_fence)) % 2 == 1
    return (opens_inside_fence(text) != odd) | F.coalesce(symbol_dense(_edge_line(text, -1)), F.lit(False))


def eligibility(text: Column) -> Column:
    """The first reason that makes a chunk unfit for a question, or eligible."""
    edges = opens_inside_code(text) | closes_inside_code(text)
    return F.when(F.length(text) < LEAST_CHARS, "too_short").when(non_prose_fraction(text) > CODE_SHARE, "too_much_code").when(scaffolding_fraction(text) > SCAFFOLD_SHARE, "scaffolding").when(edges, "code_edges").otherwise("eligible")


def starts_at_heading(text: Column, index: Column) -> Column:
    """Whether a chunk opens a section: a document's first, or one whose first line with text is a heading."""
    first = F.try_element_at(F.filter(_lines(text), lambda s: _stripped(s) != ""), F.lit(1))
    return (index == 0) | F.coalesce(first.rlike("^#{1,6}\\s"), F.lit(False))


def overlaps(pairs: DataFrame) -> DataFrame:
    """(qid, length, phrase) of (qid, question, passage): the longest run of words that both share, the first of the question's if there are several.

    Equal words meet by a join; runs are islands on the diagonals of their positions.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)
    q = pairs.select("qid", F.posexplode(words("question")).alias("qi", "w"))
    p = pairs.select("qid", F.posexplode(words("passage")).alias("pi", "w"))
    met = q.join(p, ["qid", "w"]).select("qid", "qi", (F.col("pi") - F.col("qi")).alias("d"))
    order = Window.partitionBy("qid", "d").orderBy("qi")
    runs = met.withColumn("island", F.col("qi") - F.row_number().over(order)).groupBy("qid", "d", "island").agg(F.count(F.lit(1)).alias("n"), F.min("qi").alias("at"))
    best = runs.groupBy("qid").agg(F.max(F.struct("n", (-F.col("at")).alias("before"))).alias("best"))
    phrase = F.array_join(F.slice(words("question"), (1 - F.col("best.before")).cast("int"), F.col("best.n").cast("int")), " ")
    return pairs.select("qid", "question").join(best, "qid", "left").select("qid", F.coalesce("best.n", F.lit(0)).alias("length"), F.coalesce(phrase, F.lit("")).alias("phrase"))


def longest_overlap(pairs: DataFrame) -> DataFrame:
    """(qid, length): overlaps() without the words."""
    return overlaps(pairs).select("qid", "length")


def rule_verdict(fired: dict[str, Column], drops: tuple[str, ...], fixes: tuple[str, ...]) -> tuple[Column, Column]:
    """(verdict, rule): unscored if any rule is null, else drop before fix before keep, in the rules' order."""
    unscored = F.lit(False)
    for c in fired.values():
        unscored = unscored | c.isNull()
    verdict, rule = F.when(unscored, "unscored"), F.when(unscored, F.lit(None).cast("string"))
    for names, said in ((drops, "drop"), (fixes, "fix")):
        for name in names:
            verdict, rule = verdict.when(fired[name], said), rule.when(fired[name], name)
    return verdict.otherwise("keep"), rule.otherwise(F.lit(None).cast("string"))


def adjudicate(rows: DataFrame, audit: DataFrame, second: DataFrame, exclusions: DataFrame) -> DataFrame:
    """(qid, verdict, source): hand exclusion before audit before agreement of both screeners; a dispute is unsettled.

    Without any second screening, the first alone decides.
    """
    alone = not second.limit(1).count()
    joined = rows.join(exclusions.select("qid", F.lit(True).alias("excluded")), "qid", "left").join(audit.select("qid", F.col("verdict").alias("human")), "qid", "left").join(second.select("qid", F.col("verdict").alias("other")), "qid", "left")
    source = F.when(F.col("excluded"), "hand-excluded").when(F.col("human").isNotNull(), "audit").when(F.lit(alone), "screener-only").when(F.col("other").isNull(), "unvalidated").when(F.col("other") == F.col("verdict"), "both-agree").otherwise("unaudited-dispute")
    verdict = F.when(F.col("excluded"), "drop").when(F.col("human").isNotNull(), F.col("human")).otherwise(F.col("verdict"))
    return joined.select("qid", verdict.alias("verdict"), source.alias("source"))


def apply_multilabel(gold: DataFrame, also: DataFrame) -> DataFrame:
    """Gold ids with those of the hand map appended that aren't there yet."""
    more = F.array_except(F.coalesce("also", F.array().cast("array<long>")), "gold")
    return gold.join(also, "qid", "left").select("qid", F.concat("gold", more).alias("gold"), (F.size(more) > 0).alias("added"))


def allocate(total: int, sizes: dict[str, int]) -> dict[str, int]:
    """An even quota for each class: the smallest first, the share rounded up, at most what the class has."""
    out: dict[str, int] = {}
    left = total
    names = sorted(sizes, key=lambda k: (sizes[k], k))
    for i, name in enumerate(names):
        out[name] = min(sizes[name], -(-left // (len(names) - i)))
        left -= out[name]
    return out


def quotas(rows: DataFrame, stratum: str, total: int) -> DataFrame:
    """(stratum, quota): allocate() as a fold over the classes' sizes, a row for each class."""
    sizes = rows.where(F.col(stratum).isNotNull()).groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    listed = sizes.agg(F.sort_array(F.collect_list(F.struct("n", F.col(stratum).alias("k")))).alias("s"))
    kind = dict(rows.dtypes)[stratum]

    def step(acc, x):
        share = F.least(x["n"], F.ceil(acc["left"] / acc["classes"]))
        return F.struct((acc["left"] - share).alias("left"), (acc["classes"] - 1).alias("classes"), F.array_append(acc["out"], F.struct(x["k"].alias("k"), share.alias("quota"))).alias("out"))

    start = F.struct(F.lit(total).cast("long").alias("left"), F.size("s").cast("long").alias("classes"), F.array().cast(f"array<struct<k:{kind},quota:bigint>>").alias("out"))
    return listed.select(F.explode(F.aggregate("s", start, step)["out"]).alias("x")).select(F.col("x.k").alias(stratum), F.col("x.quota").alias("quota"))


def stratified_sample(rows: DataFrame, key: str, stratum: str, total: int, seed: int) -> DataFrame:
    """A seeded sample with allocate()'s quota of each class."""
    order = Window.partitionBy(stratum).orderBy(T.seeded(seed, F.col(key)))
    placed = rows.withColumn("place", F.row_number().over(order))
    return placed.join(F.broadcast(quotas(rows, stratum, total)), stratum).where(F.col("place") <= F.col("quota")).drop("quota").select(*rows.columns, "place")


def sample_chunks(chunks: DataFrame, n: int, seed: int) -> DataFrame:
    """n chunks, those that start a section first, in seeded order."""
    return chunks.orderBy(~F.col("starts"), T.seeded(seed, F.col("chunk_id"))).limit(n)


def neighbourhood(chunks: DataFrame) -> DataFrame:
    """Each chunk with the ids of those one position before and after it; a gap isn't bridged."""
    order = Window.partitionBy("source_doc").orderBy("chunk_index")
    near = lambda f, d: F.when(f("chunk_index").over(order) == F.col("chunk_index") + d, f("chunk_id").over(order))
    return chunks.select("chunk_id", near(F.lag, -1).alias("previous_id"), near(F.lead, 1).alias("next_id"))


def multilabel_candidates(gold: DataFrame, sentences: DataFrame) -> DataFrame:
    """(qid, chunk_id, gold_id, sentence): other chunks that share a sentence with a gold chunk, one row each."""
    # one row for a question's sentence, however many of its gold chunks hold it
    held = gold.join(sentences.withColumnRenamed("chunk_id", "gold_id"), "gold_id").groupBy("qid", "sentence").agg(F.min("gold_id").alias("gold_id"))
    other = held.join(sentences, "sentence").join(gold.withColumnRenamed("gold_id", "chunk_id"), ["qid", "chunk_id"], "left_anti")
    return other.groupBy("qid", "chunk_id").agg(F.min(F.struct("gold_id", "sentence")).alias("m")).select("qid", "chunk_id", "m.gold_id", "m.sentence")


def shared_chunk_groups(gold: DataFrame) -> DataFrame:
    """(qid, group): questions that gold chunks join, directly or through others; a question alone is its own group."""
    star = gold.groupBy("chunk_id").agg(F.min("qid").alias("hub"))
    edges = gold.join(star, "chunk_id").select(F.col("hub").alias("a"), F.col("qid").alias("b"))
    return connected_components(edges).select(F.col("node").alias("qid"), F.col("component").alias("group"))


def grouped_split(groups: DataFrame, train_fraction: float, seed: int) -> DataFrame:
    """(group, n, split) of (group, n): whole groups to the side that is further from its target, the largest first, ties to train.

    Groups of one size go to the side that lacks more until the other lacks more,
    and to either side in turn from there on.  So a size's groups are told by their
    place in it, and the fill is a loop over the different sizes, of which there
    are at most sqrt(2 * total).  Places are counted within ranges of the order.
    """
    listed = groups.select("group", "n", T.seeded(seed, F.col("group")).alias("order"))
    sizes = listed.groupBy("n").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("n")).collect()
    total = sum(r["n"] * r["m"] for r in sizes)
    want = round(total * train_fraction)
    gap, rules = 2 * want - total, []  # how much more the training side lacks than the other
    for n, m in ((r["n"], r["m"]) for r in sizes):
        train = gap >= 0
        run = m if n == 0 else min(m, gap // n + 1 if train else -(gap // n))
        rest = m - run
        rules.append((n, train, run))
        gap += (-run if train else run) * n + (n if train else -n) * (rest % 2)
    ranges = stored(listed.repartitionByRange(F.desc("n"), "order", "group").withColumn("range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("n", "range").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("n").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("n", "range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    rule = groups.sparkSession.createDataFrame(rules, "n long, first boolean, run long")
    within = Window.partitionBy("n", "range").orderBy("order", "group")
    placed = ranges.withColumn("k", F.row_number().over(within)).join(offsets, ["n", "range"]).join(rule, "n")
    place = F.col("offset") + F.col("k") - 1
    train = F.when(place < F.col("run"), F.col("first")).otherwise(F.col("first") != ((place - F.col("run")) % 2 == 0))
    return placed.select("group", "n", F.when(train, "train").otherwise("test").alias("split"))


def check_no_shared_chunks(gold: DataFrame) -> None:
    """Raise LeakageError if a chunk is gold of both splits in (qid, chunk_id, split)."""
    both = gold.groupBy("chunk_id").agg(F.countDistinct("split").alias("n")).where("n > 1")
    if both.limit(1).count():
        raise LeakageError("a gold chunk is on both sides of the split")


def mine_negatives(found: DataFrame, gold: DataFrame, depth: int, n: int, seed: int) -> DataFrame:
    """(qid, chunk_id, rank): for each question a seeded sample of n of its first `depth` results that aren't gold."""
    pool = found.where(F.col("rank") <= depth).join(gold, ["qid", "chunk_id"], "left_anti")
    order = Window.partitionBy("qid").orderBy(T.seeded(seed, F.col("qid"), F.col("chunk_id")))
    return pool.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("qid", "chunk_id", "rank")


def training_pairs(found: DataFrame, gold: DataFrame, texts: DataFrame, depth: int, n: int, seed: int) -> DataFrame:
    """(qid, chunk_id, text, label, fused_rank): each question's smallest gold chunk with label 1, then its mined negatives with 0.

    fused_rank is null for a positive that isn't among the first `depth` results; a
    chunk without a text has an empty one, which check_pairs refuses.
    """
    ranks = found.where(F.col("rank") <= depth).select("qid", "chunk_id", "rank")
    positive = gold.groupBy("qid").agg(F.min("chunk_id").alias("chunk_id")).join(ranks, ["qid", "chunk_id"], "left").withColumn("label", F.lit(1.0))
    negative = mine_negatives(found, gold, depth, n, seed).join(gold.select("qid").distinct(), "qid", "left_semi").withColumn("label", F.lit(0.0))
    both = positive.unionByName(negative).join(texts.select("chunk_id", "text"), "chunk_id", "left")
    return both.select("qid", "chunk_id", F.coalesce("text", F.lit("")).alias("text"), "label", F.col("rank").alias("fused_rank"))


def audit_queue(first: DataFrame, second: DataFrame, controls: int, seed: int, pool: DataFrame | None = None) -> DataFrame:
    """(qid, kind) in seeded order: every row on which two screeners (qid, verdict) differ, and `controls` rows that both keep.

    Rows that the second screener didn't see, or the first left without one of the
    three verdicts, are in neither; a pool (qid) narrows the controls.
    """
    both = first.where(F.col("verdict").isin("keep", "fix", "drop")).join(second.select("qid", F.col("verdict").alias("other")), "qid")
    disputed = both.where("verdict <> other").select("qid", F.lit("disputed").alias("kind"))
    agreed = both.where("verdict = 'keep' and other = 'keep'").select("qid")
    agreed = agreed if pool is None else agreed.join(pool.select("qid"), "qid", "left_semi")
    drawn = agreed.orderBy(T.seeded(seed, F.lit("control"), F.col("qid"))).limit(controls).select("qid", F.lit("control").alias("kind"))
    return disputed.unionByName(drawn).orderBy(T.seeded(seed, F.col("qid")))


def calibration_queue(judged: DataFrame, key: str, verdict: str, size: int, seed: int, stratify: bool = False) -> DataFrame:
    """(key, verdict) of `size` judged rows in seeded order: of all alike, or half from either verdict, topped up from the other.

    Fewer rows than `size` raise EngineError.
    """
    counts = judged.agg(F.count(F.lit(1)).alias("n"), F.count_if(verdict).alias("yes")).first()
    if counts["n"] < size:
        raise EngineError(f"{counts['n']} judged rows, {size} wanted")
    order = T.seeded(seed, F.col(key))
    if not stratify:
        return judged.select(key, verdict).orderBy(order).limit(size)
    no = min(size - min(size // 2, counts["yes"]), counts["n"] - counts["yes"])
    take = {True: min(counts["yes"], size - no), False: no}
    parts = [judged.where(F.col(verdict) == v).select(key, verdict).orderBy(order).limit(k) for v, k in take.items()]
    return parts[0].unionByName(parts[1]).orderBy(T.seeded(seed, F.lit("queue"), F.col(key)))
