"""Figures about audits, judges and lanes, and the document that publishes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from goldseam.config import EngineError
from goldseam.operators.evaluation import kappa

#: What an auditor may say.
VERDICTS = ("keep", "fix", "drop")


def share(part: Column, whole: Column) -> Column:
    return F.round(part / F.nullif(whole, F.lit(0)), 4)


def audit(decisions: DataFrame) -> DataFrame:
    """(section, name, audited, agreed, agreement, agreed_with_second, neither, human_said) of (screen_verdict, human_verdict, blind, second_verdict, queue_kind).

    Sections are overall, verdict, mode (blind or revealed) and kind, the last over
    decisions with a second verdict only, whose two last counts are null elsewhere.
    They are grouping sets of one aggregate; classes without a decision are absent,
    and human_said is a histogram of what occurs, as text.
    """
    agreed = F.col("human_verdict") == F.col("screen_verdict")
    second = F.col("human_verdict") == F.col("second_verdict")
    rows = decisions.select(
        F.col("screen_verdict").alias("verdict"), F.when(F.col("blind"), "blind").otherwise("revealed").alias("mode"), F.when(F.col("second_verdict").isNotNull(), F.coalesce("queue_kind", F.lit("other"))).alias("kind"),
        F.col("human_verdict").alias("human"), agreed.alias("agreed"), second.alias("second"),
    )
    said = F.array_join(F.filter(F.array(*[F.when(F.count_if(F.col("human") == v) > 0, F.concat(F.lit(f"{v}:"), F.count_if(F.col("human") == v).cast("string"))) for v in VERDICTS]), lambda x: x.isNotNull()), ",")
    sets = rows.groupingSets([[], ["verdict"], ["mode"], ["kind"]], "verdict", "mode", "kind").agg(
        F.grouping_id().alias("set"), F.count(F.lit(1)).alias("audited"), F.count_if("agreed").alias("agreed"), F.count_if("second").alias("with_second"), F.count_if(~F.col("agreed") & ~F.col("second")).alias("neither"), said.alias("human_said"),
    )
    # of three columns, a bit of the set is 1 where the column isn't grouped by
    section = F.when(F.col("set") == 7, "overall").when(F.col("set") == 3, "verdict").when(F.col("set") == 5, "mode").otherwise("kind")
    kind = F.col("set") == 6
    out = sets.where(~kind | F.col("kind").isNotNull())
    return out.select(section.alias("section"), F.coalesce("verdict", "mode", "kind", F.lit("all")).alias("name"), "audited", "agreed", share(F.col("agreed"), F.col("audited")).alias("agreement"), F.when(kind, F.col("with_second")).alias("agreed_with_second"), F.when(kind, F.col("neither")).alias("neither"), "human_said")


def judged(records: DataFrame, questions: int) -> DataFrame:
    """(lane_id, answers, grounded, rate, sentences, unsupported, prompt_tokens, mean_prompt_tokens, of_questions, complete) of (lane_id, qid, error, verdicts array<struct<supported>>, prompt_tokens).

    An answer is grounded if it has sentences and all are supported.  Records with
    an error are no answers and count against nobody; complete says that a lane has
    an answer for every question of the split, so a part of a sweep can be told.
    """
    good = records.where("error is null")
    bad = F.size(F.filter("verdicts", lambda v: ~v["supported"]))
    rows = good.select("lane_id", "qid", F.greatest(F.size("verdicts"), F.lit(0)).alias("n"), F.greatest(bad, F.lit(0)).alias("bad"), "prompt_tokens")
    sums = rows.groupBy("lane_id").agg(F.count(F.lit(1)).alias("answers"), F.countDistinct("qid").alias("asked"), F.count_if((F.col("n") > 0) & (F.col("bad") == 0)).alias("grounded"), F.sum("n").alias("sentences"), F.sum("bad").alias("unsupported"), F.sum("prompt_tokens").alias("prompt_tokens"))
    return sums.select("lane_id", "answers", "grounded", share(F.col("grounded"), F.col("answers")).alias("rate"), "sentences", "unsupported", "prompt_tokens", F.round(F.col("prompt_tokens") / F.col("answers")).cast("long").alias("mean_prompt_tokens"), F.lit(questions).cast("long").alias("of_questions"), (F.col("asked") >= questions).alias("complete"))


def calibration(answers: DataFrame) -> DataFrame:
    """(class, n, agreed, skipped, agreement, kappa) of (human, judge) booleans: a row for either answer of the judge and one for all; a null human answer is a skip."""
    scored = answers.where("human is not null and judge is not null")
    k = kappa(scored, "human", "judge").select(F.round("kappa", 4).alias("kappa"))
    rows = answers.where("judge is not null").rollup("judge").agg(F.count("human").alias("n"), F.count_if(F.col("human") == F.col("judge")).alias("agreed"), F.count_if(F.col("human").isNull()).alias("skipped"))
    name = F.when(F.col("judge").isNull(), "all").when(F.col("judge"), "judge yes").otherwise("judge no")
    return rows.crossJoin(F.broadcast(k)).select(name.alias("class"), "n", "agreed", "skipped", share(F.col("agreed"), F.col("n")).alias("agreement"), F.when(F.col("judge").isNull(), F.col("kappa")).alias("kappa"))


def budgets(calls: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(name, n, least, median, most, budget, headroom) of (name, tokens): the upper median, and how many times the largest call fits into its budget."""
    sizes = calls.where("tokens is not null").groupBy("name", "tokens").agg(F.count(F.lit(1)).alias("c"))  # sizes are few: no list of all calls is gathered
    order = Window.partitionBy("name").orderBy("tokens")
    upto = sizes.withColumn("upto", F.sum("c").over(order)).withColumn("total", F.sum("c").over(Window.partitionBy("name")))
    budget = F.coalesce(*[F.when(F.col("name") == k, F.lit(v)) for k, v in limits.items()])
    out = upto.groupBy("name").agg(F.sum("c").alias("n"), F.min("tokens").alias("least"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("tokens"))).alias("median"), F.max("tokens").alias("most"))
    return out.select("name", "n", "least", "median", "most", budget.alias("budget"), F.round(budget / F.greatest(F.col("most"), F.lit(1)), 1).alias("headroom"))


def publishable(judge: DataFrame, questions: int) -> DataFrame:
    """(lane_id, groundedness) of judged() rows: only lanes whose sweep is complete and of this split's size."""
    return judge.where(F.col("complete") & (F.col("of_questions") == questions)).select("lane_id", F.col("rate").alias("groundedness"))


def document(board: DataFrame, facts: dict[str, object], grounded: DataFrame | None = None, failures: DataFrame | None = None) -> DataFrame:
    """One row (document): the published JSON of the lanes' figures, in the order of their names.

    What wasn't measured is absent, never null or zero: a lane has groundedness only
    if `grounded` (lane_id, groundedness) has it, and the key failures is there only
    if (lane_id, qid, error) rows are.  Lanes without figures raise EngineError.
    """
    if board.isEmpty():
        raise EngineError("no lanes to publish")
    rows = board if grounded is None else board.join(grounded, "lane_id", "left")
    # a row for each lane
    lanes = rows.agg(F.sort_array(F.collect_list(F.struct("lane_id", *[c for c in rows.columns if c != "lane_id"]))).alias("lanes"))
    out = lanes.select(*[F.lit(v).alias(k) for k, v in facts.items()], "lanes")
    if failures is not None and not failures.isEmpty():
        each = failures.groupBy("lane_id").agg(F.sort_array(F.collect_list(F.struct("qid", "error"))).alias("f"))
        out = out.crossJoin(each.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lane_id", "f")))).alias("failures")))
    return out.select(F.to_json(F.struct(*out.columns), {"ignoreNullFields": "true"}).alias("document"))


def published(documents: DataFrame, schema: str) -> DataFrame:
    """The lanes of published documents, with the columns of the schema; a key that is absent is null."""
    fields = ", ".join(f"{name}: {kind}" for name, kind in (x.strip().split(" ", 1) for x in schema.split(", ")))
    return documents.select(F.explode(F.from_json("document", f"lanes array<struct<{fields}>>")["lanes"]).alias("x")).select("x.*")
