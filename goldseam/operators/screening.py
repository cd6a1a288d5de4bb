"""Drafting and screening of questions: bounded rounds of model replies over tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldseam.functions import text as T
from goldseam.operators.completion import Completion, replied, unquoted
from goldseam.operators.goldset import LONGEST_RUN, neighbourhood, overlaps, rule_verdict
from goldseam.store import stored

#: The rules that a model answers, which drop a question, and the one that exact matching answers, which mends it; rewrites at most.
JUDGED, VERBATIM, REWRITES = ("generic", "unanswerable", "multi_chunk"), "verbatim", 2
#: What each rule asks about a question and its passage; yes means that the rule fires.
ASKS = {
    "generic": "Could three or more other passages answer this question just as well?",
    "unanswerable": "Does the passage fail to state the answer to this question?",
    "multi_chunk": "Does the answer need something that this passage doesn't hold?",
}
SCORE = "struct<fired:boolean,reason:string,scored_by:string>"
RESULT = ["qid", "question", "original_question", "verdict", "rule", "reason", "scores", "shared_run", "rephrase_attempts"]


def prompt(instruction: Column, question: Column, passage: Column) -> Column:
    return F.concat(instruction, F.lit("\n\nQuestion: "), question, F.lit("\n\nPassage:\n"), passage)


def judged(drafts: DataFrame, judge: Completion) -> DataFrame:
    """(qid, quota, scores): a reply for every draft (qid, question, passage) and rule, even once one of them drops it, so that rules can be counted."""
    asks = F.explode(F.create_map(*[F.lit(x) for r in JUDGED for x in (r, ASKS[r])])).alias("rule", "ask")
    rows = drafts.select("*", asks)
    said = replied(rows.withColumn("prompt", prompt(F.col("ask"), F.col("question"), F.col("passage"))), judge, "judged")
    reply = F.col("reply")
    fired = F.when(reply["error"].isNull(), T.judgement(reply["text"]))
    reason = F.when(reply["error"].isNotNull(), F.concat(F.lit("call failed: "), reply["error"])).otherwise(reply["text"])
    score = F.struct(fired.alias("fired"), reason.alias("reason"), F.lit("model").alias("scored_by")).cast(SCORE)
    # as many rows a question as there are rules
    return said.groupBy("qid").agg(F.bool_or(reply["quota"]).alias("quota"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("rule", score.alias("score"))))).alias("scores"))


def screen(drafts: DataFrame, chunks: DataFrame, judge: Completion, rewrite: Completion, done: DataFrame | None = None, rewrites: int = REWRITES, longest: int = LONGEST_RUN) -> tuple[DataFrame, bool]:
    """(RESULT of the drafts that were settled, whether the quota stopped the run) of (qid, question, chunk_id), one row a qid.

    Every rule is scored.  A rule without an answer leaves a draft unscored, never
    kept, and so does a missing passage.  A rule that drops wins over the one that
    mends: more than `longest` words in a row that question and passage share.  Then
    the question is rewritten, `rewrites` times at most, until it shares no more; a
    rewrite isn't judged again.  One that fails leaves the draft unscored, and a
    question that still shares too much is dropped.

    Each round is a table of the drafts still open, so the loop is as long as there
    are rewrites, whatever the number of drafts.  Drafts that met the end of the
    quota are left out, for a later run: `done`, the rows of earlier ones, is
    skipped and not returned.
    """
    pending = drafts if done is None else drafts.join(done.select("qid"), "qid", "left_anti")
    texts = pending.select("qid", "question", "chunk_id").join(chunks.select("chunk_id", F.coalesce("text", F.lit("")).alias("passage")), "chunk_id", "left")
    table = stored(texts, "drafts")
    none = F.lit(None).cast("string")
    lost = table.where("passage is null").select(
        "qid", "question", none.alias("original_question"), F.lit("unscored").alias("verdict"), none.alias("rule"), F.concat(F.lit("chunk "), F.col("chunk_id").cast("string"), F.lit(" isn't in the store")).alias("reason"),
        F.create_map().cast(f"map<string,{SCORE}>").alias("scores"), F.lit(0).alias("shared_run"), F.lit(0).alias("rephrase_attempts"),
    )
    found = table.where("passage is not null")
    shared = overlaps(found).withColumnRenamed("length", "shared_run")
    scored = found.join(shared, "qid").join(judged(found, judge), "qid")
    said = F.when(F.col("shared_run") > longest, F.concat(F.lit("shares "), F.col("shared_run").cast("string"), F.lit(" words in a row: "), F.col("phrase"))).otherwise(F.concat(F.lit("longest shared run: "), F.col("shared_run").cast("string")))
    exact = F.struct((F.col("shared_run") > longest).alias("fired"), said.alias("reason"), F.lit("exact").alias("scored_by")).cast(SCORE)
    scored = scored.withColumn("scores", F.map_concat("scores", F.create_map(F.lit(VERBATIM), exact)))
    verdict, rule = rule_verdict({r: F.col("scores")[r]["fired"] for r in (*JUDGED, VERBATIM)}, JUDGED, (VERBATIM,))
    unscored = F.filter(F.array(*[F.lit(r) for r in JUDGED]), lambda r: F.col("scores")[r]["fired"].isNull())
    reason = F.when(verdict == "unscored", F.concat(F.lit("no score: "), F.array_join(unscored, ", "))).when(rule.isNotNull(), F.col("scores")[rule]["reason"]).otherwise("no rule fired")
    told = stored(scored.select("*", verdict.alias("verdict"), rule.alias("rule"), reason.alias("reason")), "scored")
    settled = [lost, told.where("not quota and verdict <> 'fix'").select("qid", "question", none.alias("original_question"), "verdict", "rule", "reason", "scores", "shared_run", F.lit(0).alias("rephrase_attempts"))]
    ask = F.concat(F.lit("Reword the question so that it no longer shares these words in a row with the passage, and asks for the same: "), F.col("phrase"))
    stopped = not told.where("quota").isEmpty()
    open_ = told.where("not quota and verdict = 'fix'").select("qid", "question", "passage", "scores", "shared_run", "phrase", F.col("question").alias("now"))
    for attempt in range(1, rewrites + 1):
        new = replied(open_.withColumn("prompt", prompt(ask, F.col("now"), F.col("passage"))), rewrite, "rewritten")
        stopped = stopped or not new.where("reply.quota").isEmpty()
        own = lambda df, verdict, reason, question: df.select("qid", question.alias("question"), F.when(question != F.col("question"), F.col("question")).alias("original_question"), F.lit(verdict).alias("verdict"), F.lit(VERBATIM).alias("rule"), reason.alias("reason"), "scores", "shared_run", F.lit(attempt).alias("rephrase_attempts"))  # noqa: E731, B023
        settled.append(own(new.where("not reply.quota and reply.error is not null"), "unscored", F.concat(F.lit("rewriting failed: "), F.col("reply.error")), F.col("question")))
        good = new.where("reply.error is null").withColumn("now", unquoted(F.col("reply.text"))).drop("phrase", "reply", "prompt")
        again = overlaps(good.select("qid", F.col("now").alias("question"), "passage"))
        after = stored(good.join(again, "qid"), "after")
        better = F.concat(F.lit(f"rewrite {attempt} took the run of "), F.col("shared_run").cast("string"), F.lit(" words to "), F.col("length").cast("string"))
        settled.append(own(after.where(F.col("length") <= longest), "fix", better, F.col("now")))
        worse = after.where(F.col("length") > longest)
        if attempt == rewrites:
            left = F.concat(F.lit(f"{rewrites} rewrites left a run of "), F.col("length").cast("string"), F.lit(" words: "), F.col("phrase"))
            settled.append(own(worse, "drop", left, F.col("question")))
        open_ = worse.drop("length")
    if not rewrites:
        settled.append(open_.select("qid", "question", none.alias("original_question"), F.lit("drop").alias("verdict"), F.lit(VERBATIM).alias("rule"), F.concat(F.lit("no rewrites: "), F.col("phrase")).alias("reason"), "scores", "shared_run", F.lit(0).alias("rephrase_attempts")))
    return reduce(DataFrame.unionByName, [s.select(RESULT) for s in settled]), stopped


def draft(sample: DataFrame, chunks: DataFrame, writer: Completion, checker: Completion, done: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """((qid, question, chunk_id, label_check, labelled_id, status, error), whether the quota stopped the run): a question for each (qid, chunk_id), and its label checked.

    The checker reads the chunk between its neighbours (one position before and
    after in its source) and names the passage that answers: confirmed if it is the
    chunk, relabelled if it is a neighbour, else unverified, which a failed check is
    too.  status is error without a question, draft otherwise.  Rows of `done` whose
    status isn't error are kept from earlier runs and not asked again; what met the
    end of the quota is left out.
    """
    kept = None if done is None else done.where("status <> 'error'")
    pending = sample if kept is None else sample.join(kept.select("qid"), "qid", "left_anti")
    texts = chunks.select("chunk_id", F.coalesce("text", F.lit("")).alias("passage"))
    asked = pending.select("qid", "chunk_id").join(texts, "chunk_id")
    written = replied(asked.withColumn("prompt", F.concat(F.lit("Write one question that this passage answers.\n\n"), F.col("passage"))), writer, "written")
    none = F.lit(None).cast(chunks.schema["chunk_id"].dataType)
    failed = written.where("not reply.quota and reply.error is not null").select("qid", F.lit(None).cast("string").alias("question"), "chunk_id", F.lit(None).cast("string").alias("label_check"), none.alias("labelled_id"), F.lit("error").alias("status"), F.col("reply.error").alias("error"))
    good = written.where("reply.error is null").select("qid", "chunk_id", unquoted(F.col("reply.text")).alias("question"))
    # a row for each of at most three passages, joined by id, then gathered in their order
    near = neighbourhood(chunks).join(good.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", F.posexplode(F.array("previous_id", "chunk_id", "next_id")).alias("place", "near_id")).where("near_id is not null")
    passages = near.join(texts.withColumnRenamed("chunk_id", "near_id"), "near_id").groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("place", "near_id", "passage"))).alias("near"))
    numbered = T.format_context(F.transform("near", lambda x: x["passage"]))
    shown = good.join(passages, "chunk_id").withColumn("prompt", F.concat(F.lit("Which passage answers the question? Reply with its number, or NONE.\n\nQuestion: "), F.col("question"), F.lit("\n\n"), numbered))
    checked = replied(shown, checker, "checked")
    choice = F.when(F.col("reply.error").isNull(), T.label_choice(F.col("reply.text"), F.size("near")))
    picked = F.get("near", choice - 1)["near_id"]
    check = F.when(picked.isNull(), "unverified").when(picked == F.col("chunk_id"), "confirmed").otherwise("relabelled")
    rows = checked.where("not reply.quota").select("qid", "question", "chunk_id", check.alias("label_check"), F.coalesce(picked, "chunk_id").alias("labelled_id"), F.lit("draft").alias("status"), F.col("reply.error").alias("error"))
    out = rows.unionByName(failed)
    stopped = not written.where("reply.quota").isEmpty() or not checked.where("reply.quota").isEmpty()
    return (out if kept is None else out.unionByName(kept.select(out.columns))), stopped
