"""Retrieval lanes by name, run over whole batches of questions, with what failed and what each stage took."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextvars import ContextVar, copy_context
from dataclasses import dataclass, field
from functools import reduce
from threading import Lock

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldseam.config import EngineError
from goldseam.operators.ranks import numbered
from goldseam.store import stored

#: Batches of a lane that may fail, about half of them single questions, before a lane that has answered none counts as one that answers nothing.
PATIENCE = 1000
#: Batches of a lane that run side by side once its first has failed, and results that are kept apart until they are written together.
BESIDE, APART = 8, 64
#: Dollars for a million tokens of prompts and of replies.
RATES = (0.075, 0.30)

LOG = "lane_id string, qid {0}, error string, ms double, prompt_tokens long, completion_tokens long"
_stages: ContextVar[list | None] = ContextVar("stages", default=None)


class LaneUnavailable(EngineError):
    """Lanes that can't be prepared; that isn't a score of 0."""


@dataclass(frozen=True)
class Answer:
    """What a lane may give instead of plain rows: rows (qid, chunk_id, score, rank), and usage (qid, error, prompt_tokens, completion_tokens) of the questions that a model was asked for.

    A question with an error is a miss, whatever rows it has.
    """

    rows: DataFrame
    usage: DataFrame | None = None


@dataclass(frozen=True)
class Lane:
    """retrieve(questions, k) gives (qid, chunk_id, score, rank), or an Answer, for all questions at once; warm() prepares what isn't timed."""

    id: str
    label: str
    retrieve: Callable[[DataFrame, int], DataFrame | Answer]
    warm: Callable[[], object] = lambda: None


class Registry(dict):
    """Lanes in the order in which they were added."""

    def add(self, lane: Lane) -> Lane:
        if lane.id in self:
            raise ValueError(f"there is a lane {lane.id} already")
        self[lane.id] = lane
        return lane

    def chosen(self, names: list[str] | None = None) -> list[Lane]:
        """The lanes named, each once, in the registry's order whatever the caller's; all without names."""
        unknown = sorted(set(names or ()) - set(self))
        if unknown:
            raise ValueError(f"no lanes {unknown}; there are {list(self)}")
        return [lane for name, lane in self.items() if names is None or name in names]


def preflight(lanes: list[Lane]) -> None:
    """Prepare all lanes, then raise LaneUnavailable with every one that can't be, so that one attempt shows all that is missing."""
    missing = {}
    for lane in lanes:
        try:
            lane.warm()
        except Exception as e:
            missing[lane.id] = f"{type(e).__name__}: {e}"
    if missing:
        raise LaneUnavailable("not ready: " + "; ".join(f"{name} ({why})" for name, why in missing.items()))


def stage(name: str, rows: DataFrame) -> DataFrame:
    """A stage of a lane: written and timed while run() runs the lane, else passed on as it is."""
    times = _stages.get()
    if times is None:
        return rows
    began = time.perf_counter()
    out = stored(rows, name)
    n = out.count()
    times.append((name, time.perf_counter() - began, n))
    return out


@dataclass
class _Run:
    rows: list[DataFrame] = field(default_factory=list)
    log: list[DataFrame] = field(default_factory=list)
    stages: dict[str, list] = field(default_factory=dict)
    failed: int = 0
    lock: Lock = field(default_factory=Lock)
    caught: type[Exception] | tuple = Exception


def _answered(lane: Lane, asked: DataFrame, k: int, run: _Run) -> None:
    """Answer a batch; of one that fails, the questions that fail alone are misses and all others are answered.

    Halves that retrieve() raises for are told first, without answering any, so that
    what it takes goes into one batch: a search reads its index once more, however
    many questions fail.  If that batch fails too, or retrieve() takes all, so that
    the fault lies in the rows, it is halved and answered in parts.
    """
    n = asked.count()
    if not n:
        return
    error = _tried(lane, asked, n, k, run)
    if error is None:
        return
    placed, n_lost = _placed(asked), 0

    def lose(lo: int, hi: int, e: str) -> None:
        nonlocal n_lost
        n_lost += hi - lo
        lost = _part(placed, lo, hi).select("qid", F.lit(e).alias("error"), F.lit(None).cast("double").alias("ms"), F.lit(0).cast("long").alias("prompt_tokens"), F.lit(0).cast("long").alias("completion_tokens"))
        run.log.append(lost)
        if len(run.log) > APART:
            run.log[:] = [stored(reduce(DataFrame.unionByName, run.log), "apart")]

    taken = _halved(placed, n, error, lambda some, m: _refused(lane, some, k, run), lose, run)
    if not n_lost:
        _halved(placed, n, error, lambda some, m: _tried(lane, some, m, k, run), lose, run)
    elif taken:
        ranges = asked.sparkSession.createDataFrame(taken, "lo long, hi long")
        within = (F.col("__place") >= F.col("lo")) & (F.col("__place") < F.col("hi"))
        rest = stored(placed.join(F.broadcast(ranges), within, "left_semi").drop("__place"), "taken")  # a row for each part that was taken
        error = _tried(lane, rest, n - n_lost, k, run)
        if error is not None:
            placed = _placed(rest)
            _halved(placed, n - n_lost, error, lambda some, m: _tried(lane, some, m, k, run), lose, run)


def _placed(asked: DataFrame) -> DataFrame:
    """The questions with their place in the order of a hash."""
    by_hash = asked.withColumn("__hash", F.xxhash64("qid"))
    return stored(numbered(by_hash, "__hash", "qid", name="__place").drop("__hash"), "placed")


def _part(placed: DataFrame, lo: int, hi: int) -> DataFrame:
    return placed.where((F.col("__place") >= lo) & (F.col("__place") < hi)).drop("__place")


def _halved(placed: DataFrame, n: int, error: str, attempt: Callable[[DataFrame, int], str | None], lose: Callable[[int, int, str], None], run: _Run) -> list[tuple[int, int]]:
    """The ranges of places for which attempt() has no error: a batch with one is halved until the questions that fail stand alone, which lose() gets.

    The smallest batches go first, BESIDE of them side by side.  Questions are given
    up untried only if more than PATIENCE batches have failed and none did not.
    """
    good: list[tuple[int, int]] = []
    stack = [(0, n, error)]  # ranges of places that have failed
    with ThreadPoolExecutor(BESIDE) as pool:
        while stack:
            dead = run.failed > PATIENCE and not run.rows and not good
            some = [stack.pop() for _ in range(min(len(stack), len(stack) if dead else BESIDE // 2))]
            for lo, hi, e in some:
                if dead or hi - lo == 1:
                    lose(lo, hi, e)
            halves = [h for lo, hi, _ in some if not dead and hi - lo > 1 for h in ((lo, (lo + hi) // 2), ((lo + hi) // 2, hi))]
            tries = [pool.submit(copy_context().run, attempt, _part(placed, lo, hi), hi - lo) for lo, hi in halves]
            for (lo, hi), t in zip(halves, tries, strict=True):
                if (e := t.result()) is None:
                    good.append((lo, hi))
                else:
                    stack.append((lo, hi, e))
            if len(run.rows) > APART:
                run.rows[:] = [stored(reduce(DataFrame.unionByName, run.rows), "apart")]
            if len(run.log) > APART:
                run.log[:] = [stored(reduce(DataFrame.unionByName, run.log), "apart")]
    return good


def _refused(lane: Lane, asked: DataFrame, k: int, run: _Run) -> str | None:
    """Why retrieve() raises for a batch, if it does; no stage is written or timed, and no row is made."""
    token = _stages.set(None)
    try:
        lane.retrieve(asked, k)
    except run.caught as e:
        with run.lock:
            run.failed += 1
        return f"{type(e).__name__}: {e}"
    finally:
        _stages.reset(token)
    return None


def _tried(lane: Lane, asked: DataFrame, n: int, k: int, run: _Run) -> str | None:
    """Answer a batch of n questions, or say why it failed."""
    times: list = []
    token = _stages.set(times)
    began = time.perf_counter()
    try:
        answer = lane.retrieve(asked, k)
        answer = answer if isinstance(answer, Answer) else Answer(answer)
        rows = stored(answer.rows.select("qid", "chunk_id", "score", "rank"), f"lane-{lane.id}")
        usage = None if answer.usage is None else stored(answer.usage.select("qid", "error", "prompt_tokens", "completion_tokens"), "usage")
    except run.caught as e:  # a lane's fault must lose neither other lanes nor other questions
        with run.lock:
            run.failed += 1
        return f"{type(e).__name__}: {e}"
    finally:
        _stages.reset(token)
    ms = (time.perf_counter() - began) * 1000 / n
    log = asked.select("qid") if usage is None else asked.select("qid").join(usage, "qid", "left")
    whole = log if usage is not None else log.selectExpr("qid", "cast(null as string) as error", "0L as prompt_tokens", "0L as completion_tokens")
    whole = whole.select("qid", "error", F.when(F.col("error").isNull(), F.lit(ms)).alias("ms"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("prompt_tokens", "completion_tokens")])
    with run.lock:
        for name, seconds, out in times:
            total = run.stages.setdefault(name, [0.0, 0])
            total[0] += seconds
            total[1] += out
        run.log.append(whole)
        run.rows.append(rows if usage is None else rows.join(usage.where("error is not null"), "qid", "left_anti"))
    return None


def run(lanes: list[Lane], questions: DataFrame, k: int, caught: type[Exception] | tuple = Exception) -> tuple[DataFrame, dict[str, dict]]:
    """((lane_id, qid, chunk_id, score, rank), facts by lane) of prepared lanes.

    A lane answers the whole batch at once.  A batch that raises is halved, so a
    question that a lane can't answer is one failed question and the others keep
    their results; only a lane of which more than PATIENCE batches failed and none
    was answered is given up.
    A failed question has no rows, so outcomes() counts it as a miss.  Questions
    without text are misses likewise: no lane sees them.  Only errors of the kinds
    `caught` are failures of questions; any other ends the run, and () catches none.

    facts hold the label, log (LOG: an error, or a question's share of its batch's
    time, and tokens), failures (their number), stages (name, seconds, rows), the
    seconds in all and a question, and error: that of a lane no question of which
    was answered.
    """
    spark = questions.sparkSession
    asked = stored(questions.where(F.trim(F.coalesce("question", F.lit(""))) != ""), "asked")
    n, facts = asked.count(), {}
    kind = asked.schema["qid"].dataType.simpleString()
    parts = []
    for lane in lanes:
        began = time.perf_counter()
        own = _Run(caught=caught)
        _answered(lane, asked, k, own)
        took = time.perf_counter() - began
        parts += [r.select(F.lit(lane.id).alias("lane_id"), "qid", "chunk_id", "score", "rank") for r in own.rows]
        logged = [x.select(F.lit(lane.id).alias("lane_id"), "qid", "error", "ms", "prompt_tokens", "completion_tokens") for x in own.log]
        log = stored(reduce(DataFrame.unionByName, logged), "log") if logged else spark.createDataFrame([], LOG.format(kind))
        failures = log.where("error is not null").count()
        error = log.where("error is not null").first()["error"] if failures and failures == n else None
        stages = [(name, seconds, out) for name, (seconds, out) in own.stages.items()]
        facts[lane.id] = {"label": lane.label, "seconds": took, "seconds_per_question": took / n if n else 0.0, "error": error, "failures": failures, "stages": stages, "log": log}
    if not parts:
        return spark.createDataFrame([], f"lane_id string, qid {kind}, chunk_id {kind}, score double, rank int"), facts
    return reduce(DataFrame.unionByName, parts), facts


def metrics(log: DataFrame, outcomes: DataFrame, rates: tuple[float, float] = RATES) -> DataFrame:
    """(lane_id, questions, failed, recall, mrr, mean_ms, p95_ms, cost_usd) of a log and the outcomes (lane_id, qid, hit, rr) of the same lanes.

    Recall and MRR are over all questions, a failed one being a miss; times and cost
    are over answered ones only, and null where there are none, as nothing was
    measured.
    """
    good = F.col("error").isNull() & F.col("ms").isNotNull()
    cost = (F.col("prompt_tokens") * rates[0] + F.col("completion_tokens") * rates[1]) / 1e6
    joined = outcomes.join(log, ["lane_id", "qid"], "left")
    return joined.groupBy("lane_id").agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.round(F.avg(F.col("hit").cast("int")), 4).alias("recall"),
        F.round(F.avg("rr"), 4).alias("mrr"),
        F.round(F.avg(F.when(good, F.col("ms"))), 1).alias("mean_ms"),
        F.round(F.percentile(F.when(good, F.col("ms")), F.lit(0.95)), 1).alias("p95_ms"),
        F.round(F.avg(F.when(good, cost)), 10).alias("cost_usd"),
    )
