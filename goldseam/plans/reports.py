"""Queries over summaries, the published document, the versioned store and the ordered digest."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from goldseam.config import Settings
from goldseam.operators import evaluation as E
from goldseam.operators import ingest as I
from goldseam.operators import summaries as U
from goldseam.operators.ranks import ordered_digest
from goldseam.plans import goldset as G
from goldseam.plans.inputs import HYBRID, S, outcomes
from goldseam.plans.retrieval import BOOT, LEADER, PAIR, RESAMPLES, board, pairs
from goldseam.sources.chunkstore import ChunkStore
from goldseam.store import load, shared_dir

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


DECIDED = """de as (select case when quality = 1 then 'keep' when toxic = 1 then 'drop' else 'fix' end as v, case when n_chars > 1000 then 'keep' when n_chars > 300 then 'fix' else 'drop' end as h, case when doc_id % 3 = 0 then 'blind' else 'revealed' end as m,
 case when lang = 'en' then case when toxic = 1 then 'drop' else 'keep' end end as s, case when lang = 'en' then case when (quality = 1) = (toxic = 1) then 'disputed' when source = 'src0' then 'control' else 'other' end end as k from labels join documents using (doc_id)),
 st as (select 'overall' as section, 'all' as name, * from de union all select 'verdict', v, * from de union all select 'mode', m, * from de union all select 'kind', k, * from de where k is not null)"""


@query(f"""with {DECIDED} select section, name, count(*) as audited, count(*) filter (v = h) as agreed, round(count(*) filter (v = h) / count(*), 4) as agreement,
 case when section = 'kind' then count(*) filter (h = s) end as agreed_with_second, case when section = 'kind' then count(*) filter (v <> h and h <> s) end as neither,
 array_to_string(list_filter([case when count(*) filter (h = 'keep') > 0 then 'keep:' || count(*) filter (h = 'keep') end, case when count(*) filter (h = 'fix') > 0 then 'fix:' || count(*) filter (h = 'fix') end, case when count(*) filter (h = 'drop') > 0 then 'drop:' || count(*) filter (h = 'drop') end], lambda x: x is not null), ',') as human_said from st group by section, name""")
def audit_report(spark, d):
    """Agreement overall, by verdict, by mode and by kind of queue, with what the auditor said."""
    j = load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "n_chars", "lang", "source"), "doc_id")
    good, toxic, en = F.col("quality") == 1, F.col("toxic") == 1, F.col("lang") == "en"
    return U.audit(
        j.select(
            F.when(good, "keep").when(toxic, "drop").otherwise("fix").alias("screen_verdict"),
            F.when(F.col("n_chars") > 1000, "keep").when(F.col("n_chars") > 300, "fix").otherwise("drop").alias("human_verdict"),
            (F.col("doc_id") % 3 == 0).alias("blind"),
            F.when(en, F.when(toxic, "drop").otherwise("keep")).alias("second_verdict"),
            F.when(en, F.when(good == toxic, "disputed").when(F.col("source") == "src0", "control")).alias("queue_kind"),
        )
    )


#: Three lanes answer every conversation's first assistant turn; the third has come half way, and short answers have failed.
RECORDS = r"""re as (select l.lane_id, conv_id as qid, length(text) < 40 as failed, list_transform(regexp_split_to_array(text, '\.\s+'), lambda s: length(s) % 5 <> l.n) as v, length(text) // 4 as tokens
 from (select conv_id, arg_min(text, turn) as text from conversations where role = 'assistant' group by conv_id) join (values ('bm25', 0), ('dense', 1), ('hybrid_rrf', 2)) l(lane_id, n) on l.n < 2 or conv_id % 2 = 0),
 sp as (select count(distinct conv_id) filter (length(text) >= 40) as questions from (select conv_id, arg_min(text, turn) as text from conversations where role = 'assistant' group by conv_id)),
 ju as (select lane_id, count(*) as answers, count(*) filter (len(v) > 0 and list_bool_and(v)) as grounded, sum(len(v))::bigint as sentences, sum(len(list_filter(v, lambda x: not x)))::bigint as unsupported, sum(tokens)::bigint as prompt_tokens,
  round(sum(tokens) / count(*))::bigint as mean_prompt_tokens, (select questions from sp) as of_questions, count(distinct qid) >= (select questions from sp) as complete from re where not failed group by lane_id),
 jr as (select *, round(grounded / answers, 4) as rate from ju)"""


def records(spark, d):
    first = load(spark, d, "conversations").where("role = 'assistant'").groupBy(F.col("conv_id").alias("qid")).agg(F.min_by("text", "turn").alias("text"))
    lanes = spark.createDataFrame([("bm25", 0), ("dense", 1), ("hybrid_rrf", 2)], "lane_id string, n int")
    every = first.join(F.broadcast(lanes), (F.col("n") < 2) | (F.col("qid") % 2 == 0))  # three lanes
    verdicts = F.transform(F.split("text", "\\.\\s+"), lambda s: F.struct((F.length(s) % 5 != F.col("n")).alias("supported")))
    out = every.select("lane_id", "qid", F.when(F.length("text") < 40, "no answer").alias("error"), verdicts.alias("verdicts"), F.floor(F.length("text") / 4).alias("prompt_tokens"))
    return out, first.where(F.length("text") >= 40).count()


def judge_rows(spark, d):
    return U.judged(*records(spark, d))


@query(f"with {RECORDS} select * from jr")
def judge_report(spark, d):
    """Groundedness by lane, with what it cost and whether the sweep is complete."""
    return judge_rows(spark, d)


@query("""with c as (select length(text) % 3 > 0 as judge, case when length(text) % 7 = 0 then null else length(text) % 2 = 0 end as human from conversations where role = 'assistant'),
 p as (select avg((human = judge)::int) as po, avg(human::int) * avg(judge::int) + (1 - avg(human::int)) * (1 - avg(judge::int)) as pc from c where human is not null),
 r as (select 'all' as class, * from c union all select case when judge then 'judge yes' else 'judge no' end, * from c)
 select class, count(human) as n, count(*) filter (human = judge) as agreed, count(*) filter (human is null) as skipped, round(count(*) filter (human = judge) / count(human), 4) as agreement, case when class = 'all' then (select round((po - pc) / (1 - pc), 4) from p) end as kappa from r group by class""")
def calibration_report(spark, d):
    """A judge against a human who skips some items."""
    n = F.length("text")
    return U.calibration(load(spark, d, "conversations").where("role = 'assistant'").select((n % 3 > 0).alias("judge"), F.when(n % 7 != 0, n % 2 == 0).alias("human")))


@query("""with t as (select role as name, length(text) as tokens from conversations where text is not null)
 select name, count(*) as n, min(tokens)::int as least, list_sort(list(tokens))[count(*) // 2 + 1]::int as median, max(tokens)::int as most, (case name when 'user' then 2000 else 6000 end)::int as budget, round((case name when 'user' then 2000 else 6000 end) / max(tokens), 1) as headroom from t group by name having name in ('user', 'assistant')""")
def call_budgets(spark, d):
    """What calls have used of their budgets."""
    calls = load(spark, d, "conversations").where("role in ('user', 'assistant')").select(F.col("role").alias("name"), F.length("text").alias("tokens"))
    return U.budgets(calls, {"user": 2000, "assistant": 6000})


@query(f"with {HYBRID}{LEADER}, {RECORDS} select b.lane_id, b.questions, b.recall_at_10, b.mrr_at_10, r.rate as groundedness from board b left join jr r on r.lane_id = b.lane_id and r.complete")
def published_results(spark, d):
    """The lanes of the published document, read back: groundedness only of complete sweeps, absent elsewhere."""
    answers, questions = records(spark, d)
    judge = U.judged(answers, questions)
    rows = board(spark, d).select("lane_id", "questions", "recall_at_10", "mrr_at_10")
    doc = U.document(rows, {"split": "test", "score_depth": 10}, U.publishable(judge, questions))
    return U.published(doc, "lane_id string, questions bigint, recall_at_10 double, mrr_at_10 double, groundedness double")


@query(f"""with {HYBRID}{PAIR}{BOOT}, ci as (select quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high from means),
 f as (select bool_or(r > 0.95) as leak from (select avg(hit::int) as r from outc where lane_id = 'hybrid_rerank'))
 select case when leak then 'withheld' when low > 0 then 'improvement' when high < 0 then 'regression' else 'no detectable difference' end as verdict, round((select avg(v) from num), 6) as mean, round(low, 6) as low, round(high, 6) as high from ci, f""")
def significance_verdict(spark, d):
    """The interval decides alone; a tripwire on the challenger withholds it."""
    ci = E.bootstrap(pairs(spark, d).withColumn("v", F.col("rr_b") - F.col("rr_a")), "v", RESAMPLES, S.seed)
    out = E.decide(ci, E.tripwire(outcomes(spark, d).where("lane_id = 'hybrid_rerank'")))
    return out.select("verdict", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


NODES = "select (place // 1024) as place, sha256(string_agg(hash, '' order by place)) as hash from {0} group by 1"


@query(f"""with l as (select row_number() over (order by url, page_id) - 1 as place, sha256(url || '#' || page_id || chr(0) || coalesce(html, '')) as hash from pages),
 n1 as ({NODES.format('l')}), n2 as ({NODES.format('n1')}), n3 as ({NODES.format('n2')}), n4 as ({NODES.format('n3')}) select (select count(*) from l) as files, hash as digest from n4""".replace("order by url, page_id", "order by url || '#' || page_id"))
def corpus_digest(spark, d):
    """One hash over all pages in the order of their names: a byte or a name that changes, changes it."""
    pages = load(spark, d, "pages").select(F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("path"), "html").where("path is not null")
    return ordered_digest(pages, "path", F.col("html"))


@query()
def chunk_token_spans(spark, d):
    """Chunks of 128 tokens of a model's vocabulary, slices of the texts; no SQL, as that has no tokenizer (tested against the library)."""
    import public_tokenizers

    docs = load(spark, d, "documents").select(F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("source_doc"), "text")
    return I.chunk_by_spans(docs, 128, 16, I.model_spans(public_tokenizers.path("byte_bpe_50k.json")))


@query(G.CUT + """ select chunk_id, chunk_index, md5(text) as digest, start_char, (start_char + length(text))::int as end_char from cut where replace(replace(source_doc, 'doc_', ''), '.txt', '')::bigint % 5 <> 0""")
def chunk_store(spark, d):
    """Two ingests into one store, the second without every fifth document: its newest version."""
    store = ChunkStore(spark, f"{shared_dir(spark)}/goldseam/store-{uuid.uuid4().hex}")
    docs = load(spark, d, "documents").select(F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("source_doc"), "text", "doc_id")
    s = Settings(chunk_size=128, chunk_overlap=16)
    store.ensure(64)
    store.ingest(docs.withColumn("text", F.concat("text", F.lit(" once"))), "docs", s)
    store.ingest(docs.where("doc_id % 5 <> 0"), "docs", s)
    return store.chunks().select("chunk_id", "chunk_index", F.md5("text").alias("digest"), "start_char", "end_char")
