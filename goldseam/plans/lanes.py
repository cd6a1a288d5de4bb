"""Queries over the six lanes, run by name over the benchmark's questions and all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from goldseam.functions import text as T
from goldseam.operators import embedding as N
from goldseam.operators import evaluation as E
from goldseam.operators import lanes as LN
from goldseam.operators import retrieval as R
from goldseam.operators.completion import by_rule
from goldseam.operators.standard import six_lanes
from goldseam.plans.inputs import DOCS, K, chunks, gold, once, questions, shared
from goldseam.plans.retrieval import GOLD, docs_index
from goldseam.store import stored

QUERIES: dict = {}
ORACLE_SQL: dict = {}

#: Lexical hits whose first words the stand-in for a model writes into a hypothetical passage, and how many words of each.
HITS, WORDS = 3, 24


class Picky(ValueError):
    """What the lane of lane_failures says of the questions that it can't answer."""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _best(name: str, score: str) -> str:
    return f"{name} as (select *, row_number() over (partition by qid order by score desc, chunk_id) as rank from ({score}))"


def _fused(name: str, dense: str) -> str:
    return _best(name, f"select qid, chunk_id, round(sum(1.0e0 / (60 + rank)), 9) as score from (select qid, chunk_id, rank from bm where rank <= 50 union all select qid, chunk_id, rank from {dense} where rank <= 50) group by all")


def _again(name: str, fused: str, count: str) -> str:
    return _best(name, f"select f.qid, f.chunk_id, round(case when len(q.w) = 0 then 0 else {count.format('list_intersect(q.w, c.w)')} / {count.format('q.w')} end, 6) as score from {fused} f join asked_w q using (qid) join tok c using (chunk_id) where f.rank <= 20")


SIX = rf"""{DOCS}, bm as (select qid, chunk_id, round(score, 6) as score, row_number() over (partition by qid order by round(score, 6) desc, chunk_id) as rank from bm_s),
 asked_w as (select qid, list_distinct(regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}_]+')) as w from qs),
 hyp as (select qid, string_agg(array_to_string(t.w[1:{WORDS}], ' '), ' ' order by b.rank) as text from bm b join tok t using (chunk_id) where b.rank <= {HITS} group by qid),
 texts as (select 'q' as kind, qid as id, '{N.QUERY_PREFIX}' || question as text from qs union all select 'h', qid, text from hyp union all select 'chunk', doc_id, coalesce(text, '') from documents),
 slots as (select kind, id, ('0x' || substr(md5(unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'))), 1, 8))::bigint % {2 * N.DIMS} as s from texts),
 parts as (select kind, id, s % {N.DIMS} as i, sum(case when s < {N.DIMS} then 1 else -1 end)::double as x from slots group by all),
 unit as (select kind, id, i, x / sqrt(sum(x * x) over (partition by kind, id)) as x from parts where x <> 0),
 dots as (select q.kind, q.id as qid, c.id as chunk_id, sum(q.x * c.x) as score from unit q join unit c using (i) where q.kind <> 'chunk' and c.kind = 'chunk' group by all),
 pr as (select q.kind, q.id as qid, c.id as chunk_id, round(coalesce(score, 0), 6) as score from texts q join texts c on q.kind <> 'chunk' and c.kind = 'chunk' left join dots d on d.kind = q.kind and d.qid = q.id and d.chunk_id = c.id),
 {_best('dn', "select qid, chunk_id, score from pr where kind = 'q'")}, {_best('dh', "select qid, chunk_id, score from pr where kind = 'h'")},
 {_fused('fq', 'dn')}, {_fused('fh', 'dh')}, {_again('a4', 'fq', 'len({0})')}, {_again('a5', '(select * from fh where qid in (select qid from hyp))', 'len({0})')},
 {_again('a6', 'fq', '(len({0}) + len(list_filter({0}, lambda x: length(x) >= 6)))')},
 six as (select 'bm25' as lane_id, * from bm union all by name select 'dense' as lane_id, * from dn union all by name select 'hybrid_rrf' as lane_id, * from fq union all by name
  select 'hybrid_rerank' as lane_id, * from a4 union all by name select 'hyde' as lane_id, * from a5 union all by name select 'hybrid_rerank_tuned' as lane_id, * from a6),
 found as (select lane_id, qid, chunk_id, score, rank::int as rank from six where rank <= {K})"""


def registry(spark, d) -> LN.Registry:
    c = chunks(spark, d)
    texts = c.select("chunk_id", "text")

    def writer(hits):
        first = F.array_join(F.slice(T.tokens(F.col("text")), 1, WORDS), " ")
        best = hits.where(F.col("rank") <= HITS).join(texts, "chunk_id").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", first.alias("words")))).alias("best"))
        passage = best.select("qid", F.array_join(F.transform("best", lambda x: x["words"]), " ").alias("passage"))
        return lambda rows: by_rule(F.col("passage"))(rows.join(passage, "qid", "left")).drop("passage")

    vectors = once(spark, d, "vectors", lambda: N.embed_chunks(c).select("chunk_id", "vector"))
    return six_lanes(texts, docs_index(spark, d), vectors, writer)


def ran(spark, d):
    """The six lanes' rows and facts, run once a session.  None of them has a reason to raise: an error is one of the query, never a miss."""

    def make():
        all_lanes = registry(spark, d).chosen()
        LN.preflight(all_lanes)
        found, facts = LN.run(all_lanes, questions(spark, d), K, caught=())
        return stored(found, "six-lanes"), facts

    return shared(spark, d, "six-lanes", make)


def _lane(name: str, lane: str) -> None:
    QUERIES[name] = lambda spark, d: ran(spark, d)[0].where(F.col("lane_id") == lane).select("qid", "chunk_id", "score", "rank")
    ORACLE_SQL[name] = f"with {SIX} select qid, chunk_id, score, rank from found where lane_id = '{lane}'"


_lane("lane_hyde", "hyde")
_lane("lane_rerank_tuned", "hybrid_rerank_tuned")

OUT = f"""{SIX}, {GOLD}, gq as (select distinct qid from gold), names as (select distinct lane_id from found),
 o as (select n.lane_id, q.qid, min(f.rank) as first from names n cross join gq q left join (select * from found join gold using (qid, chunk_id)) f on f.lane_id = n.lane_id and f.qid = q.qid group by all)"""


@query(f"""with {OUT}, w as (select qid, len(regexp_extract_all(question, '\\S+')) + 14 as asked, len(regexp_extract_all(text, '\\S+')) as said from qs left join hyp using (qid))
 select o.lane_id, count(*) as questions, count(*) filter (o.lane_id = 'hyde' and said is null) as failed, round(avg((o.first is not null)::int), 4) as recall, round(avg(coalesce(1.0e0 / o.first, 0)), 4) as mrr, true as timed,
  round(avg(case when o.lane_id <> 'hyde' then 0 when said is not null then (asked * 0.075e0 + said * 0.30e0) / 1e6 end), 10) as cost_usd from o join w using (qid) group by o.lane_id""")
def lane_metrics(spark, d):
    """Recall over all questions that have gold, time and cost over those that were answered; times differ from run to run, so only whether there are any is compared."""
    found, facts = ran(spark, d)
    g = gold(spark, d)
    q = questions(spark, d).join(g.select("qid").distinct(), "qid", "left_semi")
    names = spark.createDataFrame([(i,) for i in facts], "lane_id string")
    log = None
    for f in facts.values():
        log = f["log"] if log is None else log.unionByName(f["log"])
    out = LN.metrics(log, E.outcomes(q, found, g, K, names))
    return out.select("lane_id", "questions", "failed", "recall", "mrr", F.col("mean_ms").isNotNull().alias("timed"), "cost_usd")


@query(f"""with {DOCS}, r as (select 'picky' as lane_id, qid, chunk_id, round(score, 6) as score, row_number() over (partition by qid order by round(score, 6) desc, chunk_id) as rank from bm_s where qid % 9 <> 4)
 select e.qid, e.qid % 9 = 4 as failed, r.chunk_id, r.rank::int as rank from qs e left join r on r.qid = e.qid and r.rank <= 3""")
def lane_failures(spark, d):
    """A lane that raises for any batch with a question it can't answer: those are misses, the others keep their results."""
    index = docs_index(spark, d)

    def picky(asked, k):
        if not asked.where("qid % 9 = 4").isEmpty():
            raise Picky("a question of that kind")
        return R.bm25_search(index, asked, k)

    found, facts = LN.run([LN.Lane("picky", "Picky", picky)], questions(spark, d), 3, caught=Picky)
    log = facts["picky"]["log"]
    return log.select("qid", F.col("error").isNotNull().alias("failed")).join(found.select("qid", "chunk_id", "rank"), "qid", "left")
