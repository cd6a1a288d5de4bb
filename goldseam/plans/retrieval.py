"""Queries over ranked retrieval, its metrics and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from goldseam.functions import text as T
from goldseam.operators import embedding as N
from goldseam.operators import evaluation as E
from goldseam.operators import retrieval as R
from goldseam.plans.inputs import DOCS, HYBRID, K, S, arms, chunks, gold, hybrid_gold, hybrid_questions, hybrid_texts, lanes, once, outcomes, questions, shared
from goldseam.store import load

#: Fixed value: resamples of a bootstrap interval.
RESAMPLES = 10_000

#: The documents that hold a question's passage.
GOLD = "gold as (select item_id as qid, doc_id as chunk_id from documents d join benchmark b on contains(d.text, b.text))"

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(r"select doc_id, len(w)::int as n_tokens, len(list_distinct(w))::int as n_terms, md5(array_to_string(w, ' ')) as digest from (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as w from documents)")
def tokenize(spark, d):
    w = load(spark, d, "documents").select("doc_id", T.tokens(T.nfkc(F.col("text"))).alias("w"))
    return w.select("doc_id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_terms"), F.md5(F.array_join("w", " ")).alias("digest"))


def docs_index(spark, d):
    """The index over all documents; the first query of a session builds it."""
    return shared(spark, d, "index", lambda: R.build_index(chunks(spark, d)))


@query(r"""with tok as (select regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as w from documents), n as (select count(*) as n from tok),
 d as (select term, count(*) as df from (select unnest(list_distinct(w)) as term from tok) group by term), r as (select term, df, ln(n - df + 0.5e0) - ln(df + 0.5e0) as raw from d, n)
 select term, df, round(case when raw < 0 then 0.25e0 * avg(raw) over () else raw end, 9) as idf from r""")
def bm25_index_stats(spark, d):
    return docs_index(spark, d).terms.select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"with {DOCS} select qid, chunk_id, round(score, 6) as score, rank::int as rank from (select *, row_number() over (partition by qid order by round(score, 6) desc, chunk_id) as rank from bm_s) where rank <= 10")
def bm25_topk(spark, d):
    return R.bm25_search(docs_index(spark, d), questions(spark, d), K)


@query(f"""with {DOCS}, z as (select qid, chunk_id, 0.0e0 as score from (select distinct qid from qt), tok where (qid, chunk_id) not in (select (qid, chunk_id) from bm_s)),
 u as (select * from bm_s union all select * from z)
 select qid, chunk_id, round(score, 6) as score, rank::int as rank from (select *, row_number() over (partition by qid order by round(score, 6) desc, chunk_id) as rank from u) where rank <= 10""")
def bm25_topk_backfill(spark, d):
    return R.bm25_search(docs_index(spark, d), questions(spark, d), K, backfill=True)


@query("""select qid, chunk_id, score, rank::int as rank from (select *, row_number() over (partition by qid order by score desc, chunk_id) as rank from (
 select q.vec_id as qid, c.vec_id as chunk_id, round(list_inner_product(c.embedding::double[], q.embedding::double[]), 6) as score from embeddings q join embeddings c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)) where rank <= 10""")
def dense_topk(spark, d):
    c = load(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return R.dense_search(c, c.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("qid"), "vector"), K)


@query(f"with {HYBRID} select qid, chunk_id, score, rank::int as rank from fused")
def rrf_fusion(spark, d):
    return R.rrf(arms(spark, d), S.rrf_k)


@query(f"with {HYBRID} select qid, chunk_id, score, rank::int as rank from again where rank <= 10")
def rerank_topk(spark, d):
    return R.rerank(R.rrf(arms(spark, d), S.rrf_k), hybrid_questions(spark, d), hybrid_texts(spark, d), S.rerank_depth, K)


def _lane(name: str, lane: str) -> None:
    QUERIES[name] = lambda spark, d: lanes(spark, d).where(F.col("lane_id") == lane).select("qid", "chunk_id", "rank", "score")
    ORACLE_SQL[name] = f"with {HYBRID} select qid, chunk_id, rank::int as rank, score from lanes where lane_id = '{lane}'"


for _name, _id in (("lane_bm25", "bm25"), ("lane_dense", "dense"), ("lane_hybrid", "hybrid_rrf"), ("lane_rerank", "hybrid_rerank")):
    _lane(_name, _id)


ABLATION = rf"""with {GOLD}, texts as (select 'with_prefix' as lane_id, item_id as id, '{N.QUERY_PREFIX}' || text as text from benchmark where item_id in (select qid from gold)
  union all select 'without_prefix', item_id, text from benchmark where item_id in (select qid from gold) union all select 'chunk', doc_id, coalesce(text, '') from documents),
 slots as (select lane_id, id, ('0x' || substr(md5(unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'))), 1, 8))::bigint % {2 * N.DIMS} as s from texts),
 parts as (select lane_id, id, s % {N.DIMS} as i, sum(case when s < {N.DIMS} then 1 else -1 end)::double as x from slots group by all),
 unit as (select lane_id, id, i, x / sqrt(sum(x * x) over (partition by lane_id, id)) as x from parts where x <> 0),
 dots as (select q.lane_id, q.id as qid, c.id as chunk_id, sum(q.x * c.x) as score from unit q join unit c using (i) where q.lane_id <> 'chunk' and c.lane_id = 'chunk' group by all),
 pr as (select q.lane_id, q.id as qid, c.id as chunk_id, round(coalesce(score, 0), 6) as score from texts q join texts c on q.lane_id <> 'chunk' and c.lane_id = 'chunk' left join dots d on d.lane_id = q.lane_id and d.qid = q.id and d.chunk_id = c.id),
 top as (select lane_id, qid, chunk_id, row_number() over (partition by lane_id, qid order by score desc, chunk_id) as rank from pr),
 f as (select lane_id, qid, min(rank) as first from top join gold using (qid, chunk_id) where rank <= 10 group by all),
 m as (select e.lane_id, count(*) as questions, avg((coalesce(first, 99) <= 5)::int) as r5, avg((first is not null)::int) as r10, avg(coalesce(1.0e0 / first, 0)) as mrr from (select lane_id, id as qid from texts where lane_id <> 'chunk') e left join f using (lane_id, qid) group by e.lane_id),
 rounded as (select lane_id, questions, round(r5, 4) as recall_at_5, round(r10, 4) as recall_at_10, round(mrr, 4) as mrr from m)
 select * from rounded union all by name
 select 'delta' as lane_id, a.questions, round(a.recall_at_5 - b.recall_at_5, 4) as recall_at_5, round(a.recall_at_10 - b.recall_at_10, 4) as recall_at_10, round(a.mrr - b.mrr, 4) as mrr from rounded a, rounded b where a.lane_id = 'with_prefix' and b.lane_id = 'without_prefix'"""


@query(ABLATION)
def prefix_ablation(spark, d):
    """The dense lane over embedded documents, its queries with and without the instruction, and the difference."""
    g = gold(spark, d)
    q = questions(spark, d).join(g.select("qid").distinct(), "qid", "left_semi")
    vectors = once(spark, d, "vectors", lambda: N.embed_chunks(chunks(spark, d)).select("chunk_id", "vector"))
    found = once(spark, d, "prefix-arms", lambda: N.prefix_arms(vectors, q, K))
    names = spark.createDataFrame([("with_prefix",), ("without_prefix",)], "lane_id string")
    five, ten = (E.outcomes(q, found, g, k, names) for k in (5, K))
    joined = ten.join(five.select("lane_id", "qid", F.col("hit").alias("hit5")), ["lane_id", "qid"])
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 4)
    rows = joined.groupBy("lane_id").agg(F.count(F.lit(1)).alias("questions"), mean("hit5").alias("recall_at_5"), mean("hit").alias("recall_at_10"), mean("rr").alias("mrr"))
    sign = F.when(F.col("lane_id") == "with_prefix", 1.0).otherwise(-1.0)
    metrics = ("recall_at_5", "recall_at_10", "mrr")
    delta = rows.agg(F.max("questions").alias("questions"), *[F.round(F.sum(sign * F.col(c)), 4).alias(c) for c in metrics])
    return rows.unionByName(delta.where("questions is not null").select(F.lit("delta").alias("lane_id"), "questions", *metrics))


def _metric(name: str, sql: str):
    return query(f"with {HYBRID} {sql}")


@_metric("hit_at_k", "select lane_id, qid, hit from outc")
def hit_at_k(spark, d):
    return outcomes(spark, d).select("lane_id", "qid", "hit")


@_metric("reciprocal_rank", "select lane_id, qid, round(rr, 6) as rr from outc")
def reciprocal_rank(spark, d):
    return outcomes(spark, d).select("lane_id", "qid", F.round("rr", 6).alias("rr"))


@_metric("recall_at_k", "select lane_id, round(avg(hit::int), 4) as recall from outc group by lane_id")
def recall_at_k(spark, d):
    return outcomes(spark, d).groupBy("lane_id").agg(F.round(F.avg(F.col("hit").cast("int")), 4).alias("recall"))


@_metric("mrr", "select lane_id, round(avg(rr), 4) as mrr from outc group by lane_id")
def mrr(spark, d):
    return outcomes(spark, d).groupBy("lane_id").agg(F.round(F.avg("rr"), 4).alias("mrr"))


LEADER = """, at5 as (select e.lane_id, e.qid, f.qid is not null as hit5 from every e left join (select distinct lane_id, qid from lanes join gold using (qid, chunk_id) where rank <= 5) f using (lane_id, qid)),
 lat as (select qid, lane_id, abs(hash_ms % 1000) / 10.0e0 as ms from (select qid, lane_id, ('0x' || substr(md5(lane_id || ':' || qid), 1, 6))::bigint as hash_ms from every)),
 board as (select lane_id, count(*) as questions, round(avg(hit5::int), 4) as recall_at_5, round(avg(hit::int), 4) as recall_at_10, round(avg(rr), 4) as mrr_at_10,
  round(quantile_cont(ms, 0.95), 1) as p95_ms, round(avg(ms), 1) as mean_ms from outc join at5 using (lane_id, qid) join lat using (lane_id, qid) group by lane_id)"""


def board(spark, d):
    five = outcomes(spark, d, 5).select("lane_id", "qid", F.col("hit").alias("hit5"))
    ms = F.conv(F.substring(F.md5(F.concat_ws(":", "lane_id", "qid")), 1, 6), 16, 10).cast("long") % 1000 / 10.0
    joined = outcomes(spark, d).join(five, ["lane_id", "qid"]).withColumn("ms", ms)
    mean = lambda c, n: F.round(F.avg(F.col(c).cast("double")), n)
    return joined.groupBy("lane_id").agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg(F.col("hit5").cast("int")), 4).alias("recall_at_5"), F.round(F.avg(F.col("hit").cast("int")), 4).alias("recall_at_10"), mean("rr", 4).alias("mrr_at_10"), F.round(F.expr("percentile(ms, 0.95)"), 1).alias("p95_ms"), mean("ms", 1).alias("mean_ms"))


@query(f"with {HYBRID}{LEADER} select * from board")
def leaderboard(spark, d):
    return board(spark, d)


@query(f"""with {HYBRID}{LEADER}, g as (select max(recall_at_10) filter (lane_id = 'hybrid_rrf') as h, max(recall_at_10) filter (lane_id in ('bm25', 'dense')) as a from board)
 select case when h is null or a is null then 'skipped' when h > a then 'pass' when h = a then 'tie' else 'fail' end as status, h as hybrid, a as best_arm from g""")
def fusion_gate(spark, d):
    g = board(spark, d).agg(F.max(F.when(F.col("lane_id") == "hybrid_rrf", F.col("recall_at_10"))).alias("h"), F.max(F.when(F.col("lane_id").isin("bm25", "dense"), F.col("recall_at_10"))).alias("a"))
    status = F.when(F.col("h").isNull() | F.col("a").isNull(), "skipped").when(F.col("h") > F.col("a"), "pass").when(F.col("h") == F.col("a"), "tie").otherwise("fail")
    return g.select(status.alias("status"), F.col("h").alias("hybrid"), F.col("a").alias("best_arm"))


@query(f"with {HYBRID} select lane_id, qid, list(chunk_id order by rank) as retrieved from lanes group by all")
def per_question(spark, d):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"])  # K rows a group
    return lanes(spark, d).groupBy("lane_id", "qid").agg(listed.alias("retrieved"))


PAIR = ", pr as (select a.qid, a.hit as hit_a, b.hit as hit_b, a.rr as rr_a, b.rr as rr_b from outc a join outc b using (qid) where a.lane_id = 'hybrid_rrf' and b.lane_id = 'hybrid_rerank')"


def pairs(spark, d):
    return E.paired(outcomes(spark, d), "hybrid_rrf", "hybrid_rerank")


@query(f"with {HYBRID}{PAIR} select qid, hit_a, hit_b, round(rr_a, 6) as rr_a, round(rr_b, 6) as rr_b from pr")
def paired_outcomes(spark, d):
    return pairs(spark, d).select("qid", "hit_a", "hit_b", F.round("rr_a", 6).alias("rr_a"), F.round("rr_b", 6).alias("rr_b"))


@query(f"with {HYBRID}{PAIR} select count(*) filter (hit_a and not hit_b) as a_only, count(*) filter (hit_b and not hit_a) as b_only from pr")
def discordant_pairs(spark, d):
    return pairs(spark, d).agg(F.count_if(F.col("hit_a") & ~F.col("hit_b")).alias("a_only"), F.count_if(F.col("hit_b") & ~F.col("hit_a")).alias("b_only"))


@query(f"with {HYBRID} select lane_id, count(*) filter (not hit) as wins from outc group by lane_id")
def detectable_wins(spark, d):
    return E.detectable_wins(outcomes(spark, d))


@query(f"with {HYBRID}{PAIR} select qid, case when hit_b then 'won' else 'lost' end as change from pr where hit_a <> hit_b")
def changed_questions(spark, d):
    return E.changed(pairs(spark, d))


@query(f"with {HYBRID} select lane_id, 0.95e0 as threshold, round(avg(hit::int), 4) as observed, avg(hit::int) > 0.95 as fired from outc group by lane_id")
def tripwire(spark, d):
    return E.tripwire(outcomes(spark, d))


@query(f"with {DOCS} select lane_id, qid, chunk_id, score, rank::int as rank from (select 'bm25' as lane_id, qid, chunk_id, round(score, 6) as score, row_number() over (partition by qid order by round(score, 6) desc, chunk_id) as rank from bm_s) where rank <= 5")
def lane_run(spark, d):
    """Two lanes over all questions, of which one fails: it has no rows, and the other keeps its own."""

    from goldseam.operators import lanes as LN

    def broken(asked, k):
        raise LN.LaneUnavailable("no model")

    registry, index = LN.Registry(), docs_index(spark, d)
    registry.add(LN.Lane("bm25", "BM25", lambda asked, k: R.bm25_search(index, asked, k)))
    registry.add(LN.Lane("broken", "A lane without a model", broken))
    LN.preflight(registry.chosen())
    found, facts = LN.run(registry.chosen(), questions(spark, d), 5, caught=LN.LaneUnavailable)
    assert facts["broken"]["error"] and not facts["bm25"]["error"]
    return found


MCNEMAR = """, dp as (select (count(*) filter (hit_a and not hit_b))::int as a_only, (count(*) filter (hit_b and not hit_a))::int as b_only from pr),
 mc as (select a_only, b_only, case when a_only + b_only = 0 then 1.0e0 else least(1.0e0, 2 * (select sum(exp(lgamma(a_only + b_only + 1e0) - lgamma(i + 1e0) - lgamma(a_only + b_only - i + 1e0) - (a_only + b_only) * ln(2e0)))
  from range(greatest(a_only, b_only), a_only + b_only + 1) t(i))) end as p from dp)"""


@query(f"with {HYBRID}{PAIR}{MCNEMAR} select a_only, b_only, round(p, 6) as p_value from mc")
def mcnemar(spark, d):
    return E.mcnemar(pairs(spark, d)).withColumn("p_value", F.round("p_value", 6))


BOOT = """, num as (select *, row_number() over (order by qid) - 1 as place, count(*) over () as n, rr_b - rr_a as v from pr),
 means as (select b, avg(v) as m from (select b, ('0x' || substr(md5('42:' || b || ':' || i), 1, 8))::bigint % (select max(n) from num) as place from range(10000) t(b), range((select max(n) from num)) u(i)) join num using (place) group by b)"""


@query(f"with {HYBRID}{PAIR}{BOOT} select round((select avg(v) from num), 6) as mean, round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high from means")
def bootstrap_ci(spark, d):
    b = E.bootstrap(pairs(spark, d).withColumn("v", F.col("rr_b") - F.col("rr_a")), "v", RESAMPLES, S.seed)
    return b.select(*[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query(f"""with {HYBRID}{PAIR}{MCNEMAR}{BOOT}, ci as (select quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high from means)
 select case when low > 0 then 'better' when high < 0 then 'worse' else 'undecided' end as verdict, round(p, 6) as p_value from ci, mc""")
def significance(spark, d):
    p = pairs(spark, d)
    ci = E.bootstrap(p.withColumn("v", F.col("rr_b") - F.col("rr_a")), "v", RESAMPLES, S.seed)
    return ci.crossJoin(E.mcnemar(p)).select(F.when(F.col("low") > 0, "better").when(F.col("high") < 0, "worse").otherwise("undecided").alias("verdict"), F.round("p_value", 6).alias("p_value"))


DEPTHS, RRF_KS = (10, 20, 30, 50), (1, 5, 10, 20, 30, 60, 100)


@query(f"""with {HYBRID}, cells as (select depth, k from (values {', '.join(f'({x})' for x in DEPTHS)}) a(depth), (values {', '.join(f'({x})' for x in RRF_KS)}) b(k)),
 f as (select *, row_number() over (partition by depth, k, qid order by score desc, chunk_id) as rank from (select depth, k, qid, chunk_id, round(sum(1.0e0 / (k + rank)), 9) as score from arms join cells on rank <= depth group by depth, k, qid, chunk_id)),
 o as (select depth, k, qid, min(rank) as first from f join gold using (qid, chunk_id) where rank <= 10 group by all)
 select c.depth, c.k, round(count(o.qid) / (select count(*) from qs), 4) as recall, round(coalesce(sum(1.0e0 / o.first), 0) / (select count(*) from qs), 4) as mrr from cells c left join o using (depth, k) group by all""")
def rrf_sweep(spark, d):
    """Every cell of depth and k over arms that are retrieved once."""
    q = hybrid_questions(spark, d)
    g = hybrid_gold(spark, d, arms(spark, d))
    cells = spark.createDataFrame([(a, b) for a in DEPTHS for b in RRF_KS], "depth int, k int")
    hit = arms(spark, d).join(F.broadcast(cells), F.col("rank") <= F.col("depth"))  # the grid is 28 rows
    fused = hit.groupBy("depth", "k", "qid", "chunk_id").agg(F.sum(1.0 / (F.col("k") + F.col("rank"))).alias("score"))
    from pyspark.sql import Window

    order = Window.partitionBy("depth", "k", "qid").orderBy(F.round("score", 9).desc(), "chunk_id")
    top = fused.withColumn("rank", F.row_number().over(order)).where("rank <= 10").join(g, ["qid", "chunk_id"], "left_semi").groupBy("depth", "k", "qid").agg(F.min("rank").alias("first"))
    n = q.agg(F.count(F.lit(1)).alias("n"))
    return cells.join(top, ["depth", "k"], "left").groupBy("depth", "k").agg(F.count("qid").alias("h"), F.coalesce(F.sum(1.0 / F.col("first")), F.lit(0.0)).alias("r")).crossJoin(n).select("depth", "k", F.round(F.col("h") / F.col("n"), 4).alias("recall"), F.round(F.col("r") / F.col("n"), 4).alias("mrr"))


@query(f"with {HYBRID} select f.qid, b.hit as bm25, n.hit as dense, f.hit as fused from outc f join outc b using (qid) join outc n using (qid) where f.lane_id = 'hybrid_rrf' and b.lane_id = 'bm25' and n.lane_id = 'dense'")
def arms_comparison(spark, d):
    return outcomes(spark, d).groupBy("qid").agg(*[F.max(F.when(F.col("lane_id") == i, F.col("hit"))).alias(n) for i, n in (("bm25", "bm25"), ("dense", "dense"), ("hybrid_rrf", "fused"))])


@query(f"with {GOLD} select qid, count(*) as n_gold, min(chunk_id) as positive from gold group by qid")
def gold_by_containment(spark, d):
    return gold(spark, d).groupBy("qid").agg(F.count(F.lit(1)).alias("n_gold"), F.min("chunk_id").alias("positive"))


FLAGSHIP = f"""with {DOCS}, {GOLD}, top as (select qid, chunk_id, row_number() over (partition by qid order by round(score, 6) desc, chunk_id) as rank from bm_s),
 q as (select distinct qid from gold), f as (select qid, min(rank) as first from top join gold using (qid, chunk_id) where rank <= 10 group by qid)
 select count(*) as questions, round(avg((coalesce(first, 99) <= 5)::int), 4) as recall_at_5, round(avg((first is not null)::int), 4) as recall_at_10, round(avg(coalesce(1.0e0 / first, 0)), 4) as mrr from q left join f using (qid)"""


@query(FLAGSHIP)
def bm25_evaluation(spark, d):
    """Questions to BM25 to recall and MRR; a question without gold is none."""
    g = gold(spark, d)
    q = g.select("qid").distinct()
    top = R.bm25_search(docs_index(spark, d), questions(spark, d).join(q, "qid", "left_semi"), K)
    first = top.join(g, ["qid", "chunk_id"], "left_semi").groupBy("qid").agg(F.min("rank").alias("first"))
    joined = q.join(first, "qid", "left")
    mean = lambda c: F.round(F.avg(c), 4)
    return joined.agg(F.count(F.lit(1)).alias("questions"), mean((F.coalesce("first", F.lit(99)) <= 5).cast("int")).alias("recall_at_5"), mean(F.col("first").isNotNull().cast("int")).alias("recall_at_10"), mean(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))


