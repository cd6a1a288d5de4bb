"""Queries over drafting and screening, with replies that rules over the tables give."""

from __future__ import annotations

from pyspark.sql import functions as F

from goldseam.operators import screening as C
from goldseam.operators.completion import by_rule
from goldseam.plans.inputs import gold, once, questions
from goldseam.plans.retrieval import GOLD
from goldseam.store import load, spread

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def runs(name: str, source: str) -> str:
    """CTE name(qid, n): the longest common run of words of source(qid, q, p)."""
    words = lambda c: f"select qid, unnest(w) as w, generate_subscripts(w, 1) as i from (select qid, regexp_extract_all(lower({c}), '[a-z0-9]+') as w from {source})"
    return f"""{name} as (select s.qid, coalesce(max(r.n), 0) as n from {source} s left join (select qid, d, g, count(*) as n from (
  select qid, d, qi - row_number() over (partition by qid, d order by qi) as g from (select qid, a.i as qi, b.i - a.i as d from ({words('q')}) a join ({words('p')}) b using (qid, w))) group by all) r using (qid) group by s.qid)"""


MENDED = "array_to_string(list_transform(regexp_split_to_array({0}, '\\s+'), lambda w, i: case when i % (3 + qid % 4) = 0 then w || ' which' else w end), ' ')".format
SCREEN = f"""with {GOLD}, dr as (select b.item_id as qid, b.text as q, d.text as p from benchmark b left join (select qid, min(chunk_id) as c from gold group by qid) g on g.qid = b.item_id left join documents d on d.doc_id = g.c),
 held as (select * from dr where p is not null), {runs('r0', 'held')},
 sc as (select *, len(regexp_extract_all(q, '\\S+')) < 30 as generic, length(p) < 600 as unanswerable, case when qid % 11 = 3 then null else false end as multi_chunk, n > 4 as verbatim from held join r0 using (qid)),
 v as (select *, case when multi_chunk is null then 'unscored' when generic or unanswerable or multi_chunk then 'drop' when verbatim then 'fix' else 'keep' end as verdict,
  case when multi_chunk is null then null when generic then 'generic' when unanswerable then 'unanswerable' when multi_chunk then 'multi_chunk' when verbatim then 'verbatim' end as rule from sc),
 w1 as (select qid, {MENDED('q')} as q, p from v where verdict = 'fix' and qid % 7 <> 0), {runs('r1', 'w1')},
 w2 as (select qid, {MENDED('q')} as q, p from w1 join r1 using (qid) where n > 4), {runs('r2', 'w2')},
 one as (select qid, 'unscored' as verdict, null as rule, q as question, null::boolean as generic, 0 as shared_run, 0 as attempts from dr where p is null
  union all by name select qid, verdict, rule, q as question, generic, n as shared_run, 0 as attempts from v where verdict <> 'fix'
  union all by name select qid, 'unscored' as verdict, rule, q as question, generic, n as shared_run, 1 as attempts from v where verdict = 'fix' and qid % 7 = 0
  union all by name select qid, 'fix' as verdict, rule, w1.q as question, generic, v.n as shared_run, 1 as attempts from v join w1 using (qid) join r1 using (qid) where r1.n <= 4
  union all by name select qid, 'fix' as verdict, rule, w2.q as question, generic, v.n as shared_run, 2 as attempts from v join w2 using (qid) join r2 using (qid) where r2.n <= 4
  union all by name select qid, 'drop' as verdict, rule, v.q as question, generic, v.n as shared_run, 2 as attempts from v join w2 using (qid) join r2 using (qid) where r2.n > 4)"""


def screened(spark, d):
    """The benchmark's questions about the first document that holds each; a judge and a writer that follow rules."""
    ids = gold(spark, d).groupBy("qid").agg(F.min("chunk_id").alias("chunk_id"))
    drafts = questions(spark, d).join(ids, "qid", "left")
    chunks = load(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text").where("text is not null")
    short = F.size(F.regexp_extract_all("question", F.lit("(\\S+)"), 1)) < 30
    said = F.when(F.col("rule") == "generic", F.when(short, "Yes.\nMany could.").otherwise("No: it is one thing."))
    said = said.when(F.col("rule") == "unanswerable", F.when(F.length("passage") < 600, "YES, it is missing").otherwise("  no"))
    judge = by_rule(said.otherwise(F.when(F.col("qid") % 11 == 3, "Perhaps.").otherwise("No")))
    every = (3 + F.col("qid") % 4).cast("int")
    mended = F.array_join(F.transform(F.split("now", "\\s+"), lambda w, i: F.when((i + 1) % every == 0, F.concat(w, F.lit(" which"))).otherwise(w)), " ")
    rewrite = by_rule(F.when(F.col("qid") % 7 != 0, F.concat(F.lit('"'), mended, F.lit('"'))))
    return once(spark, d, "screened", lambda: C.screen(drafts, chunks, judge, rewrite)[0])


@query(SCREEN + " select qid, verdict, rule, md5(question) as question, generic, shared_run::int as shared_run, attempts from one")
def screening(spark, d):
    """Verdicts after two rounds of rewriting, with replies that can't be read and rewrites that fail."""
    s = screened(spark, d)
    return s.select("qid", "verdict", "rule", F.md5("question").alias("question"), F.col("scores")["generic"]["fired"].alias("generic"), F.col("shared_run").cast("int").alias("shared_run"), F.col("rephrase_attempts").alias("attempts"))


@query(SCREEN + " select verdict, coalesce(rule, 'none') as rule, count(*) as n, sum(attempts)::bigint as rewrites from one group by all")
def screening_tally(spark, d):
    return screened(spark, d).groupBy("verdict", F.coalesce("rule", F.lit("none")).alias("rule")).agg(F.count(F.lit(1)).alias("n"), F.sum("rephrase_attempts").cast("long").alias("rewrites"))


FIRST = r"array_to_string(regexp_extract_all(text, '\S+')[1:8], ' ')"


@query(rf"""with ch as (select doc_id, doc_id // 7 as s, doc_id % 7 as i, coalesce(text, '') as text from documents),
 near as (select *, case when lag(i) over w = i - 1 then lag(doc_id) over w end as before, case when lead(i) over w = i + 1 then lead(doc_id) over w end as after from ch window w as (partition by s order by i)),
 q as (select doc_id, {FIRST} as question, before, after, 1 + (before is not null)::int + (after is not null)::int as passages from near where doc_id % 10 = 0),
 a as (select *, case length(question) % 4 when 0 then null else length(question) % 4 end as said from q where len(regexp_extract_all(question, '\S+')) >= 5),
 b as (select *, case when said <= passages then list_filter([before, doc_id, after], lambda x: x is not null)[said] end as picked from a)
 select doc_id as chunk_id, md5(question) as question, case when picked is null then 'unverified' when picked = doc_id then 'confirmed' else 'relabelled' end as label_check, coalesce(picked, doc_id) as labelled_id, 'draft' as status from b
 union all select doc_id, null, null, null, 'error' from q where len(regexp_extract_all(question, '\S+')) < 5""")
def drafting(spark, d):
    """A question for every tenth document, its label checked against the documents before and after it, seven to a source."""
    docs = spread(load(spark, d, "documents"))
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.floor(F.col("doc_id") / 7).alias("source_doc"), (F.col("doc_id") % 7).alias("chunk_index"), "text")
    words = F.regexp_extract_all("passage", F.lit("(\\S+)"), 1)
    writer = by_rule(F.when(F.size(words) >= 5, F.concat(F.lit("'"), F.array_join(F.slice(words, 1, 8), " "), F.lit("'"))))
    place = F.length("question") % 4
    checker = by_rule(F.when(place == 0, "NONE of them").otherwise(F.concat(F.lit("Passage "), place.cast("string"))))
    sample = chunks.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("qid"), "chunk_id")
    rows, _ = C.draft(sample, chunks, writer, checker)
    return rows.select("chunk_id", F.md5("question").alias("question"), "label_check", "labelled_id", "status")
