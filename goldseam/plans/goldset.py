"""Queries over ingest, gold set work, mining and judging."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from goldseam.functions import text as T
from goldseam.operators import evaluation as E
from goldseam.operators import goldset as G
from goldseam.operators import guards as L
from goldseam.operators import ingest as I
from goldseam.operators.retrieval import rrf
from goldseam.plans.inputs import HYBRID, S, arms, gold, hybrid_gold, hybrid_texts, labelled, once, positives, questions
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


docs = lambda spark, d: spread(load(spark, d, "documents"))
labels = lambda spark, d: load(spark, d, "labels")
seeded = lambda *x: f"md5('42:' || {" || ':' || ".join(x)})"

# ---------------------------------------------------------------- ingest


@query(r"select doc_id, length(t) as n, md5(t) as digest from (select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as t from documents)")
def normalise_text(spark, d):
    return docs(spark, d).select("doc_id", T.normalise_text(F.col("text")).alias("t")).select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


@query(r"select page_id, s || '_ch_' || case when length(i::varchar) < 3 then lpad(i::varchar, 3, '0') else i::varchar end as chunk_id from (select page_id, page_id * 7 as i, regexp_replace(regexp_replace(lower(regexp_replace(url, '\.[^./]*$', '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as s from pages)")
def chunk_ids(spark, d):
    return load(spark, d, "pages").select("page_id", T.chunk_id(T.slug(F.col("url")), F.col("page_id") * 7).alias("chunk_id"))


WORDS = r"ws as (select doc_id, regexp_extract_all(text, '\s*\S+') as w from documents), win as (select doc_id, w, i::int as chunk_index, (i * 112)::int as first from ws, range(0, 1000000) t(i) where len(w) > 0 and i <= greatest(0, ceil((len(w) - 128) / 112.0)))"


@query(f"with {WORDS} select doc_id, chunk_index, first from win")
def chunk_windows(spark, d):
    n = docs(spark, d).select("doc_id", F.size(F.regexp_extract_all("text", F.lit("(\\s*\\S+)"), 1)).alias("n"))
    return n.select("doc_id", F.posexplode(T.window_starts(F.col("n"), 128, 16)).alias("chunk_index", "first"))


CUT = rf"""with {WORDS}, body as (select doc_id, chunk_index, array_to_string(w[1:first], '') as lead, array_to_string(w[first + 1:first + 128], '') as b from win),
 cut as (select 'doc_' || doc_id || '.txt' as source_doc, 'doc_' || doc_id || '_ch_' || case when chunk_index < 1000 then lpad(chunk_index::varchar, 3, '0') else chunk_index::varchar end as chunk_id,
  chunk_index, regexp_replace(b, '^\s+', '') as text, (length(lead) + length(b) - length(regexp_replace(b, '^\s+', '')))::int as start_char from body)"""


def cut(spark, d):
    named = docs(spark, d).select(F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("source_doc"), "text")
    return I.chunk_documents(named, 128, 16)


@query(CUT + " select chunk_id, chunk_index, md5(text) as digest, start_char, (start_char + length(text))::int as end_char from cut")
def chunk_documents(spark, d):
    return cut(spark, d).select("chunk_id", "chunk_index", F.md5("text").alias("digest"), "start_char", "end_char")


@query(CUT + " select count(distinct source_doc) as documents, count(*) as chunks, min(length(text))::int as min_chars, max(length(text))::int as max_chars, (list_sort(list(length(text))))[(count(*) // 2) + 1]::int as median_chars from cut")
def ingest_report(spark, d):
    return I.ingest_report(cut(spark, d))


@query("select doc_id as chunk_id, lang as corpus_id, case when doc_id in (select doc_id from labels) then text || ' (new)' else text end as text from documents")
def upsert_chunks(spark, d):
    old = docs(spark, d).select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("corpus_id"), "text")
    new = old.join(labels(spark, d).select(F.col("doc_id").alias("chunk_id")).distinct(), "chunk_id", "left_semi").withColumn("text", F.concat("text", F.lit(" (new)")))
    return I.upsert(old, new.select(old.columns))


@query("select doc_id as chunk_id, lang as corpus_id from documents where lang <> 'en' or doc_id in (select doc_id from labels)")
def prune_chunks(spark, d):
    table = docs(spark, d).select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("corpus_id"))
    return I.prune(table, labels(spark, d).select(F.col("doc_id").alias("chunk_id")), "en")


@query("select doc_id as chunk_id, source as source_doc, n_chars from documents where lang = 'en' order by 1")
def fetch_chunks(spark, d):
    return docs(spark, d).where("lang = 'en'").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_doc"), "n_chars").orderBy("chunk_id")


@query("select lang as corpus_id, count(*) as n from documents group by lang")
def count_rows(spark, d):
    return docs(spark, d).groupBy(F.col("lang").alias("corpus_id")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""select case when regexp_matches(url, '(^|/)(api|reference)(/|$)') then 'reference' when regexp_matches(lower(url), '(^|/)(license|changelog|contributing|code_of_conduct)[^/]*$') then 'boilerplate'
 when regexp_matches(url, '(^|/)(tests?|fixtures)(/|$)') then 'fixture' when strlen(html) < 500 then 'too_small' else 'kept' end as reason, count(*) as n from pages group by 1""")
def source_filter(spark, d):
    r = I.skip_reason(F.col("url"), F.octet_length("html"))
    return load(spark, d, "pages").groupBy(F.coalesce(r, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""with p as (select regexp_replace(url, '^[^:]*://[^/]*/?', '') as path, strlen(html) as n from pages) select case when regexp_matches(path, '(^|/)(api|reference)(/|$)') then 'reference' when regexp_matches(lower(path), '(^|/)(license|changelog|contributing|code_of_conduct)[^/]*$') then 'boilerplate'
 when regexp_matches(path, '(^|/)(tests?|fixtures)(/|$)') then 'fixture' when contains(path, '/') and split_part(path, '/', 1) not in ('en', 'fr') then 'subdirectory' when n < 500 then 'too_small' else 'kept' end as reason, count(*) as n from p group by 1""")
def source_selection(spark, d):
    """Pages at the top of a site and in two of its folders."""
    path = F.regexp_replace("url", "^[^:]*://[^/]*/?", "")
    r = I.skip_reason(path, F.octet_length("html"), folders=("en", "fr"))
    return load(spark, d, "pages").groupBy(F.coalesce(r, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("select source, count(*) as files, sum(strlen(text))::bigint as bytes, sum(('0x' || substr(sha256(doc_id || ':' || text), 1, 8))::bigint)::bigint as digest from documents group by source")
def corpus_manifest(spark, d):
    """Files, bytes and a digest of each source that doesn't depend on the order of its files."""
    part = F.conv(F.substring(F.sha2(F.concat_ws(":", "doc_id", "text"), 256), 1, 8), 16, 10).cast("long")
    return docs(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.sum(part).alias("digest"))


# ---------------------------------------------------------------- predicates

DENSE = r"coalesce(length({0}) >= 8 and length(regexp_replace({0}, '[^\p{{L}}\p{{Z}}\s]', '', 'g')) / length({0}) < 0.75, false)".format
BARE = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')".format
PROSE = rf"""l0 as (select doc_id, length(text) as total, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i, len(string_split(text, chr(10))) as k from documents),
 ln as (select *, length(line) + (i < k)::int as n, {BARE('line')} as bare, regexp_matches(line, '^\s*(```|~~~)') as fence, regexp_matches(line, '\{{\*.*?\*\}}') as incl, {DENSE(BARE('line'))} as dense from l0),
 op as (select doc_id, coalesce(arg_min(bare, i) filter (fence) in ('```', '~~~'), false) as opens, count(*) filter (fence) % 2 = 1 as odd, coalesce(arg_min(dense, i) filter (bare <> ''), false) as dense_first, coalesce(arg_max(dense, i) filter (bare <> ''), false) as dense_last from ln group by doc_id),
 st as (select ln.*, opens <> (coalesce(sum(fence::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) % 2 = 1) as inside from ln join op using (doc_id)),
 np as (select doc_id, case when max(total) = 0 then 1 else coalesce(sum(n) filter (fence or incl or dense or inside), 0) / max(total) end as f from st group by doc_id),
 own as (select *, regexp_matches(line, '^\s*import\s+\w+\s+from\s+[''"]') as imp, regexp_matches(bare, '^[a-zA-Z][\p{{L}}\p{{N}}_-]*:\s') as keyed from ln),
 fm as (select doc_id, coalesce(bool_or(bare = '---') filter (i = 1), false) as block, coalesce(min(i) filter (i > 1 and bare = '---'), 1000000000) as shut, coalesce(min(i) filter (bare <> '' and not imp and not keyed), 1000000000) as other from own group by doc_id),
 sf as (select doc_id, case when max(total) = 0 then 1 else coalesce(sum(n) filter (imp or (block and i <= shut) or (not block and keyed and i < other)), 0) / max(total) end as f from own join fm using (doc_id) group by doc_id)"""


@query(f"with {PROSE} select doc_id, round(f, 6) as fraction from np")
def non_prose_fraction(spark, d):
    return docs(spark, d).select("doc_id", F.round(G.non_prose_fraction(F.col("text")), 6).alias("fraction"))


@query(f"with {PROSE} select doc_id, round(f, 6) as fraction from sf")
def scaffolding_fraction(spark, d):
    return docs(spark, d).select("doc_id", F.round(G.scaffolding_fraction(F.col("text")), 6).alias("fraction"))


@query(f"with {PROSE} select doc_id, opens as in_fence, opens or dense_first as opens_inside, opens <> odd or dense_last as closes_inside from op")
def code_edges(spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", G.opens_inside_fence(t).alias("in_fence"), G.opens_inside_code(t).alias("opens_inside"), G.closes_inside_code(t).alias("closes_inside"))


@query(rf"""with {PROSE}, e as (select case when length(text) < 200 then 'too_short' when np.f > 0.5 then 'too_much_code' when sf.f > 0.5 then 'scaffolding' when opens or dense_first or opens <> odd or dense_last then 'code_edges' else 'eligible' end as reason
  from documents d join np using (doc_id) join sf using (doc_id) join op using (doc_id)) select reason, count(*) as n from e group by 1""")
def eligibility(spark, d):
    return docs(spark, d).groupBy(G.eligibility(F.col("text")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


HEADED = r"(doc_id % 7 = 0 or coalesce(regexp_matches(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '\S'))[1], '^#{1,6}\s'), false))"


@query(f"select doc_id, {HEADED} as starts from documents")
def starts_at_heading(spark, d):
    """The documents taken as chunks of seven a source."""
    return docs(spark, d).select("doc_id", G.starts_at_heading(F.col("text"), F.col("doc_id") % 7).alias("starts"))


FIRED = "fr as (select doc_id, toxic = 1 as toxic, quality = 0 as junk, case when lang = 'en' then n_chars > 4000 when lang = 'fr' then n_chars > 2000 else null end as long from documents join labels using (doc_id))"
VERDICT = f"with {FIRED}, v as (select doc_id, case when toxic is null or junk is null or long is null then 'unscored' when toxic or junk then 'drop' when long then 'fix' else 'keep' end as verdict, case when toxic is null or junk is null or long is null then null when toxic then 'toxic' when junk then 'junk' when long then 'long' end as rule from fr)"


def fired(spark, d):
    j = docs(spark, d).join(labels(spark, d), "doc_id")
    long = F.when(F.col("lang") == "en", F.col("n_chars") > 4000).when(F.col("lang") == "fr", F.col("n_chars") > 2000)
    return j.select("doc_id", (F.col("toxic") == 1).alias("toxic"), (F.col("quality") == 0).alias("junk"), long.alias("long"))


@query(VERDICT + " select * from v")
def rule_verdict(spark, d):
    v, r = G.rule_verdict({c: F.col(c) for c in ("toxic", "junk", "long")}, ("toxic", "junk"), ("long",))
    return fired(spark, d).select("doc_id", v.alias("verdict"), r.alias("rule"))


@query(f"with {FIRED} select rule, count(*) as n from (select unnest(['toxic', 'junk', 'long']) as rule, unnest([toxic, junk, long]) as f from fr) where f group by 1")
def rule_counts(spark, d):
    scores = F.create_map(*[x for c in ("toxic", "junk", "long") for x in (F.lit(c), F.col(c))])
    return fired(spark, d).select(F.explode(scores).alias("rule", "f")).where("f").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


ADJ = """adj as (select l.doc_id as qid, case when b.item_id is not null then 'hand-excluded' when toxic = 1 then 'audit' when d.doc_id is null then 'unvalidated' when d.v = (case when quality = 1 then 'keep' else 'drop' end) then 'both-agree' else 'unaudited-dispute' end as source,
 case when b.item_id is not null or toxic = 1 or quality = 0 then 'drop' else 'keep' end as verdict from labels l left join benchmark b on b.item_id = l.doc_id left join (select doc_id, case when n_chars > 1000 then 'keep' else 'drop' end as v from documents where lang = 'en') d on d.doc_id = l.doc_id)"""


def adjudicated(spark, d):
    first = labels(spark, d).select(F.col("doc_id").alias("qid"), F.when(F.col("quality") == 1, "keep").otherwise("drop").alias("verdict"))
    audit = labels(spark, d).where("toxic = 1").select(F.col("doc_id").alias("qid"), F.lit("drop").alias("verdict"))
    second = docs(spark, d).where("lang = 'en'").select(F.col("doc_id").alias("qid"), F.when(F.col("n_chars") > 1000, "keep").otherwise("drop").alias("verdict"))
    return G.adjudicate(first, audit, second, questions(spark, d).select("qid"))


@query(f"with {ADJ} select * from adj")
def adjudicate(spark, d):
    return adjudicated(spark, d).select("qid", "source", "verdict")


@query(f"with {ADJ} select count(*) filter (verdict = 'keep' and source in ('audit', 'both-agree')) as accepted, count(*) filter (verdict = 'drop' and source in ('audit', 'both-agree')) as rejected_on_quality, count(*) filter (source = 'hand-excluded') as excluded, count(*) filter (source in ('unvalidated', 'unaudited-dispute')) as rejected_unreviewed from adj")
def census(spark, d):
    settled, v = F.col("source").isin("audit", "both-agree"), F.col("verdict")
    return adjudicated(spark, d).agg(F.count_if(settled & (v == "keep")).alias("accepted"), F.count_if(settled & (v == "drop")).alias("rejected_on_quality"), F.count_if(F.col("source") == "hand-excluded").alias("excluded"), F.count_if(F.col("source").isin("unvalidated", "unaudited-dispute")).alias("rejected_unreviewed"))


@query(f"with {ADJ} select qid, source from adj where verdict = 'keep' and source <> 'unvalidated' order by case source when 'both-agree' then 0 when 'audit' then 1 else 2 end, qid")
def assemble_select(spark, d):
    first = F.when(F.col("source") == "both-agree", 0).when(F.col("source") == "audit", 1).otherwise(2)
    return adjudicated(spark, d).where("verdict = 'keep' and source <> 'unvalidated'").select("qid", "source").orderBy(first, "qid")


@query(f"with {ADJ} select qid, verdict from adj where source not in ('audit', 'hand-excluded') and verdict = 'keep'")
def coverage_queue(spark, d):
    return adjudicated(spark, d).where("source not in ('audit', 'hand-excluded') and verdict = 'keep'").select("qid", "verdict")


@query("select conv_id, turn, text as answer from conversations where role = 'assistant'")
def blind_projection(spark, d):
    """Only the whitelisted fields reach a blind labeller."""
    return load(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))


@query("select doc_id as qid, case when toxic = 1 then [doc_id, doc_id + 1] else [doc_id] end as gold, toxic = 1 as added from labels")
def apply_multilabel(spark, d):
    base = labels(spark, d).select(F.col("doc_id").alias("qid"), F.array("doc_id").alias("gold"))
    also = labels(spark, d).where("toxic = 1").select(F.col("doc_id").alias("qid"), F.array("doc_id", F.col("doc_id") + 1).alias("also"))
    return G.apply_multilabel(base, also)


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def resume_antijoin(spark, d):
    return docs(spark, d).join(labels(spark, d), "doc_id", "left_anti").select("doc_id")


@query(f"with {GOLD} select distinct chunk_id from gold")
def labelled_chunks(spark, d):
    return gold(spark, d).select("chunk_id").distinct()


# ---------------------------------------------------------------- joins and windows


@query("select conv_id, turn, case when p_turn = turn - 1 then p end as previous_id, case when n_turn = turn + 1 then n end as next_id from (select conv_id, turn, lag(turn) over w as p_turn, lag(conv_id || ':' || turn) over w as p, lead(turn) over w as n_turn, lead(conv_id || ':' || turn) over w as n from conversations window w as (partition by conv_id order by turn))")
def neighbourhood(spark, d):
    c = load(spark, d, "conversations").select(F.col("conv_id").alias("source_doc"), F.col("turn").alias("chunk_index"), F.concat_ws(":", "conv_id", "turn").alias("chunk_id"))
    return G.neighbourhood(c).select(F.split("chunk_id", ":")[0].cast("long").alias("conv_id"), F.split("chunk_id", ":")[1].cast("long").alias("turn"), "previous_id", "next_id")


SENT = r"""sent as (select distinct doc_id as chunk_id, sentence from (select doc_id, trim(lower(unnest(string_split_regex(text, '[.!?:]\s+|\n+')))) as sentence from documents) where len(regexp_extract_all(sentence, '\S+')) >= 8)"""


@query(f"""with {GOLD}, {SENT}, c as (select g.qid, o.chunk_id, min({{'gold_id': g.chunk_id, 'sentence': s.sentence}}) as m from gold g join sent s on s.chunk_id = g.chunk_id join sent o on o.sentence = s.sentence where (g.qid, o.chunk_id) not in (select (qid, chunk_id) from gold) group by all)
 select qid, chunk_id, m.gold_id as gold_id, md5(m.sentence) as sentence from c""")
def multilabel_candidates(spark, d):
    s = docs(spark, d).select(F.col("doc_id").alias("chunk_id"), F.explode(F.split("text", "[.!?:]\\s+|\\n+")).alias("s")).select("chunk_id", F.trim(F.lower("s")).alias("sentence"))
    s = s.where(F.size(F.regexp_extract_all("sentence", F.lit("(\\S+)"), 1)) >= 8).distinct()
    out = G.multilabel_candidates(gold(spark, d).withColumnRenamed("chunk_id", "gold_id"), s)
    return out.select("qid", "chunk_id", "gold_id", F.md5("sentence").alias("sentence"))


@query(f"""with {GOLD}, pr as (select b.item_id as qid, b.text as q, d.text as p from benchmark b join (select qid, min(chunk_id) as c from gold group by qid) g on g.qid = b.item_id join documents d on d.doc_id = g.c),
 qw as (select qid, unnest(w) as w, generate_subscripts(w, 1) as i from (select qid, regexp_extract_all(lower(q), '[a-z0-9]+') as w from pr)), pw as (select qid, unnest(w) as w, generate_subscripts(w, 1) as i from (select qid, regexp_extract_all(lower(p), '[a-z0-9]+') as w from pr)),
 met as (select qid, qw.i as qi, pw.i - qw.i as d from qw join pw using (qid, w)), isl as (select qid, d, qi - row_number() over (partition by qid, d order by qi) as g from met),
 runs as (select qid, max(n) as n from (select qid, d, g, count(*) as n from isl group by all) group by qid) select pr.qid, coalesce(n, 0) as length, coalesce(n, 0) > 4 as fires from pr left join runs using (qid)""")
def longest_overlap(spark, d):
    g = gold(spark, d).groupBy("qid").agg(F.min("chunk_id").alias("doc_id"))
    pairs = questions(spark, d).join(g, "qid").join(docs(spark, d).select("doc_id", F.col("text").alias("passage")), "doc_id").select("qid", "question", "passage")
    return G.longest_overlap(pairs).select("qid", "length", (F.col("length") > G.LONGEST_RUN).alias("fires"))


@query("select case when d.verdict = l.verdict then 'agreed' when d.verdict = 'keep' then 'second-keeps' else 'first-keeps' end as kind, count(*) as n from (select doc_id, case when n_chars > 1000 then 'keep' else 'drop' end as verdict from documents) d join (select doc_id, case when quality = 1 then 'keep' else 'drop' end as verdict from labels) l using (doc_id) group by 1")
def dispute_queue(spark, d):
    a = docs(spark, d).select("doc_id", F.when(F.col("n_chars") > 1000, "keep").otherwise("drop").alias("b"))
    b = labels(spark, d).select("doc_id", F.when(F.col("quality") == 1, "keep").otherwise("drop").alias("a"))
    kind = F.when(F.col("a") == F.col("b"), "agreed").when(F.col("b") == "keep", "second-keeps").otherwise("first-keeps")
    return a.join(b, "doc_id").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select doc_id as chunk_id, {HEADED} as starts from documents order by not {HEADED}, {seeded('doc_id')} limit 40")
def sample_chunks(spark, d):
    rows = docs(spark, d).select(F.col("doc_id").alias("chunk_id"), G.starts_at_heading(F.col("text"), F.col("doc_id") % 7).alias("starts"))
    return G.sample_chunks(rows, 40, S.seed)


ALLOC = """sz as (select lang, count(*) as c, row_number() over (order by count(*), lang) as i, count(*) over () as k from documents group by lang),
 al as (with recursive r(i, used, lang, q) as (select 0::bigint, 0::bigint, ''::varchar, 0::bigint union all select sz.i, r.used + least(sz.c, ceil((50 - r.used) / (sz.k - r.i))::bigint), sz.lang, least(sz.c, ceil((50 - r.used) / (sz.k - r.i))::bigint) from r join sz on sz.i = r.i + 1) select lang, q from r where i > 0)"""


@query(f"with {ALLOC} select lang, q as quota from al")
def allocate(spark, d):
    return G.quotas(docs(spark, d), "lang", 50)


@query(f"with {ALLOC} select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by {seeded('doc_id')}) as p from documents) join al using (lang) where p <= q")
def stratified_sample(spark, d):
    return G.stratified_sample(docs(spark, d).select("doc_id", "lang"), "doc_id", "lang", 50, S.seed).select("doc_id", "lang")


CALIBRATED = f"j as (select conv_id, bool_or(length(text) > 300) as grounded from conversations where role = 'assistant' group by conv_id), c as (select count(*) as n, count(*) filter (grounded) as yes from j), t as (select least(20 - least(10, yes), n - yes) as no, yes from c)"


@query(f"with {CALIBRATED} select conv_id, grounded from (select conv_id, grounded, row_number() over (partition by grounded order by {seeded('conv_id')}) as place from j), t where place <= case when grounded then least(yes, 20 - no) else no end")
def calibration_queue(spark, d):
    """Twenty items, half of either verdict of the judge as far as they go."""
    j = load(spark, d, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.bool_or(F.length("text") > 300).alias("grounded"))
    return G.calibration_queue(j, "conv_id", "grounded", 20, S.seed, stratify=True)


SCREENED = "a as (select doc_id as qid, case when quality = 1 then 'keep' else 'drop' end as verdict from labels), b as (select doc_id as qid, case when n_chars > 1000 then 'keep' else 'drop' end as other from documents where lang in ('en', 'fr'))"


@query(f"with {SCREENED}, m as (select * from a join b using (qid)) select qid, 'disputed' as kind from m where verdict <> other union all select qid, 'control' from (select qid, row_number() over (order by {seeded("'control'", 'qid')}) as p from m where verdict = 'keep' and other = 'keep') where p <= 25")
def audit_queue(spark, d):
    """Every dispute of the two screeners and 25 rows that both keep."""
    a = labels(spark, d).select(F.col("doc_id").alias("qid"), F.when(F.col("quality") == 1, "keep").otherwise("drop").alias("verdict"))
    b = docs(spark, d).where("lang in ('en', 'fr')").select(F.col("doc_id").alias("qid"), F.when(F.col("n_chars") > 1000, "keep").otherwise("drop").alias("verdict"))
    return G.audit_queue(a, b, 25, S.seed)


# ---------------------------------------------------------------- splits and mining

GROUPS = f"{GOLD}, grp as (with recursive reach(qid, other) using key (qid, other) as (select distinct qid, qid from gold union select r.qid, b.qid from reach r join gold a on a.qid = r.other join gold b on b.chunk_id = a.chunk_id) select qid, min(other) as g from reach group by qid)".replace(" using key (qid, other)", "")


def groups(spark, d):
    return once(spark, d, "groups", lambda: G.shared_chunk_groups(gold(spark, d)))


@query(f'with {GROUPS} select qid, g as "group" from grp')
def shared_chunk_groups(spark, d):
    return groups(spark, d)


SPLIT = f"""{GROUPS}, sz as (select g, count(*) as n, row_number() over (order by -count(*), {seeded('g')}, g) as i from grp group by g), tot as (select sum(n)::bigint as t, round_even(sum(n) * 0.8, 0)::bigint as want from sz),
 f as (with recursive r(i, tr, te, g, n, split) as (select 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, ''::varchar union all
  select sz.i, r.tr + case when want - r.tr >= (t - want) - r.te then sz.n else 0 end, r.te + case when want - r.tr >= (t - want) - r.te then 0 else sz.n end, sz.g, sz.n, case when want - r.tr >= (t - want) - r.te then 'train' else 'test' end from r join sz on sz.i = r.i + 1, tot) select g, n, split from r where i > 0)"""


@query(f'with {SPLIT} select g as "group", n, split from f')
def grouped_split(spark, d):
    return G.grouped_split(groups(spark, d).groupBy("group").agg(F.count(F.lit(1)).alias("n")), 0.8, S.seed)


def split_gold(spark, d):
    side = G.grouped_split(groups(spark, d).groupBy("group").agg(F.count(F.lit(1)).alias("n")), 0.8, S.seed)
    return gold(spark, d).join(groups(spark, d), "qid").join(side.select("group", "split"), "group").select("qid", "chunk_id", "split")


@query(f"with {SPLIT}, s as (select qid, chunk_id, split from gold join grp using (qid) join f using (g)) select (select count(*) from (select chunk_id from s group by 1 having count(distinct split) > 1)) as shared_chunks, (select count(*) from (select qid from s group by 1 having count(distinct split) > 1)) as shared_questions")
def leakage_check(spark, d):
    s = split_gold(spark, d)
    G.check_no_shared_chunks(s)
    count = lambda c, n: s.groupBy(c).agg(F.countDistinct("split").alias("k")).agg(F.coalesce(F.sum((F.col("k") > 1).cast("long")), F.lit(0)).alias(n))
    return count("chunk_id", "shared_chunks").crossJoin(count("qid", "shared_questions"))


@query(f"select item_id as qid, row_number() over (order by {seeded('item_id')}) <= greatest(1, round_even(count(*) over () * 0.1, 0)) as held_out from benchmark")
def question_holdout(spark, d):
    q = questions(spark, d).select("qid")
    n = max(1, round(q.count() * 0.1))
    held = q.orderBy(T.seeded(S.seed, F.col("qid"))).limit(n).withColumn("h", F.lit(True))
    return q.join(held, "qid", "left").select("qid", F.coalesce("h", F.lit(False)).alias("held_out"))


@query("select 'both' as side, count(*) as n from (select doc_id from documents intersect select doc_id from labels) union all select 'unlabelled', count(*) from (select doc_id from documents except select doc_id from labels) union all select 'unknown', count(*) from (select doc_id from labels except select doc_id from documents)")
def set_ops_guard(spark, d):
    a, b = docs(spark, d).select("doc_id"), labels(spark, d).select("doc_id")
    one = lambda df, n: df.agg(F.lit(n).alias("side"), F.count(F.lit(1)).alias("n"))
    return one(a.intersect(b), "both").unionByName(one(a.subtract(b), "unlabelled")).unionByName(one(b.subtract(a), "unknown"))


MINED = f"mined as (select qid, chunk_id, rank from (select l.qid, l.chunk_id, l.rank, row_number() over (partition by l.qid order by {seeded('l.qid', 'l.chunk_id')}) as p from fused l where rank <= 20 and (l.qid, l.chunk_id) not in (select (qid, chunk_id) from gold)) where p <= 4)"


def mined(spark, d):
    found = rrf(arms(spark, d), S.rrf_k)
    return G.mine_negatives(found, hybrid_gold(spark, d, found), S.rerank_depth, 4, S.seed)


@query(f"with {HYBRID}, {MINED} select qid, chunk_id, rank::int as rank from mined")
def mine_negatives(spark, d):
    return mined(spark, d)


@query(f"""with {HYBRID}, {MINED}, po as (select qid, min(chunk_id) as chunk_id from gold group by qid), tp as (
 select po.qid, po.chunk_id, 1.0e0 as label, f.rank::int as fused_rank from po left join fused f on f.qid = po.qid and f.chunk_id = po.chunk_id and f.rank <= 20
 union all select qid, chunk_id, 0.0e0, rank::int from mined where qid in (select qid from gold)) select qid, chunk_id, md5(text) as text, label, fused_rank from tp join documents on doc_id = chunk_id""")
def training_pairs(spark, d):
    """A positive and the mined negatives of every question."""
    found = rrf(arms(spark, d), S.rrf_k)
    gold_of = hybrid_gold(spark, d, found).unionByName(positives(spark, d))
    out = G.training_pairs(found, gold_of, hybrid_texts(spark, d), S.rerank_depth, 4, S.seed)
    return out.withColumn("text", F.md5("text"))


@query(f"with {HYBRID}, {MINED} select m.chunk_id, list(distinct g.qid order by g.qid) as gold_of from mined m join gold g using (chunk_id) group by 1")
def mining_collisions(spark, d):
    """Negatives that are gold of another question: counted and reported, not dropped."""
    of = labelled(spark, d).where("label is not null").distinct()
    asked = of.where("chunk_id % 50 = 0").groupBy("label").agg(F.sort_array(F.collect_set("chunk_id")).alias("qids"))
    chunks = mined(spark, d).select("chunk_id").distinct().join(of, "chunk_id").join(asked, "label")
    return chunks.select("chunk_id", F.filter("qids", lambda q: q != F.col("chunk_id")).alias("gold_of")).where("size(gold_of) > 0")


@query(f"with {HYBRID}, {MINED} select count(*) as negatives, count(distinct chunk_id) as distinct_negatives, median(rank)::double as median_rank from mined")
def mining_report(spark, d):
    return mined(spark, d).agg(F.count(F.lit(1)).alias("negatives"), F.countDistinct("chunk_id").alias("distinct_negatives"), F.expr("percentile(rank, 0.5)").alias("median_rank"))


@query(f"with {HYBRID}, s as (select f.qid, max(f.score) filter (g.qid is not null) as p, max(f.score) filter (g.qid is null) as n from fused f left join gold g using (qid, chunk_id) group by 1) select count(*) as questions, round(avg((p > n)::int), 4) as share from s where p is not null and n is not null")
def positive_ranked_first(spark, d):
    found = rrf(arms(spark, d), S.rrf_k)
    s = found.join(hybrid_gold(spark, d, found).withColumn("gold", F.lit(True)), ["qid", "chunk_id"], "left")
    m = s.groupBy("qid").agg(F.max(F.when(F.col("gold"), F.col("score"))).alias("p"), F.max(F.when(F.col("gold").isNull(), F.col("score"))).alias("n")).where("p is not null and n is not null")
    return m.agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg((F.col("p") > F.col("n")).cast("int")), 4).alias("share"))


SAME = "regexp_replace(lower(regexp_replace({0}, '[\\s\\p{{Z}}]+', ' ', 'g')), '^ | $', '', 'g')".format
ASKED = f"""asked as (select item_id as qid, translate(text, 'abcdefgh', 'ABCDEFGH') || '  ' as question from benchmark union all select conv_id + 1000000, text from conversations where turn = 0),
 tr as (select distinct {SAME('text')} as t from benchmark where item_id % 5 <> 0), te as (select distinct {SAME('text')} as t from benchmark where item_id % 5 = 0),
 kinds as (select qid, question, case when te.t is not null then 'forbidden' when tr.t is not null then 'allowed' else 'unknown' end as kind from asked left join te on te.t = {SAME('question')} left join tr on tr.t = {SAME('question')})"""


def halves(spark, d):
    q = questions(spark, d)
    return q.where("qid % 5 <> 0"), q.where("qid % 5 = 0")


@query(f"with {ASKED} select qid, kind from kinds")
def leak_guard(spark, d):
    """What the guard says about questions of either split, in another spelling, and about questions of none."""
    talk = load(spark, d, "conversations").where("turn = 0").select((F.col("conv_id") + 1000000).alias("qid"), F.col("text").alias("question"))
    spelled = questions(spark, d).select("qid", F.concat(F.translate("question", "abcdefgh", "ABCDEFGH"), F.lit("  ")).alias("question"))
    return L.classified(spelled.unionByName(talk), *halves(spark, d)).select("qid", "kind")


@query(f"""with {GOLD}, pr as (select qid, b.text as question, case when chunk_id % 3 = 0 then '' else d.text end as text from gold join benchmark b on b.item_id = qid join documents d on d.doc_id = chunk_id)
 select 'test_qid' as fault, count(*) filter (qid % 5 = 0) as n from pr union all select 'unknown_qid', 0 from (select 1) union all
 select 'test_question', count(*) filter ({SAME('question')} in (select {SAME('text')} from benchmark where item_id % 5 = 0)) from pr union all select 'empty_text', count(*) filter (trim(text) = '') from pr""")
def pair_faults(spark, d):
    """The faults of pairs that hold both splits and whose every third text is missing."""
    text = F.when(F.col("chunk_id") % 3 == 0, "").otherwise(F.col("text"))
    pairs = gold(spark, d).join(questions(spark, d), "qid").join(docs(spark, d).select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id").select("qid", "question", "chunk_id", text.alias("text"))
    return L.pair_faults(pairs, *halves(spark, d))


@query(f"""with {GOLD}, s as (select qid, b.text as question, chunk_id, case when (qid + chunk_id) % 4 = 0 then 'test' else 'train' end as split from gold join benchmark b on b.item_id = qid)
 select (select count(*) from (select qid from s group by 1 having count(distinct split) > 1)) as shared_qids, (select count(*) from (select {SAME('question')} as t from s group by 1 having count(distinct split) > 1)) as shared_questions,
 (select count(*) from (select chunk_id from s group by 1 having count(distinct split) > 1)) as shared_chunks, 0::bigint as repeated_qids""")
def split_leaks(spark, d):
    """What a split by question and chunk would leak."""
    split = F.when((F.col("qid") + F.col("chunk_id")) % 4 == 0, "test").otherwise("train")
    return L.leaks(gold(spark, d).join(questions(spark, d), "qid").withColumn("split", split))


# ---------------------------------------------------------------- audits, judging, cost


@query("select count(*) as n, round(avg(((quality = 1) = (toxic = 0))::int), 6) as agreement, round(case when pc >= 1 then 0 else (po - pc) / (1 - pc) end, 6) as kappa from labels, (select avg(((quality = 1) = (toxic = 0))::int) as po, avg((quality = 1)::int) * avg((toxic = 0)::int) + (1 - avg((quality = 1)::int)) * (1 - avg((toxic = 0)::int)) as pc from labels) group by po, pc")
def cohens_kappa(spark, d):
    k = E.kappa(labels(spark, d).select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b")), "a", "b")
    return k.select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query("select event_type, count(*) as n, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events where value is not null group by 1")
def latency_percentiles(spark, d):
    e = load(spark, d, "events").where("value is not null")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.expr("percentile(value, 0.5)"), 6).alias("p50"), F.round(F.expr("percentile(value, 0.95)"), 6).alias("p95"))


@query("select round((sum(length(text)) filter (role = 'user') * 0.075e0 + sum(length(text)) filter (role = 'assistant') * 0.30e0) / 1e6 / count(distinct conv_id), 10) as usd from conversations")
def cost_per_query(spark, d):
    n = lambda role: F.sum(F.when(F.col("role") == role, F.length("text")))
    return load(spark, d, "conversations").agg(F.round((n("user") * 0.075 + n("assistant") * 0.30) / 1e6 / F.countDistinct("conv_id"), 10).alias("usd"))


@query("select case when quality = 1 then 'keep' else 'drop' end as verdict, count(*) as n, round(avg(((quality = 1) = (n_chars > 1000))::int), 4) as agreement from labels join documents using (doc_id) group by 1 union all select 'all', count(*), round(avg(((quality = 1) = (n_chars > 1000))::int), 4) from labels join documents using (doc_id)")
def audit_summary(spark, d):
    j = labels(spark, d).join(docs(spark, d).select("doc_id", "n_chars"), "doc_id")
    j = j.select(F.when(F.col("quality") == 1, "keep").otherwise("drop").alias("verdict"), ((F.col("quality") == 1) == (F.col("n_chars") > 1000)).cast("int").alias("agreed"))
    g = j.rollup("verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("agreed"), 4).alias("agreement"))
    return g.select(F.coalesce("verdict", F.lit("all")).alias("verdict"), "n", "agreement")


JUDGE = r"""turns as (select conv_id, turn, role, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as w from conversations),
 ctx as (select a.conv_id, a.turn, a.w, list_distinct(flatten(list(c.w))) as cw from turns a join turns c on c.conv_id = a.conv_id and c.turn < a.turn where a.role = 'assistant' group by all),
 judged as (select conv_id, turn, len(list_intersect(list_distinct(w), cw)) >= 0.2e0 * len(list_distinct(w)) as grounded from ctx)"""


def judged(spark, d):
    t = load(spark, d, "conversations").select("conv_id", "turn", "role", T.tokens(F.col("text")).alias("w"))
    a = t.where("role = 'assistant'").select("conv_id", "turn", F.array_distinct("w").alias("aw"))
    c = t.select("conv_id", F.col("turn").alias("before"), F.explode("w").alias("x"))
    # a word counts as seen from the turn after its first one: a row a word of the conversation, not one a turn
    first = c.groupBy("conv_id", "x").agg(F.min("before").alias("first"))
    start = c.groupBy("conv_id").agg(F.min("before").alias("start"))
    words = a.select("conv_id", "turn", F.size("aw").alias("n"), F.explode_outer("aw").alias("x"))
    hit = words.join(first, ["conv_id", "x"], "left").groupBy("conv_id", "turn", "n").agg(F.count_if(F.col("first") < F.col("turn")).alias("k"))
    return hit.join(start, "conv_id").where("start < turn").select("conv_id", "turn", (F.col("k") >= 0.2 * F.col("n")).alias("grounded"))


@query(f"with {JUDGE} select conv_id, turn, grounded from judged")
def groundedness(spark, d):
    return judged(spark, d)


@query(f"with {JUDGE} select count(*) as answers, count(*) filter (grounded) as grounded, round(avg(grounded::int), 4) as rate from judged")
def judge_summary(spark, d):
    return judged(spark, d).agg(F.count(F.lit(1)).alias("answers"), F.count_if("grounded").alias("grounded"), F.round(F.avg(F.col("grounded").cast("int")), 4).alias("rate"))


@query(f"with {JUDGE}, k as (select conv_id, turn, grounded, length(text) > 300 as human from judged join conversations using (conv_id, turn)) select count(*) filter (grounded and human) as both_yes, count(*) filter (grounded and not human) as judge_only, count(*) filter (human and not grounded) as human_only, count(*) filter (not human and not grounded) as both_no from k")
def calibration_score(spark, d):
    h = load(spark, d, "conversations").select("conv_id", "turn", (F.length("text") > 300).alias("h"))
    g, h_ = F.col("grounded"), F.col("h")
    return judged(spark, d).join(h, ["conv_id", "turn"]).agg(F.count_if(g & h_).alias("both_yes"), F.count_if(g & ~h_).alias("judge_only"), F.count_if(h_ & ~g).alias("human_only"), F.count_if(~g & ~h_).alias("both_no"))


@query()
def split_sentences(spark, d):
    return load(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", T.split_sentences(F.col("text")).alias("sentences"))


#: Replies that hold a turn's own text: said after the answer, or before it, on a line of its own.
SAID = "case length(text) % 4 when 0 then 'Yes, as ' || text when 1 then text || chr(10) || '  no - it does not' when 2 then 'NOTHING: ' || text else text end"


def said(c):
    """SAID as a column."""
    n = F.length(c) % 4
    return F.when(n == 0, F.concat(F.lit("Yes, as "), c)).when(n == 1, F.concat(c, F.lit("\n  no - it does not"))).when(n == 2, F.concat(F.lit("NOTHING: "), c)).otherwise(c)


@query(rf"select conv_id, turn, case upper(regexp_extract({SAID}, '(?im)^\s*(yes|no)([^\p{{L}}\p{{N}}_]|$)', 1)) when 'YES' then true when 'NO' then false end as fired from conversations")
def parse_judgement(spark, d):
    """Answers sought in whole replies, most of which is the conversation's text."""
    return load(spark, d, "conversations").select("conv_id", "turn", T.judgement(said(F.col("text"))).alias("fired"))


@query(r"""with r as (select conv_id, turn, case length(text) % 3 when 0 then 'none, as ' || text when 1 then text || ' (passage ' || length(text) % 10 || ')' else length(text) % 8 || '. ' || text end as reply from conversations),
 n as (select *, regexp_extract(reply, '\b([1-9])\b', 1) as digit from r) select conv_id, turn, case when digit <> '' and digit::int <= 5 and not contains(upper(reply[1:12]), 'NONE') then digit::int end as choice from n""")
def parse_label_choice(spark, d):
    """Numbers of passages before or after the conversation's text, and refusals."""
    n, c = F.length("text"), F.col("text")
    digit = lambda k: (n % k).cast("string")
    reply = F.when(n % 3 == 0, F.concat(F.lit("none, as "), c)).when(n % 3 == 1, F.concat(c, F.lit(" (passage "), digit(10), F.lit(")"))).otherwise(F.concat(digit(8), F.lit(". "), c))
    return load(spark, d, "conversations").select("conv_id", "turn", T.label_choice(reply, 5).alias("choice"))


@query(r"""with s as (select conv_id, turn, string_split(text, chr(10)) as l from conversations where role = 'assistant'),
 r as (select *, case when conv_id % 5 = 0 then 'no JSON object' when conv_id % 5 = 1 then 'another number of verdicts than sentences' end as error from s)
 select conv_id, turn, error, case when error is null then len(list_filter(l, lambda x: length(x) % 2 = 0)) end::int as supported, case when error is null then len(l) end::int as verdicts, case when error is null then md5(array_to_string(list_transform(l, lambda x: trim(x)), '|')) end as reasons from r""")
def parse_verdicts(spark, d):
    """A judge's replies about the lines of an answer, quoted as reasons: without JSON, with a verdict too few, and well formed within other text."""
    lines = F.split("text", "\n")
    rows = lambda l: F.to_json(F.struct(F.transform(l, lambda x: F.struct((F.length(x) % 2 == 0).alias("supported"), x.alias("reason"))).alias("verdicts")))  # noqa: E731, E741
    reply = F.when(F.col("conv_id") % 5 == 0, F.lit("I cannot say")).when(F.col("conv_id") % 5 == 1, rows(F.slice(lines, 1, F.size(lines) - 1))).otherwise(F.concat(F.lit("Sure: ```"), rows(lines), F.lit("``` done")))
    read = load(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", T.verdicts(reply, lines).alias("v"))
    reasons = F.md5(F.array_join(F.transform("v.verdicts", lambda x: x["reason"]), "|"))
    return read.select("conv_id", "turn", F.col("v.error").alias("error"), F.size(F.filter("v.verdicts", lambda x: x["supported"])).alias("supported"), F.size("v.verdicts").alias("verdicts"), reasons.alias("reasons"))


@query("select conv_id, md5(string_agg('[' || i || '] ' || text, chr(10) || chr(10) order by i)) as context from (select conv_id, text, row_number() over (partition by conv_id order by turn) as i from conversations) group by conv_id")
def format_context(spark, d):
    """The turns of a conversation as a judge's numbered passages."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return load(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("p")).select("conv_id", F.md5(T.format_context(F.col("p"))).alias("context"))


@query("select source, count(*) as n, greatest(1, count(*) // 1000)::int as lists from documents group by source")
def index_lists(spark, d):
    sizes = docs(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("source", "n", F.greatest(F.lit(1), F.floor(F.col("n") / I.LIST_ROWS)).cast("int").alias("lists"))
