"""Payloads, indexing, recommendations, labels and robustness over the driver's tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import records
from pairloom.functions.text import VIETNAMESE, VIETNAMESE_PLAIN
from pairloom.operators import chunking, indexing, recommend, robustness, store, structured
from pairloom.operators.acl import parsed_vector_id
from pairloom.operators.bm25 import bm25
from pairloom.operators.matching import most_similar, section_pairs
from pairloom.operators.ranking import global_hybrid as over_all_pairs
from pairloom.operators.ranking import ranked
from pairloom.operators.staging import remove_at_exit, shared_folder, staged
from pairloom.plans.registry import query, table
from pairloom.plans.evaluations import RUN, metrics
from pairloom.plans.hybrids import WANT_SQL, best_covering, offers, ranges, wants
from pairloom.plans.lexical import BM25_SQL
from pairloom.plans.logs import ACL_SQL, SEEN, acl_rows
from pairloom.plans.vectors import COS, LEXICAL, RANK, SEMANTIC, SIMS, knn, sides, vectors

# ---- payloads


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_custkey, json: a customer's orders as the skills and the work of a profile, as a model would write them."""
    o, end = table(spark, sf_dir, "orders"), F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 900).cast("int"))
    o = o.select("o_custkey", F.struct("o_orderkey", F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), F.date_format("o_orderdate", "yyyy-MM").alias("a"), F.date_format(end, "yyyy-MM").alias("z")).alias("x"))
    g = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list("x")).alias("x"))
    skill = F.transform("x", lambda x: F.struct(x["p"].alias("name"), F.lit(0.9).alias("confidence"), x["p"].alias("evidence"), (x["o_orderkey"] % 13).alias("proficiency_level")))
    work = F.transform("x", lambda x: F.struct(x["p"].alias("title"), x["s"].alias("company"), x["a"].alias("start_date"), F.when(x["o_orderkey"] % 3 == 0, "Present").otherwise(x["z"]).alias("end_date")))
    low = F.struct(F.when(F.col("o_custkey") % 2 == 0, (F.col("o_custkey") * 10).cast("string")).alias("min"), F.lit("EUR").alias("currency"))
    return g.select("o_custkey", F.to_json(F.struct(skill.alias("skills"), work.alias("experience"), low.alias("expected_budget"), F.create_map(F.lit("place"), F.lit("home"), F.lit("shift"), F.lit(None).cast("string")).alias("preferences"))).alias("json"))


@query("""with x as (select *, row_number() over (partition by o_custkey order by o_orderkey) as nth from orders),
g as (select o_custkey, count(distinct o_orderpriority)::int as skills, least(count(*), 20)::int as experience, sum((nth <= 20 and o_orderkey % 3 = 0)::int)::int as current, count(*) as n from x group by 1),
c as (select o_custkey, round(sum(case when p in ('1-URGENT', '2-HIGH') then 0.9 else 0.3 end), 6)::double as confidence from (select distinct o_custkey, o_orderpriority as p from orders) group by 1)
select o_custkey, skills, experience, current, confidence, '[' || case when n > 20 then '"LIMIT_EXPERIENCE_TRIMMED",' else '' end || '"EMPTY_SECTION:education","EMPTY_SECTION:projects"]' as warnings from g join c using (o_custkey)""")
def payload_cv(spark, sf_dir):
    """Profiles brought to their schema: skills once, with evidence; work cut to its limit; warnings."""
    raw = payloads(spark, sf_dir).select("o_custkey", records.parsed(F.col("json"), records.CV).alias("raw"))
    n = raw.select("o_custkey", records.normalized_cv(F.col("raw"), F.lit("worked on 1-URGENT and on 2-HIGH")).alias("n"))
    total = F.aggregate("n.payload.skills", F.lit(0.0), lambda a, x: a + x["confidence"])
    current = F.size(F.filter("n.payload.experience", lambda x: x["is_current"]))
    return n.select("o_custkey", F.size("n.payload.skills").alias("skills"), F.size("n.payload.experience").alias("experience"), current.alias("current"), F.round(total, 6).alias("confidence"), F.to_json("n.warnings").alias("warnings"))


@query("""with x as (select o_custkey, o_orderkey, year(o_orderdate) * 12 + month(o_orderdate) as a, o_orderdate + to_days((o_orderkey % 900)::int) as z from orders),
s as (select o_custkey, case when o_orderkey % 3 = 0 then 2024 * 12 + 6 else year(z) * 12 + month(z) end - a as m from x)
select o_custkey, count(*)::int as skills, round(sum(case when m > 0 then m end) / 12.0::double, 2) as years, case when o_custkey % 2 = 0 then o_custkey * 10.0::double end as budget_min, 1 as preferences from s group by o_custkey""")
def payload_profile(spark, sf_dir):
    """The records that scoring reads: skills, years added up from the work, the expected budget, preferences that say something."""
    raw = payloads(spark, sf_dir).select("o_custkey", records.parsed(F.col("json"), records.CV).alias("raw"))
    p = raw.select("o_custkey", records.profile(F.col("raw"), "2024-06").alias("p"))
    return p.select("o_custkey", F.size("p.skills").alias("skills"), "p.years", F.col("p.budget.min").alias("budget_min"), F.size("p.preferences").alias("preferences"))


@query("""select doc_id, case when doc_id % 4 = 2 then 'DOCUMENT_TYPE_INVALID' when doc_id % 1001 = 0 then 'VERSION_INVALID' when lang = 'de' then 'VISIBILITY_INVALID' when doc_id % 4 = 1 and length(trim(coalesce(text, ''))) < 10 then 'JD_TEXT_REQUIRED'
when doc_id % 4 in (0, 3) and length(trim(coalesce(text, ''))) < 10 then 'CV_SOURCE_REQUIRED' end as error from documents""")
def job_inputs(spark, sf_dir):
    """Why a document would be refused for processing."""
    i = F.col("doc_id")
    kind = F.element_at(F.array(F.lit("cv"), F.lit(" JD"), F.lit("xx"), F.lit("CV")), (i % 4 + 1).cast("int"))
    error = records.job_input_error(kind, i.cast("string"), (i % 1001).cast("int"), F.when(F.col("lang") == "de", "friends").otherwise(" Public "), F.col("text"), F.lit(False))
    return table(spark, sf_dir, "documents").select("doc_id", error.alias("error"))


@query("""with d as (select doc_id, text, len(regexp_extract_all(text, '[A-Z][a-z]{7,}'))::int as skills from documents) select doc_id, skills from d where length(trim(text)) > 80 and skills > 0 order by doc_id limit 30""")
def query_selection(spark, sf_dir):
    """The first thirty documents that can ask: enough text, any skill."""
    d = table(spark, sf_dir, "documents").withColumn("skills", F.regexp_extract_all("text", F.lit("[A-Z][a-z]{7,}"), F.lit(0)))
    return robustness.asking(d, "doc_id", 30).select("doc_id", F.size("skills").alias("skills"))


# ---- indexing


@query("""with d as (select doc_id, case when doc_id % 3 = 0 then 'jd' else 'cv' end as doc_type, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t, length(text) // 2 as n, text from documents where text is not null),
s as (select doc_id, doc_type, '_full' as section, t from d union all select doc_id, doc_type, 'experience', regexp_replace(substr(text, 1, n), '^\\s+|\\s+$', '', 'g') from d union all select doc_id, doc_type, 'skills', regexp_replace(substr(text, n + 1), '^\\s+|\\s+$', '', 'g') from d)
select doc_type || ':' || doc_id || ':v1:' || section as vector_id, doc_id::varchar as doc_id, section, sha256(t) as content_hash, 'hash' as embedding_model from s where t <> ''""")
def index_documents(spark, sf_dir):
    """Documents in two sections and as a whole, embedded and put into a new store; what the store then holds."""
    n = F.floor(F.length("text") / 2).cast("int")
    part = lambda name, t: F.struct(F.lit(name).alias("name"), t.alias("text"), F.lit(name).alias("heading_raw"), F.lit(0).alias("ord"))
    sections = F.create_map(F.lit("experience"), part("experience", F.col("text").substr(F.lit(1), n)), F.lit("skills"), part("skills", F.col("text").substr(n + 1, F.length("text"))))
    d = table(spark, sf_dir, "documents").filter("text is not null")
    d = d.select(F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("doc_id") % 3 == 0, "jd").otherwise("cv").alias("doc_type"), "lang", F.col("text").alias("raw_text"), sections.alias("sections"))
    where = shared_folder(spark)
    kept = store.SnapshotStore(spark, f"{where}/vectors")
    indexing.index_corpus(kept, d, chunking.embedder("hash"), "hash")
    remove_at_exit(spark, where)
    parts = parsed_vector_id(F.col("vector_id"))
    return kept.current().select("vector_id", parts["doc_id"].alias("doc_id"), "section", "content_hash", "embedding_model")


# ---- recommendations


@query(f"""with {ACL_SQL}, s as (select a.vec_id as query_id, b.vec_id // 4 as doc_id, round(1 - {COS}, 6) as distance from embeddings a join embeddings b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
n as (select *, row_number() over (partition by query_id order by distance, doc_id) as nth from s), p as (select query_id, doc_id, round(least(1, greatest(0, 1 - min(distance))), 6) as score from n where nth <= 60 group by all),
g as (select p.* from p join acl using (doc_id) where doc_type in ('cv', 'jd') and {SEEN})
select * from (select query_id, doc_id, score, {RANK} from g) where rank <= 5""")
def recommend_pool(spark, sf_dir):
    """A pool of the nearest documents, cut to what user u3 may see, and then to five."""
    s = knn(spark, sf_dir, 60)
    hits = s.select("query_id", F.floor(F.col("doc_id") / 4).cast("long").alias("doc_id"), (F.col("doc_id") % 4).cast("int").alias("version"), F.round(1 - F.col("score"), 6).alias("distance"))
    return recommend.recommend(hits, 20, 5, rows=acl_rows(spark, sf_dir), user="u3").select("query_id", "doc_id", "score", "rank")


@query(f"""with {WANT_SQL}, r as (select * from (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from cov) where rank <= 5),
w as (select query_id, list_sort(list(brand))[1:12] as want from want group by 1), o as (select doc_id, list(brand) as have from offer group by 1)
select query_id, doc_id, rank, case when rank <= 3 then len(list_filter(want, lambda x: list_contains(have, x))) || ' of ' || len(want) || ' wanted skills' end as summary from r join w using (query_id) join o using (doc_id)""")
def explained_topn(spark, sf_dir):
    """Rankings by coverage whose first three rows say what is covered."""
    asked, (held, sets) = wants(spark, sf_dir), ranges(spark, sf_dir)
    want = asked.groupBy("query_id").agg(F.sort_array(F.collect_list("brand")).alias("want"))
    have = held.select("doc_id", F.col("brands").alias("payload"))

    def explain(rows: DataFrame) -> DataFrame:
        return rows.join(want, "query_id").withColumn("explanation", recommend.template(F.col("payload"), F.col("want")))

    r = recommend.attach(best_covering(asked, held, sets, 5), have, 3, explain)
    return r.select("query_id", "doc_id", "rank", F.col("explanation.summary").alias("summary"))


# ---- scores and labels


@query(f"""with {BM25_SQL}, {SEMANTIC}, {LEXICAL}, b as (select sem.query_id, sem.doc_id, sem.score as a, kw.score as b from sem join kw on sem.query_id = kw.query_id and sem.doc_id = kw.doc_id),
e as (select min(a) as la, max(a) as ha, min(b) as lb, max(b) as hb from b), s as (select query_id, doc_id, round(0.6 * (a - la) / (ha - la + 1e-8) + 0.4 * (b - lb) / (hb - lb + 1e-8), 6) as score from b, e)
select * from (select query_id, doc_id, score, {RANK} from s) where rank <= 10""")
def global_hybrid(spark, sf_dir):
    """Semantic and keyword scores of the pairs that have both, each scaled over all pairs."""
    return ranked(over_all_pairs(*sides(spark, sf_dir)).withColumn("score", F.round("score", 6)), 10)


@query(f"""with {SIMS}, n as (select query_doc as query_id, doc_id, section, sim, case section when 'skills' then 0.4 when 'experience' then 0.35 when 'education' then 0.15 else 0.1 end as w from pairs where query_section = 'summary'),
s as (select query_id, doc_id, round(0.6 * sum(w * sim) / sum(w) + 0.4 * max(case when section = 'summary' then sim end), 6) as score from n group by all having max(case when section = 'summary' then sim end) is not null)
select * from (select query_id, doc_id, score, {RANK} from s) where rank <= 10""")
def flat_scores(spark, sf_dir):
    """A query as a whole against a candidate's sections and its summary."""
    v = vectors(spark, sf_dir)
    asked = v.filter("doc_id % 25 = 0 and section = 'summary'")
    sims = section_pairs(asked, v).select(F.col("query_doc").alias("query_id"), "doc_id", "section", "sim")
    dense = most_similar(asked, v.filter("section = 'summary'"))
    return ranked(robustness.flat_score(sims, dense).withColumn("score", F.round("score", 6)), 10)


def hit_counts(q: structured.Columns, d: structured.Columns, products: list[np.ndarray]) -> structured.Columns:
    """How many offering rows have just so many hits and years, of those with any hit."""
    hit, opt = (p.astype(np.int64) for p in products)
    known, year = np.unique(d["years"][0], return_inverse=True)
    shape = (len(hit), int(hit.max(initial=0)) + 1, int(opt.max(initial=0)) + 1, len(known))
    code = np.ravel_multi_index((np.arange(len(hit))[:, None], hit, opt, year[None, :]), shape).ravel()
    if np.prod(shape) <= 8 * structured.TILE:
        alike = np.bincount(code)
        code = np.nonzero(alike)[0]
        alike = alike[code]
    else:
        code, alike = np.unique(code, return_counts=True)
    row, hits, opt_hit, year = np.unravel_index(code, shape)
    row, hits, opt_hit, year, alike = (x[hits + opt_hit > 0] for x in (row, hits, opt_hit, year, alike))
    return {"query_id": q["query_id"][row, 0], "hit": hits, "opt_hit": opt_hit, "years": known[year], "alike": alike}


@query(f"""with {WANT_SQL}, m as (select query_id, doc_id, count(*) filter (weight >= 2) as hit, count(*) filter (weight < 2) as opt_hit from want join offer using (brand) group by all),
n as (select query_id, count(*) filter (weight >= 2) as req, count(*) filter (weight < 2) as opt from want group by 1),
g as (select m.query_id, doc_id, greatest(case when req > 0 then hit / req::double else 1 end, (hit + 0.5 * opt_hit) / (req + opt)::double) as best, s_nationkey % 9 > 0 and c_nationkey % 7 > 0 and s_nationkey % 9 < c_nationkey % 7 as short
from m join n using (query_id) join supplier on s_suppkey = doc_id join customer on c_custkey = query_id)
select query_id, (case when best >= 0.75 and not short then 3 when best >= 0.45 then 2 when best >= 0.2 then 1 else 0 end)::int as grade, count(*) as documents from g group by all""")
def skill_grades(spark, sf_dir):
    """Grades of customers and suppliers that share a brand, by required and optional brands and by years."""
    must, t = F.col("weight") >= 2, lambda n: table(spark, sf_dir, n)
    count = lambda c, name: F.sum(c.cast("long")).alias(name)
    targets = F.collect_list(F.struct(F.col("brand").alias("name"), must.cast("double").alias("must"), (~must).cast("double").alias("may")))
    n = staged(wants(spark, sf_dir).groupBy("query_id").agg(count(must, "req"), count(~must, "opt"), targets.alias("targets")))
    years = t("supplier").select(F.col("s_suppkey").alias("doc_id"), F.coalesce(F.col("s_nationkey") % 9, F.lit(0)).cast("long").alias("years"))
    held = staged(offers(spark, sf_dir).groupBy("doc_id").agg(F.collect_list("brand").alias("names")).join(years, "doc_id").select("names", "years"))
    m = structured.reduced(n.select("query_id", "targets"), held, hit_counts, "query_id long, hit long, opt_hit long, years long, alike long")
    need = t("customer").select(F.col("c_custkey").alias("query_id"), (F.col("c_nationkey") % 7).alias("need"))
    j = m.groupBy("query_id", "hit", "opt_hit", "years").agg(F.sum("alike").alias("alike")).join(n.drop("targets"), "query_id").join(need, "query_id")
    g = robustness.grade(*[F.col(c) for c in ("req", "hit", "opt", "opt_hit", "years", "need")], F.lit(0), F.lit(0))
    return j.select("query_id", g.alias("grade"), "alike").groupBy("query_id", "grade").agg(F.sum("alike").alias("documents"))


PLAIN_SQL = BM25_SQL.replace("lower(text)", f"translate(lower(text), '{VIETNAMESE}', '{VIETNAMESE_PLAIN}')")


@query(f"""with one as (select query_id, max(score) as before from (with {BM25_SQL} select query_id, round(score, 4) as score from bm) group by 1), two as (select query_id, max(score) as after from (with {PLAIN_SQL} select query_id, round(score, 4) as score from bm) group by 1)
select query_id, before, after, round((after - before) / before, 6) as change from one join two using (query_id)""")
def accent_robustness(spark, sf_dir):
    """How much a passage's best score changes when all texts lose their accents."""
    docs, asked = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    best = lambda d, q: bm25(d, q).groupBy("query_id").agg(F.round(F.max("score"), 4).alias("score"))
    change = robustness.relative_change(best(docs, asked), best(*[robustness.unaccented(x.withColumn("text", F.lower("text"))) for x in (docs, asked)]), "query_id", "score")
    return change.withColumn("change", F.round("change", 6))


@query(f"""with {RUN} select (label % 3)::int as slice, round(avg(ndcg), 4) as ndcg, round(avg(precision), 4) as precision, round(avg(recall), 4) as recall, round(avg(rr), 4) as rr, round(avg(ap), 4) as ap, count(*) as queries from m join embeddings on vec_id = query_id group by 1""")
def slice_metrics(spark, sf_dir):
    """Mean metrics of the queries of each slice."""
    slices = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), (F.col("label") % 3).cast("int").alias("slice"))
    return robustness.by_slice(metrics(spark, sf_dir), slices)
