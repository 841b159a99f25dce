"""Sources and sinks by round trip, and the small functions that scoring is made of, each over a whole table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import dates, hybrid, payload, text
from pairloom.operators import acl, jobs, ranking, sections, statistics, store
from pairloom.operators.staging import remove_at_exit, shared_folder
from pairloom.plans.registry import query, table
from pairloom.plans.logs import STORE_SQL, stored_and_new
from pairloom.sources import io, portable


def folder(spark: SparkSession) -> str:
    return shared_folder(spark)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with a text in the engine's own schema, the text halved into two sections."""
    n = F.floor(F.length("text") / 2).cast("int")
    part = lambda name, t: F.struct(F.lit(name).alias("name"), t.alias("text"), F.lit(name).alias("heading_raw"), F.lit(0).alias("ord"))
    halves = F.create_map(F.lit("experience"), part("experience", F.col("text").substr(F.lit(1), n)), F.lit("skills"), part("skills", F.col("text").substr(n + 1, F.length("text"))))
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.select(F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("doc_id") % 3 == 0, "jd").otherwise("cv").alias("doc_type"), "lang", F.col("text").alias("raw_text"), halves.alias("sections"), F.lit("1.0.0").alias("schema_version"))


# ---- sources and sinks


@query("select doc_id::varchar as doc_id, case when doc_id % 3 = 0 then 'jd' else 'cv' end as doc_type, lang, sha256(text) as hash, 2 as sections from documents where text is not null")
def jsonl_documents(spark, sf_dir):
    """Documents written as JSON lines and read back with their guards."""
    where = folder(spark)
    io.write_jsonl(corpus(spark, sf_dir), f"{where}/documents")
    remove_at_exit(spark, where)
    return io.read_documents(spark, f"{where}/documents").select("doc_id", "doc_type", "lang", F.sha2("raw_text", 256).alias("hash"), F.size("sections").alias("sections"))


@query("select doc_id::varchar as cv_id, (quality * 2 + toxic)::varchar as jd_id, (quality * 3 - toxic)::int as label from labels")
def jsonl_pairs(spark, sf_dir):
    """Labelled pairs written as JSON lines and read back; a label outside -1 to 3 would be an error."""
    where = folder(spark)
    p = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("cv_id"), (F.col("quality") * 2 + F.col("toxic")).cast("string").alias("jd_id"), (F.col("quality") * 3 - F.col("toxic")).cast("int").alias("label"))
    io.write_jsonl(p, f"{where}/pairs")
    remove_at_exit(spark, where)
    return io.read_pairs(spark, f"{where}/pairs")


@query("select c_nationkey::varchar as jd_id, count(*)::int as cvs, sum(c_custkey % 4)::bigint as relevance from customer group by 1")
def jsonl_queries(spark, sf_dir):
    """Queries with lists of candidates and relevance, written and read back."""
    where = folder(spark)
    g = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("jd_id")).agg(F.collect_list(F.struct(F.col("c_custkey").cast("string").alias("c"), (F.col("c_custkey") % 4).cast("int").alias("r"))).alias("x"))
    io.write_jsonl(g.select("jd_id", F.col("x.c").alias("cv_ids"), F.col("x.r").alias("relevance")), f"{where}/queries")
    remove_at_exit(spark, where)
    q = io.read_queries(spark, f"{where}/queries")
    return q.select("jd_id", F.size("cv_ids").alias("cvs"), F.aggregate("relevance", F.lit(0).cast("long"), lambda a, x: a + x).alias("relevance"))


@query("""with p as (select * from (values ('No Fit', 0), ('Potential Fit', 1), ('Good Fit', 2)) t(l, g)), r as (select c_mktsegment as job, 'resume, "of" ' || c_nationkey as cv, (c_custkey % 3)::int as grade from customer)
select grade, count(*) as rows, count(distinct job) as jobs, count(distinct cv) as cvs from r group by grade""")
def csv_pairs(spark, sf_dir):
    """Labelled texts in a CSV with quotes and commas; ids number the distinct texts."""
    where = folder(spark)
    label = F.element_at(F.array(F.lit("No Fit"), F.lit("Potential Fit"), F.lit("Good Fit")), (F.col("c_custkey") % 3 + 1).cast("int"))
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("job_description_text"), F.concat(F.lit('resume, "of" '), F.col("c_nationkey").cast("string")).alias("resume_text"), label.alias("label"))
    c.write.option("header", True).option("escape", '"').csv(f"{where}/pairs")
    remove_at_exit(spark, where)
    return io.read_pair_csv(spark, f"{where}/pairs").groupBy("grade").agg(F.count("*").alias("rows"), F.countDistinct("jd_id").alias("jobs"), F.countDistinct("cv_id").alias("cvs"))


@query("select o_orderkey as id from orders where o_orderpriority <> '1-URGENT' and o_orderstatus <> 'O' and o_totalprice > 1000")
def export_open_jobs(spark, sf_dir):
    """Jobs that are not deleted, say something and are in no skipped status."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") == "1-URGENT", "2024-01-01").alias("deletedAt"), F.when(F.col("o_totalprice") > 1000, "text").otherwise(" ").alias("description"), F.when(F.col("o_orderstatus") == "O", "DRAFT").otherwise("OPEN").alias("status"))
    return io.export_jobs(o).select("id")


@query("select 'tables' as name, 2 as tables, (select count(*) from nation) + (select count(*) from region) as rows")
def table_inspector(spark, sf_dir):
    """Columns and rows of registered tables."""
    for name in ("nation", "region"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return io.inspect(spark, ["nation", "region"]).agg(F.lit("tables").alias("name"), F.count("*").cast("int").alias("tables"), F.sum("rows").alias("rows"))


@query("select doc_id::varchar as doc_id, 'documents:' || doc_id as source, case when text is null then 'no text' else '' end as note from documents")
def export_manifest(spark, sf_dir):
    """Which row of a database each document comes from, written and read back."""
    where = folder(spark)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").alias("id"), F.when(F.col("text").isNull(), "no text").otherwise("").alias("note"))
    io.write_manifest(d, "documents", f"{where}/manifest")
    remove_at_exit(spark, where)
    return io.read_manifest(spark, f"{where}/manifest")


# ---- access and store


@query("select 'cv_' || c_custkey as doc_id, 'READY' as status, case when c_nationkey % 5 = 0 then 'public' else lower(c_mktsegment) end as visibility from customer")
def profile_acl_rows(spark, sf_dir):
    """Access rows of profiles; a missing visibility is public."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 5 != 0, F.lower("c_mktsegment")).alias("visibility"), F.lit("u1").alias("owner_id"), F.lit(None).cast("string").alias("deleted_at"))
    return acl.profile_acl(c).select("doc_id", "status", "visibility")


@query("select case event_id % 3 when 0 then 'cv_' else 'jd_' end || event_id as doc_id, case event_id % 3 when 0 then 'cv' else 'jd' end as doc_type, event_id as number from events where event_id % 3 < 2")
def doc_id_parse(spark, sf_dir):
    """Types and numbers out of ids; malformed ones go."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(F.concat(F.when(i % 3 == 0, "cv_").when(i % 3 == 1, "jd_").otherwise("x-"), i.cast("string")).alias("doc_id"))
    return acl.parsed_ids(e)


@query("""with d as (select doc_id::varchar as doc_id, text, length(text) // 2 as n from documents where text is not null),
s as (select doc_id, '_full' as section, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t from d union all select doc_id, 'experience', regexp_replace(substr(text, 1, n), '^\\s+|\\s+$', '', 'g') from d union all select doc_id, 'skills', regexp_replace(substr(text, n + 1), '^\\s+|\\s+$', '', 'g') from d)
select doc_id, section, length(t)::int as chars from s where t <> ''""")
def section_projection(spark, sf_dir):
    """The texts that are embedded: non-blank sections and the whole."""
    return sections.section_texts(corpus(spark, sf_dir)).select("doc_id", "section", F.length("text").alias("chars"))


@query(f"with {STORE_SQL}, v as (select doc_type, doc_id, version, bool_and(section <> 'summary') as ready from stored group by all) select doc_type, doc_id, version from v where ready and doc_id % 3 > 0")
def index_present(spark, sf_dir):
    """Versions whose vectors are all ready and whose payload is there."""
    old, _ = stored_and_new(spark, sf_dir)
    old = old.withColumn("status", F.when(F.col("section") == "summary", "PROCESSING").otherwise("READY"))
    return store.indexed(old, old.select("doc_type", "doc_id", "version").distinct().filter("doc_id % 3 > 0"))


@query(f"with {STORE_SQL} select section, count(*) as rows from stored where doc_type = 'cv' and version = 3 group by section")
def vector_point_read(spark, sf_dir):
    """A store written, opened again by its path, and read by type and version."""
    where = folder(spark)
    old, _ = stored_and_new(spark, sf_dir)
    full = old.select(acl.vector_id(F.col("doc_type"), F.col("doc_id").cast("string"), F.col("version"), F.col("section")).alias("vector_id"), "doc_type", F.col("doc_id").cast("string").alias("doc_id"), F.col("version").cast("int").alias("version"), "section")
    blank = {"embedding": F.lit(None).cast("array<float>"), **{c: F.lit("") for c in ("text", "status", "visibility", "owner_id", "language", "embedding_model", "content_hash")}}
    store.SnapshotStore(spark, where).write(full.withColumns(blank))
    remove_at_exit(spark, where)
    return store.SnapshotStore(spark, where).current().filter("doc_type = 'cv' and version = 3").groupBy("section").agg(F.count("*").alias("rows"))


# ---- scoring pieces


@query("""with s as (select o_custkey as query_id, o_orderkey as doc_id, floor(o_totalprice::double / 50000)::int as score from orders) select query_id, doc_id, score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, doc_id desc) as rank from s) where rank <= 3""")
def stable_order(spark, sf_dir):
    """The three best by score alone, ties in the order of their source."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.floor(F.col("o_totalprice").cast("double") / 50000).cast("int").alias("score"))
    return ranking.stable_ranked(o.withColumn("ordinal", -F.col("doc_id")), "ordinal", 3).drop("ordinal")


@query("select r_regionkey as id, ((r_regionkey * 3) % 5)::int as fold from region")
def fold_split(spark, sf_dir):
    """Five folds over a permutation: the region at place p is 2p modulo 5, so its fold is 3 times its key modulo 5."""
    return statistics.folds(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id")), [2 * i % 5 for i in range(5)])


@query("select round(avg(abs(quality - toxic)), 6) as mean_change, max(abs(quality - toxic))::double as max_change, round(avg((quality = toxic)::int), 6) as unchanged from labels")
def score_invariance(spark, sf_dir):
    """How far two columns of scores differ."""
    return statistics.invariance(table(spark, sf_dir, "labels"), "quality", "toxic").select(F.round("mean_change", 6).alias("mean_change"), F.col("max_change").cast("double").alias("max_change"), F.round("unchanged", 6).alias("unchanged"))


@query("select event_id, case when event_id % 3 = 2 then 100 else case event_type when 'signup' then 5 when 'view' then 25 when 'click' then 55 when 'purchase' then 85 else 0 end end::int as progress from events")
def job_progress(spark, sf_dir):
    """How far a job is, by its status and step."""
    t = F.col("event_type")
    step = F.when(t == "signup", "QUEUED").when(t == "view", "EXTRACTING").when(t == "click", "PARSING").when(t == "purchase", "INDEXING").otherwise("OTHER")
    return table(spark, sf_dir, "events").select("event_id", jobs.progress(F.when(F.col("event_id") % 3 == 2, "READY").otherwise("PROCESSING"), step).alias("progress"))


@query("select c_custkey, greatest(c_nationkey, c_custkey % 50)::double as years from customer")
def years_stated(spark, sf_dir):
    """The largest number of years in a text."""
    t = F.concat(F.col("c_nationkey").cast("string"), F.lit(" years here and "), (F.col("c_custkey") % 50).cast("string"), F.lit(" năm there, 99 problems"))
    return table(spark, sf_dir, "customer").select("c_custkey", hybrid.years_in(t).alias("years"))


@query("select p_partkey, len(list_distinct(list_filter(list_transform(string_split(replace(lower(p_name), ' ', ','), ','), lambda x: trim(x)), lambda x: x <> '')))::int as skills from part")
def skills_listed(spark, sf_dir):
    """Skills of a list with two separators."""
    return table(spark, sf_dir, "part").select("p_partkey", F.size(hybrid.skill_list(F.concat(F.replace("p_name", F.lit(" "), F.lit(";")), F.lit(",, ;")))).alias("skills"))


@query("""select s_suppkey, round(case s_suppkey % 3 when 0 then 1 when 1 then 0.8 * (2.0 / 3) + 0.2 * 0 else 0.25 end::double, 6) as score from supplier""")
def skills_scored(spark, sf_dir):
    """Required and optional skills: neither, both, optional alone."""
    skill = lambda *names: F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), F.lit(1).alias("level")) for n, w in names]) if names else F.array().cast("array<struct<name:string,weight:double,level:int>>")
    case = lambda a, b, c: F.when(F.col("s_suppkey") % 3 == 0, a).when(F.col("s_suppkey") % 3 == 1, b).otherwise(c)
    have = skill(("ReactJS", 1), ("golang", 1))
    required, optional = case(skill(), skill(("react", 2), ("rust", 1)), skill()), case(skill(), skill(("vue", 1)), skill(("go", 1), ("c", 3)))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(hybrid.skills_score(have, required, optional), 6).alias("score"))


@query("select event_id, case when event_type in ('view', 'click') then true else false end as current, case when event_id % 2500 between 1950 and 2100 then (event_id % 2500)::double end as year from events")
def markers_and_years(spark, sf_dir):
    """Words for an open end, and years within bounds."""
    word = F.when(F.col("event_type") == "view", " Present ").when(F.col("event_type") == "click", "Hiện tại").otherwise("2020")
    return table(spark, sf_dir, "events").select("event_id", dates.is_current(word).alias("current"), dates.to_year((F.col("event_id") % 2500).cast("string")).cast("double").alias("year"))


@query("select doc_id, left('PARSING: ' || lang || ': ' || coalesce(text, ''), 2000) as error from documents where lang is not null and text is not null")
def error_texts(spark, sf_dir):
    """Errors as one text of at most 2,000 characters."""
    return table(spark, sf_dir, "documents").filter("lang is not null and text is not null").select("doc_id", text.format_error(F.lit("PARSING"), F.col("lang"), F.col("text")).alias("error"))


@query("select event_id, case event_id % 4 when 3 then null else json_extract_string(props, '$.k') end as k from events")
def salvaged_replies(spark, sf_dir):
    """JSON out of a model's reply: bare, fenced, within prose, or none."""
    p, i = F.col("props"), F.col("event_id")
    reply = F.when(i % 4 == 0, p).when(i % 4 == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(i % 4 == 2, F.concat(F.lit("Sure: "), p, F.lit(" - done"))).otherwise("sorry")
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(text.salvaged_json(reply), "$.k").alias("k"))


@query("""select c_custkey, case when c_custkey % 3 = 0 then null else round(c_acctbal::double, 2) end as low, case when c_custkey % 3 = 0 then null else 'EUR' end as currency, (1 + (c_custkey % 2))::int as skills, case when c_custkey % 2 = 1 then 2.5 else 1 end::double as weight from customer""")
def budgets_and_skills(spark, sf_dir):
    """Ranges without a bound are none; skills without a name go, weights default to 1."""
    c, odd = table(spark, sf_dir, "customer"), F.col("c_custkey") % 2 == 1
    low = F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal").cast("string"))
    item = lambda n, w: F.struct(n.alias("name"), w.alias("weight"), F.lit("99").alias("level"))
    items = F.array(item(F.lit(" a "), F.when(odd, "2.5").otherwise("-1")), item(F.when(odd, "b").otherwise(" "), F.lit("x")))
    b, s = payload.budget_range(low, F.lit(None).cast("string"), F.lit(" EUR ")), payload.skill_items(items)
    return c.select("c_custkey", b.alias("b"), s.alias("s")).select("c_custkey", F.round("b.min", 2).alias("low"), "b.currency", F.size("s").alias("skills"), F.col("s")[0]["weight"].alias("weight"))


@query("""select conv_id, turn, case when turn % 3 = 0 then 'unknown' when turn % 3 = 1 then 'hit' else 'unknown' end as verdict, case when turn % 3 = 1 then 'cv' end as source, case when turn % 2 = 0 then least(100, turn * 30) end::double as score from conversations where length(trim(text)) between 12 and 400 and text not like '% ' and text not like ' %'""")
def grounded_and_reranked(spark, sf_dir):
    """Claims keep a verdict only with evidence that stands in a text; scores of a reply are whole and within 0 to 100."""
    c = table(spark, sf_dir, "conversations").filter("length(trim(text)) between 12 and 400 and text not like '% ' and text not like ' %'")
    t = F.col("turn")
    evidence = F.when(t % 3 == 1, F.upper(F.left("text", F.lit(10)))).when(t % 3 == 2, "nowhere at all 123").otherwise(F.col("text"))
    claim = F.struct(F.lit("s").alias("statement"), F.when(t % 3 == 0, "maybe").otherwise("hit").alias("verdict"), evidence.alias("evidence"), F.lit("either").alias("source"), F.lit("0.5").alias("confidence"))
    claims = payload.grounded_claims(F.array(claim), F.lit("a job"), F.col("text"))
    given = F.array(F.struct(F.lit(" a ").alias("id"), F.when(t % 2 == 0, (t * 30).cast("string")).otherwise("high").alias("score")), F.struct(F.lit("zz").alias("id"), F.lit("1").alias("score")))
    scores = payload.rerank_results(given, F.array(F.lit("a")))
    return c.select("conv_id", "turn", claims[0]["verdict"].alias("verdict"), claims[0]["source"].alias("source"), scores[0]["score"].cast("double").alias("score"))


@query("select doc_id, case when doc_id % 2 = 0 then 0.9 else 0.3 end::double as confidence from documents where length(trim(text)) > 20")
def evidence_checked(spark, sf_dir):
    """Entries whose evidence does not stand in the text lose confidence; white space and case do not count."""
    d = table(spark, sf_dir, "documents").filter("length(trim(text)) > 20")
    evidence = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.left(F.trim("text"), F.lit(12)), F.lit("\n"))).otherwise("no such words 4711")
    return d.select("doc_id", payload.checked_confidence(F.lower("text"), F.lower(evidence), F.lit(0.9)).alias("confidence"))


@query("select doc_id, sha256(translate(strip_accents(text), 'đĐ', 'dD')) as plain from documents")
def marks_strip(spark, sf_dir):
    """Texts without any marks, as hashes."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.strip_marks(F.col("text")), 256).alias("plain"))


@query(f"select doc_id, coalesce(len(regexp_extract_all(lower(nfc_normalize(text)), '[a-z0-9{text.VIETNAMESE}_]+')), 0)::int as tokens from documents")
def composed_tokens(spark, sf_dir):
    """Tokens of composed texts."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.segmented_tokens(F.col("text"))).alias("tokens"))


@query("select p_partkey, case when contains(lower(p_name), 'steel') then 'Thép' when contains(lower(p_name), 'copper') then 'Đồng' else p_name end as name from part")
def keyword_rewrites(spark, sf_dir):
    """Names by the first keyword that they hold."""
    return table(spark, sf_dir, "part").select("p_partkey", text.by_keyword(F.col("p_name"), [("Steel", "Thép"), ("copper", "Đồng")]).alias("name"))


@query("select doc_id, 5 as sections from documents")
def sections_again(spark, sf_dir):
    """Documents whose sections are made anew from their texts."""
    from pairloom.plans.texts import resumes

    d = resumes(spark, sf_dir).select("doc_id", F.col("text").alias("raw_text"), F.lit("old").alias("sections"))
    return sections.resplit(d).select("doc_id", F.size("sections").alias("sections"))


@query("select 'region' as t, 'r_regionkey' as c union all select 'region', 'r_name' union all select 'nation', 'n_nationkey' union all select 'nation', 'n_name' union all select 'nation', 'n_regionkey'")
def catalog_columns(spark, sf_dir):
    """What columns registered tables have."""
    for name in ("nation", "region"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return io.columns_of(spark, ["region", "nation"]).select(F.col("table").alias("t"), F.col("column").alias("c"))


@query("select n_nationkey::bigint as key, n_name as name, null::varchar as comment from nation")
def columns_picked(spark, sf_dir):
    """Columns by name whatever their case; what a table lacks is null."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("KEY"), F.col("n_name").alias("Name"))
    return io.picked(n, {"key": "bigint", "name": "string", "comment": "string"})


@query("""with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
p as (select doc_id, unnest(range(0, len(l), 50)) as b, l from l), t as (select doc_id, b, array_to_string(l[b + 1 : b + 50], chr(10)) as t from p where b < 1000),
d as (select doc_id, string_agg(t, chr(12) order by b) as text, count(*) as read, count(*) filter (length(t) > 0) as filled, avg(length(t)) filter (length(t) > 0) as mean from t group by doc_id)
select doc_id, md5(text) as digest, length(text)::bigint as chars, read::int as pages,
array_to_string(list_filter([case when filled = 0 or mean < 100 or read - filled > 0.6 * read then 'OCR_LOW_QUALITY' end, case when len(l) > 1000 then 'TRUNCATED' end], lambda x: x is not null), ',') as warnings
from d join l using (doc_id)""")
def pdf_documents(spark, sf_dir):
    """Every document written as a PDF of 50 lines a page, every second one with packed objects, and read back up to the 20th page."""

    @F.pandas_udf("binary")
    def pdf(texts: pd.Series, packed: pd.Series) -> pd.Series:
        return pd.Series([portable.to_pdf(t, 50, p) for t, p in zip(texts, packed, strict=True)], dtype=object)

    d = table(spark, sf_dir, "documents").select("doc_id", pdf(F.coalesce("text", F.lit("")), F.col("doc_id") % 2 == 1).alias("content"))
    x = d.withColumn("x", io.extracted(F.col("content"), io.classify_upload(F.col("content")))).select("doc_id", "x.*")
    return x.select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("chars"), "pages", F.concat_ws(",", "warnings").alias("warnings"))
