"""Text, section, date and payload functions over documents, conversations, pages and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import dates, payload, text
from pairloom.operators import chunking, sections, segmentation
from pairloom.operators.staging import against_all, maybe_broadcast
from pairloom.plans.registry import query, table

CHUNK = "(regexp_extract_all(text, '\\S+'))"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"""with d as (select doc_id, {CHUNK} as w from documents), n as (select *, case when len(w) = 0 then 0 when len(w) <= 64 then 1 else ceil((len(w) - 64) / 48.0)::int + 1 end as n from d),
c as (select doc_id, w, unnest(range(n)) as chunk_idx from n)
select doc_id, chunk_idx::int as chunk_idx, array_to_string(w[chunk_idx * 48 + 1 : chunk_idx * 48 + 64], ' ') as text from c""")
def chunk_windows(spark, sf_dir):
    """Windows of 64 words, 16 shared with the next."""
    return chunking.chunks(docs(spark, sf_dir))


@query(f"""with d as (select doc_id, len({CHUNK}) as n from documents) select doc_id, (case when n = 0 then 0 when n <= 64 then 1 else ceil((n - 64) / 48.0)::int + 1 end)::int as chunks from d""")
def chunk_counts(spark, sf_dir):
    """How many windows each document has."""
    return docs(spark, sf_dir).select("doc_id", chunking.chunk_count(F.size(text.words(F.col("text")))).alias("chunks"))


_PART = "replace(replace(substr(t, {0}, {1}), chr(10), ' '), chr(13), ' ') || '.'"
SPLIT = f"""with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) // 3 as n from documents),
l as (select doc_id, unnest([0, 1, 2, 3, 4]) as ord, unnest(['preamble', 'skills', 'experience', 'education', 'skills_2']) as name, unnest(['', 'SKILLS:', 'Work History', 'Education', 'Skills']) as heading,
unnest(['Intro line.', 'x ' || {_PART.format("1", "n")}, 'x ' || {_PART.format("n + 1", "n")}, '', 'x ' || {_PART.format("2 * n + 1", "length(t)")}]) as text from d)"""


def resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, its whole text in three parts below headings."""
    t = F.translate(F.coalesce("text", F.lit("")), "\n\r", "  ")
    n = F.floor(F.length(t) / 3).cast("int")
    part = lambda a, k: F.concat(F.lit("x "), t.substr(a + 1, k), F.lit("."))
    raw = F.concat_ws("\n", F.lit("Intro line."), F.lit("SKILLS:"), part(F.lit(0), n), F.lit("Work History"), part(n, n), F.lit("Education"), F.lit("Skills"), part(2 * n, F.length(t)))
    return docs(spark, sf_dir).select("doc_id", raw.alias("text"))


@query(SPLIT + " select doc_id, ord::int as ord, name, heading, trim(text) as text from l")
def section_split(spark, sf_dir):
    """Sections of texts with headings put in."""
    return sections.split_sections(resumes(spark, sf_dir)).withColumn("text", F.trim("text"))


@query(SPLIT + " select name, count(*) as sections from l group by name")
def section_counts(spark, sf_dir):
    """How often each section occurs; a repeated name is numbered."""
    return sections.split_sections(resumes(spark, sf_dir)).groupBy("name").agg(F.count("*").alias("sections"))


VN = text.VIETNAMESE + text.VIETNAMESE.upper()


@query(f"""with r as (select doc_id, len(regexp_extract_all(text, '[{VN}]')) / greatest(1, len(regexp_extract_all(text, '\\p{{L}}')))::double as ratio from documents)
select doc_id, case when ratio >= 0.02 then 'vi' when ratio > 0 then 'mixed' else 'en' end as lang, round(ratio, 6) as ratio from r""")
def lang_ratio(spark, sf_dir):
    """Language by the share of marked letters."""
    return docs(spark, sf_dir).select("doc_id", text.detect_lang(F.col("text")).alias("lang"), F.round(text.accent_ratio(F.col("text")), 6).alias("ratio"))


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query(f"""with t as (select doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-zÀ-ỹđ0-9_]+') and not regexp_full_match(x, '[0-9]+') and x not in {_in(text.NEUTRAL)}) as w from documents),
c as (select doc_id, len(list_filter(w, lambda x: regexp_matches(x, '[{text.VIETNAMESE}]') or x in {_in(text.VI_WORDS)})) as vi,
len(list_filter(w, lambda x: not (regexp_matches(x, '[{text.VIETNAMESE}]') or x in {_in(text.VI_WORDS)}) and (x in {_in(text.EN_WORDS)} or (regexp_full_match(x, '[\\x00-\\x7f]+') and length(x) > 3)))) as en from t),
p as (select doc_id, case when vi + en > 0 then vi / (vi + en)::double else 0 end as p_vi, case when vi + en > 0 then en / (vi + en)::double else 1 end as p_en from c)
select doc_id, case when p_vi >= 0.2 and p_en >= 0.2 then 'code_mixed' when p_vi > p_en then 'vi' else 'en' end as label, round(p_vi, 6) as p_vi, round(p_en, 6) as p_en from p""")
def lang_token_share(spark, sf_dir):
    """Language by the words that speak for one."""
    d = docs(spark, sf_dir).select("doc_id", text.language_shares(F.col("text")).alias("s"))
    return d.select("doc_id", "s.label", F.round("s.p_vi", 6).alias("p_vi"), F.round("s.p_en", 6).alias("p_en"))


@query(f"select doc_id, sha256(translate(text, '{VN}', '{text.VIETNAMESE_PLAIN + text.VIETNAMESE_PLAIN.upper()}')) as plain from documents")
def accent_strip(spark, sf_dir):
    """Texts without Vietnamese marks, as hashes."""
    return docs(spark, sf_dir).select("doc_id", F.sha2(text.strip_accents(F.col("text")), 256).alias("plain"))


@query("select doc_id, sha256(text) as hash from documents")
def content_hash(spark, sf_dir):
    """The content hash of each text."""
    return docs(spark, sf_dir).select("doc_id", text.content_hash(F.col("text")).alias("hash"))


@query("""with p as (select page_id, regexp_replace(html, '<[^>]*>', chr(10), 'g') as t from pages),
l as (select page_id, list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\\s*[•●▪‣☑✓]\\s*', '- ')) as ls from p),
f as (select page_id, list_transform(list_filter(ls, lambda x: not regexp_matches(x, '(?i)^\\s*(page|trang|p\\.?)\\s*\\d+\\s*,?\\s*$')), lambda x: trim(regexp_replace(x, '[ \\t\\r\\f\\x0b]+', ' ', 'g'))) as ls from l)
select page_id, sha256(trim(regexp_replace(array_to_string(ls, chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) as hash from f""")
def clean_text(spark, sf_dir):
    """Pages without tags, cleaned (compatibility forms left alone), as hashes."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", "\n").alias("t"))
    return p.select("page_id", F.sha2(text.clean_text(F.col("t"), compatibility=False), 256).alias("hash"))


@query()
def clean_text_nfkc(spark, sf_dir):
    """Pages cleaned with compatibility forms folded."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", "\n").alias("t"))
    return p.select("page_id", F.length(text.clean_text(F.col("t"))).alias("chars"))


@query("""with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
o as (select doc_id, l, list_filter(range(1, len(l)), lambda i: (regexp_matches(ltrim(l[i + 1]), '^(- |[\\p{Lu}\\p{Nd}])') or trim(l[i + 1]) = '') or (rtrim(l[i]) = '' or regexp_matches(rtrim(l[i]), '[.!?:;,—–-]$'))) as b from d)
select doc_id, len(l)::int as lines, (len(b) + 1)::int as merged from o""")
def merge_lines(spark, sf_dir):
    """Documents with broken lines joined: lines before and after."""
    whole = F.coalesce("text", F.lit(""))
    d = docs(spark, sf_dir).select("doc_id", whole.alias("text"), text.merge_broken_lines(whole).alias("m"))
    return d.select("doc_id", F.size(F.split("text", "\n", -1)).alias("lines"), F.size(F.split("m", "\n", -1)).alias("merged"))


KINDS = ["concat(y, '-', m)", "concat(y, '/', m)", "concat(m, '/', y)", "concat('in ', mon, ' ', y)", "concat('year ', y)", "concat('13/', y)", "'none'"]


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    y, m, mon = F.date_format("o_orderdate", "yyyy"), F.date_format("o_orderdate", "MM"), F.date_format("o_orderdate", "MMM")
    forms = F.array(F.concat_ws("-", y, m), F.concat_ws("/", y, m), F.concat_ws("/", m, y), F.concat_ws(" ", F.lit("in"), mon, y), F.concat_ws(" ", F.lit("year"), y), F.concat(F.lit("13/"), y), F.lit("none"))
    return o.select("o_orderkey", F.element_at(forms, (F.col("o_orderkey") % 7 + 1).cast("int")).alias("value"))


@query("""select o_orderkey, case o_orderkey % 7 when 4 then strftime(o_orderdate, '%Y') when 5 then null when 6 then null else strftime(o_orderdate, '%Y-%m') end as date from orders""")
def date_normalize(spark, sf_dir):
    """Dates written in seven ways, brought to year and month."""
    return rendered(spark, sf_dir).select("o_orderkey", dates.normalize_date(F.col("value")).alias("date"))


@query("select o_orderkey, year(o_orderdate)::int as year, case when o_orderkey % 2 = 0 then month(o_orderdate)::int else 1 end as month from orders")
def year_month(spark, sf_dir):
    """Year and month of texts, January where a month is missing."""
    o = table(spark, sf_dir, "orders")
    value = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy"))
    return o.select("o_orderkey", dates.year_month(value).alias("v")).select("o_orderkey", "v.year", "v.month")


@query("""with s as (select o_custkey, (year(o_orderdate + to_days((o_orderkey % 900)::int)) - year(o_orderdate)) * 12 + month(o_orderdate + to_days((o_orderkey % 900)::int)) - month(o_orderdate) as m from orders)
select o_custkey, round(sum(case when m > 0 then m end) / 12.0::double, 2) as years from s group by o_custkey""")
def months_experience(spark, sf_dir):
    """Years of work out of start and end months, null without a positive span."""
    o = table(spark, sf_dir, "orders")
    item = F.struct(F.date_format("o_orderdate", "yyyy-MM").alias("start_date"), F.date_format(F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 900).cast("int")), "yyyy-MM").alias("end_date"), F.lit(False).alias("is_current"))
    g = o.groupBy("o_custkey").agg(F.collect_list(item).alias("items"))
    return g.select("o_custkey", dates.experience_years(F.col("items"), "2024-06").alias("years"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as double) as k, least(1, greatest(0, try_cast(json_extract_string(props, '$.k') as double))) as confidence from events")
def json_props(spark, sf_dir):
    """A number out of JSON, and clamped."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", payload.as_float(k).alias("k"), payload.confidence(k).alias("confidence"))


@query("""with c as (select conv_id, list(struct_pack(t := trim(text), r := role) order by turn) as items from conversations group by conv_id)
select conv_id, len(items)::int as n, len(list_distinct(list_transform(items, lambda x: lower(x.t))))::int as kept from c""")
def payload_dedupe(spark, sf_dir):
    """Entries of a list, the first of equal ones kept."""
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("items"))
    return g.select("conv_id", F.size("items").alias("n"), F.size(payload.first_wins(F.col("items"), lambda x: x["text"])).alias("kept"))


@query("""with g as (select o_custkey, count(*)::int as n from orders group by o_custkey) select o_custkey, least(n, 20)::int as kept, case when n > 20 then '["LIMIT_EXPERIENCE_TRIMMED"]' else '[]' end as warnings from g""")
def warnings_array(spark, sf_dir):
    """Lists cut to their limit, with a warning."""
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("x"))
    cut, warning = payload.clamped(F.col("x"), "experience")
    return g.select("o_custkey", F.size(cut).alias("kept"), payload.warnings(warning).alias("warnings"))


@query("""with o as (select o_custkey, string_agg(o_orderpriority || ', ' || o_orderstatus, chr(10) order by o_orderkey) as text from orders group by 1) select o_custkey, sha256(text) as hash from o""")
def education_texts(spark, sf_dir):
    """Lines of degree and school out of records, as hashes."""
    o = table(spark, sf_dir, "orders")
    items = F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_orderpriority").alias("degree"), F.col("o_orderstatus").alias("school"))))
    return o.groupBy("o_custkey").agg(items.alias("i")).select("o_custkey", F.sha2(payload.education_text(F.col("i")), 256).alias("hash"))


@query("""with b as (select item_id, lower(regexp_replace(text, '\\s+', '', 'g')) as e from benchmark), d as (select doc_id, lower(regexp_replace(text, '\\s+', '', 'g')) as t from documents)
select item_id, count(*) as documents from b join d on e <> '' and contains(t, e) group by item_id""")
def grounded_evidence(spark, sf_dir):
    """In how many documents a whole passage stands: one pass over each text finds all passages."""
    from pairloom.operators.evidence import holding

    b = table(spark, sf_dir, "benchmark").select("item_id", text.squeezed(F.col("text")).alias("e"))
    d = docs(spark, sf_dir).select("doc_id", text.squeezed(F.col("text")).alias("t"))
    return holding(d, b).groupBy("item_id").agg(F.count("*").alias("documents"))


GRADE_SQL = """w as (select d.doc_id, list_distinct(regexp_extract_all(lower(d.text), '\\S+')) as w from documents d), b as (select item_id, list_distinct(regexp_extract_all(lower(text), '\\S+')) as w from benchmark),
g as (select item_id as query_id, doc_id, len(list_intersect(b.w, w.w)) / greatest(1, len(b.w))::double as r from b, w), s as (select query_id, doc_id, case when r >= 0.35 then 3 when r >= 0.22 then 2 when r >= 0.12 then 1 else 0 end as grade from g)"""


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, doc_id, grade > 0: common words over the passage's words; pairs meet by their words, not one by one."""
    w = lambda d, i: d.select(F.col(i).alias("id"), F.explode(F.array_distinct(text.words(F.lower("text")))).alias("w"))
    asked, held = w(table(spark, sf_dir, "benchmark"), "item_id"), w(docs(spark, sf_dir), "doc_id")
    n = asked.groupBy(F.col("id").alias("query_id")).agg(F.count("*").alias("n"))
    common = held.select(F.col("id").alias("doc_id"), "w").join(maybe_broadcast(asked.select(F.col("id").alias("query_id"), "w"), 64), "w").groupBy("query_id", "doc_id").agg(F.count("*").alias("c"))
    r = F.col("c") / F.col("n")
    return common.join(maybe_broadcast(n, 32), "query_id").select("query_id", "doc_id", F.when(r >= 0.35, 3).when(r >= 0.22, 2).when(r >= 0.12, 1).otherwise(0).alias("grade")).filter("grade > 0")


@query(f"with {GRADE_SQL} select query_id, grade::int as grade, count(*) as documents from s where grade > 0 group by all")
def silver_grades(spark, sf_dir):
    """Grades by word overlap, counted."""
    return grades(spark, sf_dir).groupBy("query_id", "grade").agg(F.count("*").alias("documents"))


@query(f"with {GRADE_SQL} select query_id, doc_id, grade::int as grade from s where grade > 0 and query_id in (select query_id from s group by query_id having max(grade) >= 2)")
def qrels_build(spark, sf_dir):
    """Positive grades of the queries that have any grade of 2 or more."""
    g = grades(spark, sf_dir)
    return g.join(g.groupBy("query_id").agg(F.max("grade").alias("m")).filter("m >= 2").select("query_id"), "query_id", "left_semi")


@query("select b.item_id as jd_id, d.doc_id as cv_id, coalesce(l.quality, -1)::int as label from benchmark b cross join documents d left join labels l on l.doc_id = d.doc_id where b.item_id % 100 = 0")
def label_grid(spark, sf_dir):
    """The passages with numbers divisible by 100 with every document and its label, -1 without one."""
    from pairloom.sources.io import build_queries

    jds = table(spark, sf_dir, "benchmark").filter("item_id % 100 = 0").select(F.col("item_id").alias("jd_id"))
    cvs = docs(spark, sf_dir).select(F.col("doc_id").alias("cv_id"))
    pairs = against_all(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("cv_id"), F.col("quality").cast("int").alias("label")), jds, "jd_id")
    q = build_queries(pairs, cvs, jds)
    return q.select("jd_id", F.explode(F.arrays_zip("cv_ids", "relevance")).alias("x")).select("jd_id", F.col("x.cv_ids").alias("cv_id"), F.col("x.relevance").alias("label"))


@query("""with p as (select doc_id, regexp_extract_all(text, '[^\n]+') as l from documents) select doc_id, case when len(l) = 0 then false else list_sum(list_transform(l, lambda x: length(x))) / len(l) < 100 end as scanned from p""")
def looks_scanned(spark, sf_dir):
    """Documents whose lines, taken as pages, hold little text."""
    pages = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.length(x).cast("long")), lambda n: n > 0)
    return docs(spark, sf_dir).select("doc_id", text.looks_scanned(pages).alias("scanned"))


UNITS = """with recursive c as materialized (select row_number() over () as id, doc_id, regexp_split_to_array(clause, ' +') as s from (
select doc_id, unnest(regexp_extract_all(lower(nfc_normalize(text)), '[\\p{L}\\p{M}]+(?: +[\\p{L}\\p{M}]+)*')) as clause from documents)),
g as materialized (select id, i, n, array_to_string(s[i - n + 1 : i], ' ') as unit from (select id, s, i, unnest(range(1, least(3, i) + 1)) as n from (select id, s, unnest(range(1, len(s) + 1)) as i from c))),
total as (select count(*)::double as total from g where n = 1),
k as materialized (select unit, n::int as n, count(*) as times from g group by all having count(*) >= 5 and count(*) >= 0.000002 * (select total from total)),
cut as (select k.*, string_split(unit, ' ') as w, unnest(range(1, greatest(n, 2))) as b from k),
far as (select cut.unit from cut join k l on l.unit = array_to_string(w[1 : cut.b], ' ') join k r on r.unit = array_to_string(w[cut.b + 1 : cut.n], ' ')
 where cut.times * (select total from total) < 20 * l.times * r.times),
u as materialized (select unit, n, times, round(-ln(times / (select total from total)) * 1000000)::bigint as cost from k where unit not in (select unit from far))"""


@query(f"{UNITS} select unit, n, times, cost from u")
def segmentation_units(spark, sf_dir):
    """Units of one to three syllables that the documents teach, with their costs."""
    return segmentation.learn(docs(spark, sf_dir))


@query(f"""{UNITS},
e as (select id, i, max(u.cost) filter (g.n = 1) as c1, max(u.cost) filter (g.n = 2) as c2, max(u.cost) filter (g.n = 3) as c3 from g left join u using (unit) group by id, i),
a as materialized (select id, count(*) as n, list(coalesce(c1, (select 1 + max(cost) from u), 1) order by i) as c1, list(c2 order by i) as c2, list(c3 order by i) as c3 from e group by id),
p as (select id, 0::bigint as i, {{'c': 0::bigint, 'u': 0::bigint, 'l': 0::bigint, 'j': 0::bigint}} as x, null::struct(c bigint, u bigint, l bigint, j bigint) as y, null::struct(c bigint, u bigint, l bigint, j bigint) as z from a
 union all select id, p.i + 1, list_min(list_filter([{{'c': x.c + a.c1[p.i + 1], 'u': x.u + 1, 'l': -1::bigint, 'j': x.j}}, {{'c': y.c + a.c2[p.i + 1], 'u': y.u + 1, 'l': -2::bigint, 'j': y.j + 1}},
  {{'c': z.c + a.c3[p.i + 1], 'u': z.u + 1, 'l': -3::bigint, 'j': z.j + 1}}], lambda o: o.c is not null)), x, y from p join a using (id) where p.i < a.n),
ends as (select c.doc_id, p.x from p join a on a.id = p.id and a.n = p.i join c on c.id = p.id)
select d.doc_id, coalesce(sum(x.u), 0)::bigint as n_units, coalesce(sum(x.j), 0)::bigint as n_joined, coalesce(sum(x.c), 0)::bigint as cost from documents d left join ends using (doc_id) group by d.doc_id""")
def segmented_documents(spark, sf_dir):
    """Every document cut into units by the cheapest way."""
    d = docs(spark, sf_dir)
    return segmentation.segmented(d, segmentation.learn(d)).select("doc_id", "n_units", "n_joined", "cost")
