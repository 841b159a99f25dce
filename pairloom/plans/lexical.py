"""Lexical ranking of documents for benchmark passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.text import VIETNAMESE
from pairloom.operators import bm25 as lex
from pairloom.operators.blocks import BlockIndex
from pairloom.operators.ranking import ranked
from pairloom.operators.staging import remove_at_exit, shared_folder
from pairloom.plans.registry import query, table

TOKENS = f"regexp_extract_all(lower(text), '[a-z0-9{VIETNAMESE}_]+')"

BM25_SQL = f"""
d as (select doc_id, {TOKENS} as toks from documents),
stat as (select count(*)::double as n, avg(len(toks)) as avgdl from d),
post as (select doc_id, term, count(*) as tf, any_value(dl) as dl from (select doc_id, len(toks) as dl, unnest(toks) as term from d) group by doc_id, term),
raw as (select term, count(*) as df, ln((select n from stat) - count(*) + 0.5) - ln(count(*) + 0.5) as r from post group by term),
idf as (select term, df, case when r < 0 then 0.25 * (select avg(r) from raw) else r end as idf from raw),
q as (select query_id, term, count(*) as times from (select item_id as query_id, unnest({TOKENS}) as term from benchmark) group by query_id, term),
bm as (select q.query_id, p.doc_id, sum(q.times * i.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / (select avgdl from stat)))) as score
       from post p join idf i using (term) join q using (term) group by q.query_id, p.doc_id)
"""


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lex.bm25(table(spark, sf_dir, "documents"), _queries(spark, sf_dir))
    return s.withColumn("score", F.round("score", 4))


TOPK_SQL = f"""with {BM25_SQL}, s as (select query_id, doc_id, round(score, 4) as score from bm)
select query_id, doc_id, score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s) where rank <= 5"""


@query(TOPK_SQL)
def bm25_topk(spark, sf_dir):
    """Each passage's five best documents."""
    s = lex.bm25_best(table(spark, sf_dir, "documents"), _queries(spark, sf_dir), 5, slack=1e-4)
    return ranked(s.withColumn("score", F.round("score", 4)), 5)


@query(TOPK_SQL)
def bm25_blocks_topk(spark, sf_dir):
    """The same from an index of postings in blocks, written once and opened again; blocks that cannot hold a hit are not read."""
    where = shared_folder(spark)
    BlockIndex(spark, where).write(table(spark, sf_dir, "documents"))
    remove_at_exit(spark, where)
    s, _ = BlockIndex(spark, where).search(_queries(spark, sf_dir), 5, slack=1e-4)
    return ranked(s.withColumn("score", F.round("score", 4)), 5)


@query(f"""with {BM25_SQL}, s as (select b.item_id as query_id, d.doc_id, round(coalesce(bm.score, 0), 4) as score from benchmark b cross join documents d
left join bm on bm.query_id = b.item_id and bm.doc_id = d.doc_id)
select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from s""")
def bm25_full_grid(spark, sf_dir):
    """Every document ranked for every passage, pairs without a common term at 0."""
    grid = lex.bm25_grid(table(spark, sf_dir, "documents"), _queries(spark, sf_dir))
    return ranked(grid.withColumn("score", F.round("score", 4)))


@query(f"with {BM25_SQL} select term, df, round(idf, 6) as idf from idf")
def bm25_idf_table(spark, sf_dir):
    """Document frequency and idf of every term."""
    docs = table(spark, sf_dir, "documents")
    return lex.idf_table(lex.postings(docs), docs.count()).withColumn("idf", F.round("idf", 6))


@query(f"""with d as (select doc_id, {TOKENS} as toks from documents), n as (select count(*)::double as n from d),
post as (select doc_id, term, count(*) as tf from (select doc_id, unnest(toks) as term from d) group by all),
idf as (select term, ln((1 + (select n from n)) / (1 + count(*))) + 1 as idf from post group by term),
w as (select doc_id, term, (1 + ln(tf)) * idf as w from post join idf using (term)),
norm as (select doc_id, sqrt(sum(w * w)) as norm from w group by doc_id),
q as (select query_id, term, (1 + ln(count(*))) * any_value(idf) as w from (select item_id as query_id, unnest({TOKENS}) as term from benchmark) join idf using (term) group by query_id, term),
qn as (select query_id, sqrt(sum(w * w)) as qnorm from q group by query_id),
s as (select query_id, doc_id, round(sum(q.w * w.w) / (any_value(norm) * any_value(qnorm)), 6) as score from q join w using (term) join norm using (doc_id) join qn using (query_id) group by query_id, doc_id)
select query_id, doc_id, score, rank::int as rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s) where rank <= 5""")
def tfidf_topk(spark, sf_dir):
    """Each passage's five best documents by TF-IDF cosine."""
    s = lex.tfidf(table(spark, sf_dir, "documents"), _queries(spark, sf_dir))
    return ranked(s.withColumn("score", F.round("score", 6)), 5)
