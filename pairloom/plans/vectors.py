"""Dense ranking and fusion. Vectors 4n..4n+3 are the sections of document n; vectors with ids
divisible by 100 ask, and so do the documents that hold one. In fusions every passage asks, together with the vector of its number."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import cells, chunking, fusion, matching
from pairloom.operators.evaluation import gain  # noqa: F401
from pairloom.operators.ranking import cascade, ranked
from pairloom.operators.ranking import pool_union as union_of
from pairloom.operators.staging import remove_at_exit, shared_folder
from pairloom.plans.registry import query, table
from pairloom.plans.lexical import BM25_SQL, bm25_scores

NAMES = ("skills", "experience", "education", "summary")
COS = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"
RANK = "row_number() over (partition by query_id order by score desc, doc_id)::int as rank"
SIMS = f"""v as (select vec_id as id, vec_id // 4 as doc, (['skills', 'experience', 'education', 'summary'])[vec_id % 4 + 1] as section, embedding from embeddings),
pairs as (select a.doc as query_doc, a.section as query_section, b.doc as doc_id, b.section, {COS} as sim from v a join v b on a.doc % 25 = 0)"""
CROSS = f"with {SIMS}, c as (select query_doc, doc_id, query_section, max(sim) as sim from pairs group by all)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("vec_id") % 4 + 1).cast("int"))
    return e.select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 4).cast("long").alias("doc_id"), name.alias("section"), "embedding")


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def knn(spark: SparkSession, sf_dir: str, k: int | None = 10) -> DataFrame:
    """query_id, doc_id, score: vectors with ids divisible by 100 against all, nearest first."""
    v = flat(spark, sf_dir)
    s = matching.similarities(v.filter("id % 100 = 0"), v, k and k + 1)
    return s.filter("query_id <> cand_id").select("query_id", F.col("cand_id").alias("doc_id"), F.round("sim", 6).alias("score"))


KNN = f"s as (select a.vec_id as query_id, b.vec_id as doc_id, round({COS}, 6) as score from embeddings a join embeddings b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id)"


@query(f"with {KNN} select * from (select query_id, doc_id, score, {RANK} from s) where rank <= 10")
def knn_cosine_topk(spark, sf_dir):
    """The ten nearest vectors by cosine; each task keeps its own eleven before the shuffle."""
    return ranked(knn(spark, sf_dir), 10)


@query(f"with {KNN} select * from (select query_id, doc_id, score, {RANK} from s) where rank <= 10")
def knn_cells_topk(spark, sf_dir):
    """The same from an index of cells, written once and opened again; cells that cannot hold a hit are not read."""
    v, where = flat(spark, sf_dir), shared_folder(spark)
    cells.CellIndex(spark, f"{where}/cells").write(v)
    found, _ = cells.CellIndex(spark, f"{where}/cells").search(v.filter("id % 100 = 0"), 11, slack=2e-6)
    remove_at_exit(spark, where)
    hits = found.filter("query_id <> cand_id").select("query_id", F.col("cand_id").alias("doc_id"), F.round("sim", 6).alias("score"))
    return ranked(hits, 10)


@query(f"with {KNN} select query_id, doc_id, score, {RANK} from s")
def single_vector_rank(spark, sf_dir):
    """All vectors ranked for each query; pairs leave the task in which they are made as ranked rows."""
    v = flat(spark, sf_dir)
    return matching.all_ranked(v.filter("id % 100 = 0"), v)


@query(f"with {KNN} select query_id, count(*) as ranked, round(max(score), 6) as best from s group by query_id")
def rank_all_counts(spark, sf_dir):
    """How many candidates each query ranks, and its best score."""
    best = knn(spark, sf_dir, 1).groupBy("query_id").agg(F.max("score").alias("best"))
    ranked_ = flat(spark, sf_dir).agg((F.count("*") - 1).alias("ranked"))  # all but the query itself: one row
    return best.crossJoin(F.broadcast(ranked_)).select("query_id", "ranked", F.round("best", 6).alias("best"))


@query(f"""with s as (select a.vec_id as query_id, b.vec_id // 4 as doc_id, b.vec_id % 4 as version, round(1 - {COS}, 6) as distance from embeddings a join embeddings b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
n as (select *, row_number() over (partition by query_id order by distance, doc_id) as nth from s),
b as (select query_id, doc_id, min(distance) as distance, arg_min(version, distance)::int as version from n where nth <= 15 group by query_id, doc_id)
select query_id, doc_id, distance, version, row_number() over (partition by query_id order by distance, doc_id)::int as pos from b""")
def knn_pool_dedup(spark, sf_dir):
    """A pool of five: fifteen nearest vectors, the closest of each document."""
    s = knn(spark, sf_dir, 15)
    hits = s.select("query_id", F.floor(F.col("doc_id") / 4).cast("long").alias("doc_id"), (F.col("doc_id") % 4).cast("int").alias("version"), F.round(1 - F.col("score"), 6).alias("distance"))
    return matching.pool(hits, 5)


def section_scores(spark: SparkSession, sf_dir: str, pairing: str, how: str) -> DataFrame:
    """The ten best documents of each asking one, reduced within the tasks."""
    v = vectors(spark, sf_dir)
    s = matching.section_scores(v.filter("doc_id % 25 = 0"), v, pairing, how, k=10)
    return ranked(s.withColumn("score", F.round("score", 6)), 10)


TOP = f"select * from (select query_id, doc_id, score, {RANK} from s) where rank <= 10"
WEIGHT = "case query_section when 'skills' then 0.4 when 'experience' then 0.35 when 'education' then 0.15 else 0.1 end"


@query(f"with {SIMS}, c as (select query_doc, doc_id, query_section, coalesce(max(case when section = query_section then sim end), 0) as sim from pairs group by all), s as (select query_doc as query_id, doc_id, round(avg(sim), 6) as score from c group by all) {TOP}")
def section_fixed_mean(spark, sf_dir):
    """Sections of the same name against each other, mean."""
    return section_scores(spark, sf_dir, "fixed", "mean")


@query(f"{CROSS}, s as (select query_doc as query_id, doc_id, round(avg(sim), 6) as score from c group by all) {TOP}")
def section_cross_mean(spark, sf_dir):
    """Each query section against its best candidate section, mean."""
    return section_scores(spark, sf_dir, "cross", "mean")


@query(f"{CROSS}, s as (select query_doc as query_id, doc_id, round(max(sim), 6) as score from c group by all) {TOP}")
def section_cross_max(spark, sf_dir):
    """Each query section against its best candidate section, maximum."""
    return section_scores(spark, sf_dir, "cross", "max")


@query(f"{CROSS}, s as (select query_doc as query_id, doc_id, round(sum({WEIGHT} * sim) / sum({WEIGHT}), 6) as score from c group by all) {TOP}")
def section_cross_weighted(spark, sf_dir):
    """Each query section against its best candidate section, weighted by section."""
    return section_scores(spark, sf_dir, "cross", "weighted")


DENSE = "dense as (select query_doc as query_id, doc_id, round(max(sim), 6) as score from pairs where query_section = 'summary' and section = 'summary' group by all)"


@query(f"""{CROSS}, {DENSE}, coarse as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as r from dense) where r <= 50),
s as (select query_doc as query_id, doc_id, round(sum({WEIGHT} * sim) / sum({WEIGHT}), 6) as score from c where (query_doc, doc_id) in (select (query_id, doc_id) from coarse) group by all) {TOP}""")
def two_stage_rank(spark, sf_dir):
    """Fifty documents by summary, ranked by weighted sections."""
    v = vectors(spark, sf_dir)
    return matching.two_stage(v.filter("doc_id % 25 = 0"), v, 50, 10)


LEXICAL = "kw as (select query_id, doc_id, round(score, 4) as score from bm)"
SEMANTIC = f"sem as (select a.vec_id as query_id, b.vec_id as doc_id, round({COS}, 6) as score from embeddings a join embeddings b on a.vec_id in (select item_id from benchmark))"


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(semantic, keyword) scores of every passage: vector n and passage n ask, vector ids and document ids are one space."""
    v = flat(spark, sf_dir)
    asking = v.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")).distinct(), "id", "left_semi")
    sem = matching.similarities(asking, v).select("query_id", F.col("cand_id").alias("doc_id"), F.round("sim", 6).alias("score"))
    return sem, bm25_scores(spark, sf_dir)


@query(f"""with {BM25_SQL}, {SEMANTIC}, {LEXICAL},
one as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as pos from sem),
two as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as pos from kw)
select query_id, doc_id, min(pos)::int as pos from (select * from one where pos <= 10 union all select query_id, doc_id, pos + 10 from two where pos <= 10) group by all""")
def pool_union(spark, sf_dir):
    """Ten by vector, then ten by words, each document once."""
    sem, kw = sides(spark, sf_dir)
    return union_of(ranked(sem, 10), ranked(kw, 10), 20)


def fused(spark: SparkSession, sf_dir: str, k: int, score=lambda x: np.round(x, 6)) -> DataFrame:  # noqa: ANN001
    """What can be among the best k of both sides' weighted sums, for every passage."""
    v = flat(spark, sf_dir)
    asking = v.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")).distinct(), "id", "left_semi")
    return fusion.met(asking, v, bm25_scores(spark, sf_dir), k, 1e-4, score)


BOTH = f"""with {BM25_SQL}, {SEMANTIC}, {LEXICAL},
b as (select coalesce(sem.query_id, kw.query_id) as query_id, coalesce(sem.doc_id, kw.doc_id) as doc_id, coalesce(sem.score, 0) as s, coalesce(kw.score, 0) as k
      from sem full outer join kw on sem.query_id = kw.query_id and sem.doc_id = kw.doc_id),
m as (select *, case when max(s) over w - min(s) over w <= 0 then 1 else (s - min(s) over w) / (max(s) over w - min(s) over w) end as ns,
      case when max(k) over w - min(k) over w <= 0 then 1 else (k - min(k) over w) / (max(k) over w - min(k) over w) end as nk from b window w as (partition by query_id))"""


@query(f"{BOTH}, s as (select query_id, doc_id, round(0.5 * ns + 0.5 * nk, 6) as score from m) {TOP}")
def fuse_pre(spark, sf_dir):
    """Scaled semantic and keyword scores, half and half."""
    return ranked(fused(spark, sf_dir, 10).withColumn("score", F.round(fusion.scaled(), 6)), 10).select("query_id", "doc_id", "score", "rank")


@query(f"{BOTH}, s as (select query_id, doc_id, round(0.5 * s + 0.5 * k, 8) as score from b) {TOP}")
def fuse_raw(spark, sf_dir):
    """Unscaled semantic and keyword scores, half and half."""
    return ranked(fused(spark, sf_dir, 10).withColumn("score", F.round(F.col("s") * 0.5 + F.col("k") * 0.5, 8)), 10).select("query_id", "doc_id", "score", "rank")


@query(f"""{BOTH.replace("from sem full", "from (select query_id, doc_id, round(0.4 * greatest(0, least(1, score)) + 0.6, 6) as score from sem) sem full")}, s as (select query_id, doc_id, round(0.5 * ns + 0.5 * nk, 6) as score from m) {TOP}""")
def fuse_post(spark, sf_dir):
    """Hybrid scores first (without structured data all other parts are neutral), then fused with keyword scores."""
    neutral = lambda x: np.round(0.4 * np.clip(np.round(x, 6), 0, 1) + 0.6, 6)
    return ranked(fused(spark, sf_dir, 10, neutral).withColumn("score", F.round(fusion.scaled(), 6)), 10).select("query_id", "doc_id", "score", "rank")


@query(f"""{BOTH}, s as (select alpha, query_id, doc_id, round(alpha * ns + (1 - alpha) * nk, 6) as score from m, (select unnest([0.0, 0.2, 0.4, 0.5, 0.6, 0.8, 1.0])::double as alpha))
select alpha, query_id, doc_id, score, rank::int as rank from (select *, row_number() over (partition by alpha, query_id order by score desc, doc_id) as rank from s) where rank <= 3""")
def alpha_sweep(spark, sf_dir):
    """The three best documents at each alpha, from one scaling."""
    from pyspark.sql.window import Window as W

    alphas = F.explode(F.array(*[F.lit(a) for a in (0.0, 0.2, 0.4, 0.5, 0.6, 0.8, 1.0)]))
    s = fused(spark, sf_dir, 3).withColumn("alpha", alphas).withColumn("score", F.round(fusion.scaled(F.col("alpha")), 6))
    return s.withColumn("rank", F.row_number().over(W.partitionBy("alpha", "query_id").orderBy(F.desc("score"), "doc_id"))).filter("rank <= 3").select("alpha", "query_id", "doc_id", "score", "rank")


@query(f"""with {KNN}, r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as old from s),
c as (select query_id, doc_id, old, case when old <= 5 then doc_id % 7 end as new_score from r where old <= 10)
select query_id, doc_id, row_number() over (partition by query_id order by case when old <= 5 then 0 else 1 end, new_score desc, old)::int as rank from c""")
def cascade_rerank(spark, sf_dir):
    """The first five of ten by an external score, the rest unchanged."""
    r = ranked(knn(spark, sf_dir), 10)
    rescored = r.select("query_id", "doc_id", (F.col("doc_id") % 7).cast("double").alias("new_score"))
    return cascade(r, rescored, 5).select("query_id", "doc_id", "rank")


@query()
def chunk_max_sim(spark, sf_dir):
    """Passages against documents by their most similar windows (hashed embeddings)."""
    docs = chunking.chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    asked = chunking.chunks(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text"))
    s = chunking.max_similarity(asked.withColumn("embedding", chunking.hash_embed(F.col("text"))), docs.withColumn("embedding", chunking.hash_embed(F.col("text"))), 20)
    return ranked(s.withColumn("score", F.round("score", 5)), 5)


@query()
def hash_embed_stats(spark, sf_dir):
    """Used buckets and largest value of each document's hashed embedding."""
    b = chunking.hash_buckets(table(spark, sf_dir, "documents"))
    return b.groupBy("doc_id").agg(F.count("*").alias("buckets"), F.round(F.max("value"), 6).alias("largest"), F.round(F.sum(F.col("value") * F.col("value")), 6).alias("square"))
