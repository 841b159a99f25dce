"""The best documents by BM25 without all pairs."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from pairloom.operators import blocks, ranking
from pairloom.operators import bm25 as lex
from pairloom.plans import catalogue


@pytest.mark.parametrize("blocks", [1, 3])
def test_best_pairs_are_those_of_all_pairs(spark, monkeypatch, blocks):
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(words[min(int(r.expovariate(0.15)), 39)] for _ in range(n))
    docs = spark.createDataFrame([(i, text(r.randint(0, 30))) for i in range(300)] + [(900, None), (901, "w1 w1"), (902, "w1 w1")], "doc_id long, text string").repartition(5)
    queries = spark.createDataFrame([(i, text(4)) for i in range(12)] + [(50, "unknown words"), (51, None), (52, "w1 w1 w2")], "query_id long, text string")
    if blocks > 1:
        monkeypatch.setattr(lex, "BROADCAST_BYTES", 96 * 20)
    monkeypatch.setattr(lex, "SLICE", 64)
    rounded = lambda s: s.withColumn("score", F.round("score", 4))
    top = lambda s: {tuple(x) for x in ranking.ranked(rounded(s), 4).select("query_id", "doc_id", "score", "rank").collect()}
    every, best = lex.bm25(docs, queries), lex.bm25_best(docs, queries, 4, slack=1e-4)
    assert top(best) == top(every) and best.count() < every.count()
    assert lex.bm25_best(docs, queries.filter("query_id = 50"), 4).count() == 0
    with pytest.raises(ValueError, match="empty"):
        lex.bm25_best(docs.limit(0), queries, 4)


def _corpus(spark, seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    text = lambda k: " ".join(words[min(int(r.expovariate(0.1)), 59)] for _ in range(k))
    docs = [(i, text(r.randint(0, 40))) for i in range(n)] + [(9000, None), (9001, ""), (9002, "w59 w59"), (9003, "w59 w59")]
    queries = [(i, text(r.randint(1, 6))) for i in range(12)] + [(50, "unknown words"), (51, None), (52, "w0 w0 w1"), (53, "w59 w0 w1 w2")]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(queries, "query_id long, text string")


@pytest.mark.parametrize(("block", "k", "seed"), [(8, 1, 1), (8, 4, 2), (32, 4, 3), (4, 500, 4)])
def test_blocks_find_what_all_pairs_find(spark, tmp_path, monkeypatch, block, k, seed):
    monkeypatch.setattr(blocks, "BLOCK", block)
    docs, queries = _corpus(spark, seed, 250)
    rounded = lambda s: s.withColumn("score", F.round("score", 4))
    top = lambda s: {tuple(x) for x in ranking.ranked(rounded(s), k).select("query_id", "doc_id", "score", "rank").collect()}
    blocks.BlockIndex(spark, str(tmp_path)).write(docs)
    best, read = blocks.BlockIndex(spark, str(tmp_path)).search(queries, k, slack=1e-4)
    assert top(best) == top(lex.bm25(docs, queries))
    assert read == 1.0 if k == 500 else read < 0.8


def test_a_term_of_all_documents_lies_in_many_bounded_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 8)
    docs = spark.range(2000).selectExpr("id as doc_id", "concat('hot ', repeat('x ', cast(id % 7 as int)), 'r', id) as text")
    index = blocks.BlockIndex(spark, str(tmp_path)).write(docs)
    hot = index._read("blocks").filter("term = 'hot'").agg(F.count("*").alias("blocks"), F.sum("n").alias("n"), F.max("n").alias("most")).first()
    assert hot.n == 2000 and hot.blocks > 30 and hot.most < 200
    found, read = index.search(spark.createDataFrame([(1, "hot r77")], "query_id long, text string"), 1)
    assert [r.doc_id for r in found.collect()] == [77] and read < 0.1


def test_blocks_of_an_empty_corpus_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="empty"):
        blocks.BlockIndex(spark, str(tmp_path)).write(spark.createDataFrame([], "doc_id long, text string"))


def test_the_mean_idf_of_many_terms_has_no_rounding_of_a_long_sum(spark):
    posts = spark.range(400_000).select(F.col("id").cast("string").alias("term")).unionByName(spark.range(6).select(F.lit("common").alias("term")))
    alike, common = math.log(6.5) - math.log(1.5), math.log(1.5) - math.log(6.5)
    mean = float((400_000 * Fraction(alike) + Fraction(common)) / 400_001)
    assert lex.idf_table(posts, 7).filter("term = 'common'").first().idf == pytest.approx(mean * lex.EPSILON, rel=1e-15, abs=0)


def test_pairs_to_score_meet_no_terms_in_a_join(spark, tmp_path):
    docs, queries = _corpus(spark, 3, 300)
    index = blocks.BlockIndex(spark, str(tmp_path / "index")).write(docs)
    weights = queries.select("query_id", F.explode(F.split("text", " ")).alias("term")).filter("term <> ''").groupBy("query_id", "term").agg(F.count("*").alias("times"))
    asked = weights.join(lex.idf_table(lex.postings(docs), docs.count()), "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("w"))
    pairs = docs.select("doc_id").crossJoin(queries.select("query_id")).filter("(doc_id + query_id) % 3 = 0").select("query_id", "doc_id")
    got = index._scored(pairs, asked)
    joined = got._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count("Join ") == 1 and "term#" not in joined.split("Join ")[0]
    want = lex.bm25(docs, queries).join(pairs, ["query_id", "doc_id"])
    key = lambda d: {(r.query_id, r.doc_id): r.score for r in d.collect()}
    assert key(got) == pytest.approx(key(want)) and len(key(want)) > 100


@pytest.mark.parametrize("name", ["bm25_full_grid", "bm25_topk", "bm25_blocks_topk"])
def test_null_texts_and_dotted_capitals_count_as_in_the_sql(spark, tmp_path, name):
    docs = [(i, f"the plan of w{i} and w{i % 7}") for i in range(40)] + [(50, None), (51, None), (52, ""), (53, "\u0130stanbul \u0130 plan"), (54, "istanbul the the")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "istanbul plan w3"), (2, "\u0130STANBUL the"), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    view = duckdb.connect()
    for t in ("documents", "benchmark"):
        view.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = view.execute(f"select query_id, doc_id, score, rank from ({catalogue.ORACLE_SQL[name]})").fetchall()
    got = catalogue.QUERIES[name](spark, str(tmp_path)).select("query_id", "doc_id", "score", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(want) != []
    nothing = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert lex.bm25(nothing, nothing.withColumnRenamed("doc_id", "query_id")).count() == 0
