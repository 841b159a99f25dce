"""The best k of fused scores, against the fusion of all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import fusion, matching, ranking


def sides(spark, seed, docs=60, words=0.3):
    r = random.Random(seed)
    vec = lambda: [r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]
    candidates = spark.createDataFrame([(i, vec()) for i in range(docs) if i % 7], "id long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(q, vec()) for q in range(4)], "id long, embedding array<float>")
    pairs = [(q, d, round(r.random() * 9, 2)) for q in range(6) for d in range(docs) if r.random() < words]
    return queries, candidates, spark.createDataFrame(pairs, "query_id long, doc_id long, score double")


def top(df, k):
    df = df.withColumn("score", F.round("score", 6))
    return {tuple(x) for x in ranking.ranked(df, k).select("query_id", "doc_id", "score", "rank").collect()}


@pytest.mark.parametrize(("seed", "words"), [(1, 0.3), (2, 0.0), (3, 1.0)])
def test_best_of_fused_scores_equal_the_fusion_of_all_pairs(spark, seed, words):
    queries, candidates, keyword = sides(spark, seed, words=words)
    sem = matching.similarities(queries, candidates).select("query_id", F.col("cand_id").alias("doc_id"), F.round("sim", 6).alias("score"))
    found = fusion.met(queries, candidates, keyword, 5, 1e-4, lambda x: np.round(x, 6))
    for alpha in (0.0, 0.3, 1.0):
        assert top(found.withColumn("score", fusion.scaled(alpha)), 5) == top(ranking.fuse(sem, keyword, alpha), 5), alpha
    raw = ranking.fuse_raw(sem, keyword, 0.4)
    assert top(found.withColumn("score", F.col("s") * 0.4 + F.col("k") * 0.6), 5) == top(raw, 5)
    assert found.select("query_id", "doc_id").distinct().count() == found.count()


def test_pairs_that_cannot_win_are_not_written(spark):
    queries, candidates, _ = sides(spark, 4, docs=2000)
    none = spark.createDataFrame([], "query_id long, doc_id long, score double")
    spread = candidates.withColumn("embedding", F.transform("embedding", lambda x: x + F.rand(1).cast("float")))
    assert fusion.met(queries, spread, none, 3).count() <= 4 * 3 * 2 * 8  # a few for each task, of 6,856 pairs
    assert fusion.met(queries, candidates.limit(0), none, 3).count() == 0
