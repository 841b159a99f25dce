"""Top-k, score normalisation and fusion over long tables (query_id, doc_id, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pairloom.functions.vectors import clamp01
from pairloom.operators.staging import maybe_broadcast, staged

DIGITS = 6


def ranked(scores: DataFrame, k: int | None = None, score: str = "score", query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """``rank`` by falling score, ties by id; with k, the window becomes a partial and a final group limit."""
    out = scores.withColumn("rank", F.row_number().over(W.partitionBy(query).orderBy(F.desc(score), F.asc(doc))))
    return out.filter(F.col("rank") <= k) if k else out


def ranked_near(scores: DataFrame, k: int, digits: int, share: int = 16) -> DataFrame:
    """``ranked`` with k over scores rounded to so many digits, where pairs are many and are cheaper made twice than sorted: the k best of
    a share of the documents give each query a mark that its k best reach, and only pairs that reach it are rounded and sorted."""
    rounded = lambda d: d.withColumn("score", F.round("score", digits))
    some = ranked(rounded(scores.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)), k)
    marks = staged(some.groupBy("query_id").agg(F.count("score").alias("n"), F.min("score").alias("mark")).filter(F.col("n") == k).select("query_id", "mark"))
    near = scores.join(maybe_broadcast(marks, 32), "query_id", "left").filter(F.col("mark").isNull() | (F.col("score") >= F.col("mark") - 10.0**-digits))
    return ranked(rounded(near.drop("mark")), k)


def stable_ranked(scores: DataFrame, ordinal: str, k: int | None = None) -> DataFrame:
    """``rank`` by falling score alone; ties keep the source's order, which ``ordinal`` carries."""
    out = scores.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc(ordinal))))
    return out.filter(F.col("rank") <= k) if k else out


def min_max(score: str, by: str = "query_id") -> Column:
    """Scaled to 0..1 within a query; a constant becomes 1. ``over_all`` scales over all rows."""
    w = W.partitionBy(by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi - lo <= 0, 1.0).otherwise((F.col(score) - lo) / (hi - lo))


def fuse(semantic: DataFrame, keyword: DataFrame | None, alpha: float = 0.5) -> DataFrame:
    """query_id, doc_id, score over the union of both sides; without keyword scores the semantic ones are only clamped."""
    if keyword is None:
        return semantic.select("query_id", "doc_id", clamp01(F.col("score")).alias("score"))
    a = min(max(alpha, 0.0), 1.0)
    both = semantic.select("query_id", "doc_id", F.col("score").alias("s")).join(keyword.select("query_id", "doc_id", F.col("score").alias("k")), ["query_id", "doc_id"], "full_outer")
    both = both.withColumns({"s": F.coalesce("s", F.lit(0.0)), "k": F.coalesce("k", F.lit(0.0))})
    return both.withColumn("score", min_max("s") * a + min_max("k") * (1 - a)).select("query_id", "doc_id", "score")


def fuse_raw(semantic: DataFrame, keyword: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Weighted sum without scaling."""
    both = semantic.select("query_id", "doc_id", F.col("score").alias("s")).join(keyword.select("query_id", "doc_id", F.col("score").alias("k")), ["query_id", "doc_id"], "full_outer")
    return both.select("query_id", "doc_id", (F.coalesce("s", F.lit(0.0)) * alpha + F.coalesce("k", F.lit(0.0)) * (1 - alpha)).alias("score"))


def alpha_sweep(semantic: DataFrame, keyword: DataFrame, alphas: tuple[float, ...] = (0.0, 0.2, 0.4, 0.5, 0.6, 0.8, 1.0)) -> DataFrame:
    """alpha, query_id, doc_id, score: both sides are scaled once and met with every alpha."""
    both = semantic.select("query_id", "doc_id", F.col("score").alias("s")).join(keyword.select("query_id", "doc_id", F.col("score").alias("k")), ["query_id", "doc_id"], "full_outer")
    both = both.withColumns({"s": F.coalesce("s", F.lit(0.0)), "k": F.coalesce("k", F.lit(0.0))}).withColumns({"s": min_max("s"), "k": min_max("k")})
    return both.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas]))).select("alpha", "query_id", "doc_id", (F.col("alpha") * F.col("s") + (1 - F.col("alpha")) * F.col("k")).alias("score"))


def over_all(scores: DataFrame, *columns: str, eps: float = 1e-8) -> DataFrame:
    """Columns scaled by their range over all rows, which comes from one aggregated row and not from a window."""
    ends = scores.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = {c: (F.col(c) - F.col(f"__lo_{c}")) / (F.col(f"__hi_{c}") - F.col(f"__lo_{c}") + eps) for c in columns}
    return scores.crossJoin(F.broadcast(ends)).withColumns(scaled).drop(*ends.columns)


def global_hybrid(first: DataFrame, second: DataFrame, share: float = 0.6) -> DataFrame:
    """query_id, doc_id, score of pairs that both sides score: each scaled over all pairs, then weighed."""
    both = first.select("query_id", "doc_id", F.col("score").alias("a")).join(second.select("query_id", "doc_id", F.col("score").alias("b")), ["query_id", "doc_id"])
    return over_all(both, "a", "b").select("query_id", "doc_id", (share * F.col("a") + (1 - share) * F.col("b")).alias("score"))


def pool_union(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Ordered distinct union of the first k/2 of two rankings: query_id, doc_id, pos."""
    half = k // 2
    one = first.filter(F.col("rank") <= half).select("query_id", "doc_id", F.col("rank").alias("pos"))
    two = second.filter(F.col("rank") <= k - half).select("query_id", "doc_id", (F.col("rank") + half).alias("pos"))
    return one.unionByName(two).groupBy("query_id", "doc_id").agg(F.min("pos").alias("pos"))


def cascade(ranking: DataFrame, rescored: DataFrame, k: int) -> DataFrame:
    """The first k by another score (query_id, doc_id, new_score), the rest behind them unchanged."""
    joined = ranking.join(rescored, ["query_id", "doc_id"], "left")
    head = F.col("rank") <= k
    order = W.partitionBy("query_id").orderBy(F.when(head, 0).otherwise(1), F.desc(F.when(head, F.coalesce("new_score", F.lit(-1.0)))), "rank")
    return joined.withColumn("rank", F.row_number().over(order))
