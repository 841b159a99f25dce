"""Ranking metrics over a run (query_id, doc_id, score or rank) and qrels (query_id, doc_id, grade), by windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def graded(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run with each document's grade, 0 where it has none."""
    return run.join(qrels.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def gain(grade: str = "grade"):
    return F.pow(F.lit(2.0), F.col(grade)) - 1


def per_query(run: DataFrame, qrels: DataFrame, k: int = 10, threshold: int = 2) -> DataFrame:
    """query_id, ndcg, precision, recall, rr, ap of every query with qrels; one pass over the run's windows.

    The ideal ranking is that of the positive grades; precision divides by k however few came back; recall and average
    precision divide by all relevant documents of the qrels.
    """
    g = graded(run, qrels)
    hit = (F.col("grade") >= threshold).cast("int")
    seen = F.sum(hit).over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    g = g.withColumns({"hit": hit, "seen": seen})
    top = F.col("rank") <= k
    got = g.groupBy("query_id").agg(
        F.sum(F.when(top, gain() / F.log2(F.col("rank") + 1))).alias("dcg"),
        F.sum(F.when(top, F.col("hit"))).alias("hits"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("hit") == 1, F.col("seen") / F.col("rank"))).alias("psum"),
    )
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id"))
    ideal = qrels.filter("grade > 0").withColumn("place", place).groupBy("query_id").agg(
        F.sum(F.when(F.col("place") <= k, gain() / F.log2(F.col("place") + 1))).alias("idcg"), F.sum((F.col("grade") >= threshold).cast("int")).alias("relevant")
    )
    none = F.lit(0.0)
    every = qrels.select("query_id").distinct().join(ideal, "query_id", "left").join(got, "query_id", "left")
    return every.select(
        "query_id",
        F.when(F.col("idcg") > 0, F.coalesce("dcg", none) / F.col("idcg")).otherwise(0.0).alias("ndcg"),
        (F.coalesce("hits", F.lit(0)) / F.lit(k)).alias("precision"),
        F.when(F.col("relevant") > 0, F.least(F.lit(1.0), F.coalesce("hits", F.lit(0)) / F.col("relevant"))).otherwise(0.0).alias("recall"),
        F.coalesce(1 / F.col("first"), none).alias("rr"),
        F.when(F.col("relevant") > 0, F.coalesce("psum", none) / F.col("relevant")).otherwise(0.0).alias("ap"),
    )


def table(metrics: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Means over queries, four digits."""
    return metrics.groupBy(*by).agg(*[F.round(F.avg(m), 4).alias(m) for m in ("ndcg", "precision", "recall", "rr", "ap")], F.count("*").alias("queries"))


def pool_recall(run: DataFrame, qrels: DataFrame, sizes: tuple[int, ...] = (20, 50, 100), threshold: int = 1) -> DataFrame:
    """query_id, size, recall: the share of a query's positives within the first rows of a pool."""
    positives = qrels.filter(F.col("grade") >= threshold)
    n = positives.groupBy("query_id").agg(F.count("*").alias("positives"))
    hits = run.join(positives.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    counted = hits.groupBy("query_id").agg(*[F.sum((F.col("rank") <= s).cast("int")).alias(str(s)) for s in sizes])
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("size"), F.coalesce(F.col(f"`{s}`"), F.lit(0)).alias("found")) for s in sizes]))
    return n.join(counted, "query_id", "left").select("query_id", "positives", pairs.alias("p")).select("query_id", F.col("p.size").alias("size"), (F.col("p.found") / F.col("positives")).alias("recall"))


def recall_ceiling(qrels: DataFrame, k: int = 10, threshold: int = 1) -> DataFrame:
    """One row: the best mean recall that k rows allow."""
    n = qrels.filter(F.col("grade") >= threshold).groupBy("query_id").agg(F.count("*").alias("positives"))
    return n.agg(F.avg(F.least(F.lit(1.0), F.lit(float(k)) / F.col("positives"))).alias("ceiling"), F.count("*").alias("queries"))
