"""Batch views of the job table: claiming, staleness, statistics. The streaming state machine is in streaming/jobs.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

STATUSES = ("PENDING", "PROCESSING", "READY", "FAILED", "CANCELLED")
# Progress of the steps; errors that no retry mends; retry settings.
PROGRESS = {"QUEUED": 5, "EXTRACTING": 25, "PARSING": 55, "INDEXING": 85, "FINALIZING": 95}
PERMANENT = ("CV_FILE_REQUIRED", "CV_FILE_INVALID", "CV_FILE_TOO_LARGE", "CV_TEXT_EMPTY", "CV_ENCRYPTED")
MAX_ATTEMPTS, STALE_SECONDS, BASE_DELAY = 3, 300.0, 1.0


def backoff(attempt: Column, base: float = BASE_DELAY) -> Column:
    return F.lit(base) * F.pow(F.lit(2.0), attempt - 1)


def progress(status: Column, step: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in PROGRESS.items() for x in kv])
    return F.when(status == "READY", 100).otherwise(F.coalesce(table[step], F.lit(0)))


def claim_order(jobs: DataFrame, now: float) -> DataFrame:
    """Due pending jobs in the order in which they are claimed. Places are counted in two levels, hours and then jobs of an hour."""
    due = jobs.filter((F.col("status") == "PENDING") & (F.coalesce("next_attempt_at", F.lit(0.0)) <= now)).withColumn("__hour", F.floor(F.col("created_at") / 3600))
    return numbered(due, "__hour", ["created_at", "id"], "place").drop("__hour")


def numbered(rows: DataFrame, range_: str, order: list[str], name: str) -> DataFrame:
    """The rows with their place, from 1, in an order that ``range_`` begins: windows see one row for each range, or one range."""
    before = W.orderBy(range_).rowsBetween(W.unboundedPreceding, -1)
    ahead = rows.groupBy(range_).agg(F.count("*").alias("__n")).select(range_, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__ahead"))
    within = F.row_number().over(W.partitionBy(range_).orderBy(*order))
    return rows.withColumn("__in", within).join(ahead, range_).withColumn(name, F.col("__in") + F.col("__ahead")).drop("__in", "__ahead")


def requeue_stale(jobs: DataFrame, now: float, age: float = STALE_SECONDS, attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Jobs that stand in PROCESSING too long become PENDING, or FAILED when their attempts are used up."""
    stale = (F.col("status") == "PROCESSING") & (F.col("updated_at") < now - age)
    return jobs.withColumn("new_status", F.when(stale & (F.col("attempt_count") >= attempts), "FAILED").when(stale, "PENDING").otherwise(F.col("status")))


def count_by_status(jobs: DataFrame) -> DataFrame:
    """A row for each status, 0 where none has it."""
    every = jobs.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return every.join(jobs.groupBy("status").agg(F.count("*").alias("jobs")), "status", "left").select("status", F.coalesce("jobs", F.lit(0).cast("long")).alias("jobs"))


def durations(jobs: DataFrame) -> DataFrame:
    """One row over READY jobs: nearest-rank percentiles and the mean."""
    ms = F.when(F.col("status") == "READY", F.col("duration_ms"))
    return jobs.agg(F.expr("percentile_disc(0.5) within group (order by case when status = 'READY' then duration_ms end)").alias("p50"), F.expr("percentile_disc(0.95) within group (order by case when status = 'READY' then duration_ms end)").alias("p95"), F.round(F.avg(ms), 1).alias("avg"))


def oldest_pending(jobs: DataFrame, now: float) -> DataFrame:
    return jobs.filter("status = 'PENDING'").agg((F.lit(now) - F.min("created_at")).alias("age"))
