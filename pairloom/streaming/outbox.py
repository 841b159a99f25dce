"""The ordered event log: compaction, cursors, and its application to the vector store by Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pairloom.operators.ledger import MOST
from pairloom.operators.store import KEY, SnapshotStore
from pairloom.schemas import DOC_TYPES, EVENT

ACTIONS, MAX_VERSION = ("upsert", "delete"), 1000


def valid() -> Column:
    """Whether an event is well-formed; others go to a table of their own and never hold the log up."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.coalesce(F.col("doc_type").isin(*DOC_TYPES) & F.col("action").isin(*ACTIONS) & ~blank("event_id") & ~blank("doc_id") & F.col("version").between(1, MAX_VERSION), F.lit(False))


def since(log: DataFrame, cursor: int, most: int | None = None) -> DataFrame:
    """Events behind the cursor (1-based line numbers), at most so many, in order."""
    out = log.filter(F.col("line_no") > cursor).orderBy("line_no")
    return out.limit(most) if most else out


def compacted(log: DataFrame, order: str = "line_no") -> DataFrame:
    """The last event of each document: what the state depends on."""
    rest = [c for c in log.columns if c not in ("doc_type", "doc_id")]
    return log.groupBy("doc_type", "doc_id").agg(F.max_by(F.struct(*rest), order).alias("e")).select("doc_type", "doc_id", "e.*")


def read_log(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", per_trigger).json(path)


def effects(events: DataFrame) -> DataFrame:
    """What a batch of events does to each document, in whatever batches the log comes: its deletes, and the upserts that stand at
    the end (live). An upsert ends lower versions and its own, not higher ones; so it stands if no delete and no upsert of the
    same or a higher version follows. Events count in the order of their lines, and without line numbers in that of their times.

    Versions are few (``MAX_VERSION``), so a document's events are reduced to one for each version before they are ordered.
    """
    rest = [c for c in events.columns if c not in KEY]
    slot = F.when(F.col("action") == "upsert", F.col("version")).otherwise(0)
    place = F.struct("line_no", "created_at", "version", "event_id")
    last = events.withColumns({"__slot": slot, "__place": place}).groupBy(*KEY, "__slot").agg(F.max_by(F.struct(*rest), "__place").alias("e"), F.max("__place").alias("__place"))
    whole = W.partitionBy(*KEY)
    cleared = F.max(F.when(F.col("__slot") == 0, F.col("__place"))).over(whole)
    later = F.max("__slot").over(whole.orderBy(F.desc("__place")).rowsBetween(W.unboundedPreceding, -1))
    live = (F.col("__slot") > 0) & (cleared.isNull() | (F.col("__place") > cleared)) & (F.coalesce(later, F.lit(0)) < F.col("__slot"))
    return last.withColumn("live", live).select(*KEY, "e.*", "live")


def apply_log(events: DataFrame, store: SnapshotStore, resolve: Callable[[DataFrame], DataFrame], checkpoint: str, rejected: str, loop_seconds: int | None = None):
    """Start the query that keeps the store in step with the log.

    Each micro-batch becomes one commit of its ``effects``: what it deletes, then what it leaves; the end state does not depend on where
    batches are cut. ``resolve`` turns upserts into vector rows; documents that it does not know drop out, and it decides so by the document,
    not the version. A batch that runs again is not committed again, and rejected events have a folder for each batch.
    """
    ids: list[str] = []

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        ids[:] = ids or [json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]]  # of the query, also after a restart
        df = df.persist()
        df.filter(~valid()).write.mode("overwrite").parquet(f"{rejected}/batch_id={batch_id}")
        done = effects(df.filter(valid())).persist()
        gone = done.filter("action = 'delete'").select(*KEY, F.lit(None).cast("int").alias("version"))
        store.apply(resolve(done.filter("live").drop("live")), gone, once=(ids[0], batch_id))
        if store.compact():
            store.prune(2 * MOST)
        done.unpersist()
        df.unpersist()

    writer = events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{loop_seconds} seconds") if loop_seconds else writer.trigger(availableNow=True)).start()


def activity(events: DataFrame, ts: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Event counts by window and type; duplicates within the watermark are dropped."""
    once = events.withWatermark(ts, late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "event_type", "events")
