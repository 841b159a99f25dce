"""The processing worker: a job table in a ledger, the run of claimed jobs as one plan, and the loop around it.

A round takes the due jobs in order, as many as the round may hold, and runs them together: texts are cleaned and hashed, what is
unchanged and still indexed is finished at once, the rest is parsed, indexed and finished. A job that fails alone goes
back to the queue with a delay, or fails for good when no retry mends it or its attempts are used up.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.text import clean_text, content_hash, format_error, merge_broken_lines
from pairloom.operators.indexing import Index
from pairloom.operators.jobs import BASE_DELAY, MAX_ATTEMPTS, PERMANENT, STALE_SECONDS, backoff, claim_order, requeue_stale
from pairloom.operators.ledger import MOST
from pairloom.operators.staging import staged
from pairloom.operators.store import SnapshotStore, indexed
from pairloom.schemas import JOB

#: Fixed value: a cleaned text must be as long.
LEAST_TEXT = 50
UNIQUE = ["document_type", "document_id", "version"]


class JobTable(SnapshotStore):
    """Jobs by document and version in a ledger. A change writes the rows that it changes; of two that change the same jobs one wins, and
    the other looks again, so any number of workers may share a table."""

    schema = JOB
    key = ("document_type", "document_id")

    def _replaced(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.key, F.col("version").alias("lo"), F.col("version").alias("hi"))

    def change(self, made: Callable[[DataFrame], DataFrame]) -> int:
        """Replace jobs by what ``made`` makes of the table; number of the commit, 0 where that is nothing."""
        return self.transact(lambda have: (made(have), self._replaced))

    def request(self, new: DataFrame, now: float) -> int:
        """Add requests (document_type, document_id, version, text, ...) as pending jobs; one for a job that is there changes nothing unless
        that has failed or was cancelled."""
        start = {"id": F.concat_ws(":", *[F.col(c).cast("string") for c in UNIQUE]), "status": F.lit("PENDING"), "step": F.lit("QUEUED"), "attempt_count": F.lit(0), "next_attempt_at": F.lit(now), "created_at": F.lit(now), "updated_at": F.lit(now)}
        fresh = new.dropDuplicates(UNIQUE).withColumns(start)
        return self.change(lambda have: fresh.join(have.filter(~F.col("status").isin("FAILED", "CANCELLED")).select(*UNIQUE), UNIQUE, "left_anti"))

    def claim(self, now: float, most: int) -> int:
        """Take the first due jobs into work; ``added`` of the number has them. No job is taken twice."""

        def taken(have: DataFrame) -> DataFrame:
            new = {"status": F.lit("PROCESSING"), "step": F.lit("EXTRACTING"), "attempt_count": F.col("attempt_count") + 1, "started_at": F.coalesce("started_at", F.lit(now)), "updated_at": F.lit(now)}
            return claim_order(have, now).filter(F.col("place") <= most).drop("place").withColumns(new)

        return self.change(taken)

    def requeue(self, now: float, stale: float = STALE_SECONDS, attempts: int = MAX_ATTEMPTS) -> int:
        """What a stopped worker left in work goes back to the queue, or has failed."""

        def freed(have: DataFrame) -> DataFrame:
            j = requeue_stale(have, now, stale, attempts).filter(F.col("new_status") != F.col("status"))
            return j.withColumns({"step": F.when(F.col("new_status") == "PENDING", "QUEUED").otherwise(F.col("step")), "status": F.col("new_status")}).drop("new_status")

        return self.change(freed)


def run(jobs: DataFrame, index: Index, parse: Callable[[Column], Column], skip_unchanged: bool = True) -> tuple[DataFrame, DataFrame]:
    """(outcomes, documents) of claimed jobs. outcomes: id, error (code or null), step, hash, warnings. documents: what is to be indexed, in
    the form of ``Index.put``. ``parse`` makes struct<payload:string,sections:map,error:string> out of a cleaned text."""
    cleaned = merge_broken_lines(clean_text(F.col("text")))
    j = jobs.withColumn("clean", cleaned).withColumn("hash", content_hash(F.col("clean")))
    empty = F.length("clean") < LEAST_TEXT
    have = indexed(index.vectors.current(), index.payloads.current()).select(F.col("doc_type").alias("document_type"), F.col("doc_id").alias("document_id"), "version", F.lit(True).alias("there"))
    j = j.join(have, UNIQUE, "left")
    reused = F.lit(skip_unchanged) & (F.col("content_hash") == F.col("hash")) & F.coalesce("there", F.lit(False))
    j = j.withColumns({"reused": F.coalesce(reused, F.lit(False)) & ~empty, "empty": empty})
    j = staged(j.withColumn("parsed", F.when(~F.col("empty") & ~F.col("reused"), parse(F.col("clean")))))
    error = F.when(F.col("empty"), "CV_TEXT_EMPTY").otherwise(F.col("parsed.error"))
    step = F.when(F.col("empty"), "EXTRACTING").when(F.col("parsed.error").isNotNull(), "PARSING").otherwise("FINALIZING")
    outcomes = j.select("id", error.alias("error"), step.alias("at_step"), "hash", F.when(F.col("reused"), F.to_json(F.array(F.lit("REUSED_INDEX")))).otherwise("[]").alias("notes"))
    docs = j.filter(F.col("parsed").isNotNull() & F.col("parsed.error").isNull()).select(
        F.col("document_id").alias("doc_id"), F.col("document_type").alias("doc_type"), F.lit("mixed").alias("lang"), F.col("clean").alias("raw_text"), "parsed.sections", "version",
        F.lit("READY").alias("status"), "visibility", "owner_id", "parsed.payload",
    )
    return outcomes, docs


def settled(jobs: DataFrame, outcomes: DataFrame, now: float, attempts: int = MAX_ATTEMPTS, base: float = BASE_DELAY) -> DataFrame:
    """The jobs after their outcomes: ready, back in the queue with a delay, or failed."""
    j = jobs.join(outcomes, "id", "left")
    ran, failed = F.col("at_step").isNotNull(), F.col("error").isNotNull()
    final = failed & (F.col("error").isin(*PERMANENT) | (F.col("attempt_count") >= attempts))
    ready, again = ran & ~failed, failed & ~final
    done = ready | final
    new = {
        "status": F.when(ready, "READY").when(final, "FAILED").when(again, "PENDING").otherwise(F.col("status")),
        "step": F.when(again, "QUEUED").when(ran, F.col("at_step")).otherwise(F.col("step")),
        "next_attempt_at": F.when(again, F.lit(now) + backoff(F.col("attempt_count"), base)).when(done, F.lit(None)).otherwise(F.col("next_attempt_at")),
        "last_error": F.when(failed, format_error(F.col("at_step"), F.col("error"), F.lit(""))).otherwise(F.col("last_error")),
        "content_hash": F.coalesce("hash", "content_hash"), "warnings": F.when(ready, F.col("notes")).otherwise(F.col("warnings")),
        "updated_at": F.when(ran, F.lit(now)).otherwise(F.col("updated_at")), "finished_at": F.when(done, F.lit(now)).otherwise(F.col("finished_at")),
        "duration_ms": F.when(done, ((F.lit(now) - F.col("started_at")) * 1000).cast("long")).otherwise(F.col("duration_ms")),
    }
    return j.withColumns(new).drop("error", "at_step", "hash", "notes")


class Worker:
    """Rounds over a job table, by hand, or in a loop that polls."""

    def __init__(self, spark: SparkSession, jobs: JobTable, index: Index, parse: Callable[[Column], Column], most: int = 1000, attempts: int = MAX_ATTEMPTS, stale: float = STALE_SECONDS):
        self.spark, self.jobs, self.index, self.parse = spark, jobs, index, parse
        self.most, self.attempts, self.stale, self.stopped = most, attempts, stale, False

    def requeue(self, now: float) -> None:
        """What a stopped worker left in work goes back to the queue."""
        self.jobs.requeue(now, self.stale, self.attempts)

    def round(self, now: float) -> int:
        """Claim the due jobs and run them; how many there were."""
        seq = self.jobs.claim(now, self.most)
        if not seq:
            return 0
        claimed = self.jobs.added(seq)
        outcomes, docs = run(claimed, self.index, self.parse)
        for version in [r.version for r in docs.select("version").distinct().orderBy("version").collect()]:
            self.index.put(docs.filter(F.col("version") == version), version)
        mine = claimed.select("id", "attempt_count", "updated_at", "status")  # a job that was taken away as stale is another worker's now
        self.jobs.change(lambda have: settled(have.join(mine, mine.columns, "left_semi"), outcomes, now, self.attempts))
        if self.jobs.compact():
            self.jobs.prune(2 * MOST)
        return claimed.count()

    def loop(self, poll: float = 1.0, clock: Callable[[], float] = time.time) -> None:
        """Until ``stopped``: a round at once while there is work, else after a pause. Starts with what was left in work."""
        self.requeue(clock())
        while not self.stopped:
            if not self.round(clock()):
                time.sleep(poll)
