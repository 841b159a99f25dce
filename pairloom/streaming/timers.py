"""Jobs that come back by themselves: state timers over a stream of signs of life.

A job whose worker has been silent for more than ``stale`` seconds goes back to the queue at that very moment of event time, or has failed once
its attempts are used up; after that it is let go. Nobody has to ask: the state registers a timer for each job in work. What is
emitted depends on the signs alone, not on how they are cut into micro-batches: silence between two signs of one batch is found
in their order, and silence after the last one by the timer.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pairloom.operators.jobs import MAX_ATTEMPTS, STALE_SECONDS

RETURNS = "key string, due_ms long, attempts int, status string"


@contextlib.contextmanager
def timed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that timers need, while a query is started."""
    key, conf = "spark.sql.streaming.stateStore.providerClass", spark.conf
    before = conf.get(key, None)
    conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


class Returns(StatefulProcessor):
    """State of a job: its last sign of life (milliseconds; none while it is not in work) and how often it has come back."""

    def __init__(self, stale_ms: int, attempts: int):
        self.stale_ms, self.attempts = stale_ms, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "last long, returns int")

    def _told(self, key: tuple, due: list[tuple[int, int]]) -> Iterator[pd.DataFrame]:
        if due:
            yield pd.DataFrame([(key[0], at, n, "FAILED" if n >= self.attempts else "PENDING") for at, n in due], columns=[c.split()[0] for c in RETURNS.split(", ")])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        last, n = self.state.get() or (None, 0)
        due = []
        for at in sorted(int(x) for part in rows for x in part["at_ms"]):
            if last is not None and at - last > self.stale_ms:
                n += 1
                due.append((last + self.stale_ms, n))
            last = at if n < self.attempts else None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if last is not None:
            self.handle.registerTimer(last + self.stale_ms)
        self.state.update((last, n))
        yield from self._told(key, [d for d in due if d[1] <= self.attempts])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        last, n = self.state.get() or (None, 0)
        if last is None:
            return
        self.state.update((None, n + 1))
        yield from self._told(key, [(last + self.stale_ms, n + 1)])

    def close(self) -> None:
        """Nothing is held besides the state."""


def returning(signs: DataFrame, stale: float = STALE_SECONDS, attempts: int = MAX_ATTEMPTS, late: str = "0 seconds") -> DataFrame:
    """key, due_ms, attempts, status of every job that comes back. signs: a stream of key and ``at`` (timestamp). Start the query within
    ``timed_state``."""
    timed = signs.selectExpr("key", "at", "unix_millis(at) as at_ms").withWatermark("at", late)
    return timed.groupBy("key").transformWithStateInPandas(Returns(int(stale * 1000), attempts), outputStructType=RETURNS, outputMode="Append", timeMode="EventTime")
