"""The processing-job state machine over a stream of commands, one state per (type, id, version).

PENDING goes to PROCESSING, that to READY, FAILED or (with a delay) back to PENDING; FAILED can be retried, PENDING be
cancelled, and a new request for a finished failure starts it again. Commands that do not fit the state change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pairloom.operators.jobs import BASE_DELAY, MAX_ATTEMPTS, PERMANENT

STATE = "status string, step string, attempts int, next_at double, created double, started double, finished double, hash string"
OUTPUT = f"key string, {STATE}, applied int"
ACTIVE = ("PENDING", "PROCESSING", "READY")


def step(state: tuple | None, command: dict) -> tuple | None:
    """The state after one command (kind, at, error, step, hash); the same object where it does not apply."""
    kind, at = command["kind"], float(command["at"])
    if state is None:
        return ("PENDING", "QUEUED", 0, at, at, None, None, None) if kind == "create" else None
    status, where, attempts, next_at, created, started, finished, digest = state
    if kind == "create" and status not in ACTIVE:
        return ("PENDING", "QUEUED", 0, at, created, None, None, None)
    if kind == "claim" and status == "PENDING" and (next_at is None or next_at <= at):
        return ("PROCESSING", "EXTRACTING", attempts + 1, next_at, created, started if started is not None else at, None, digest)
    if status == "PROCESSING":
        if kind == "step":
            return (status, command.get("step") or where, attempts, next_at, created, started, finished, command.get("hash") or digest)
        if kind == "ready":
            return ("READY", "FINALIZING", attempts, None, created, started, at, digest)
        if kind in ("error", "stale"):
            if attempts >= MAX_ATTEMPTS or command.get("error") in PERMANENT:
                return ("FAILED", where, attempts, None, created, started, at, digest)
            delay = BASE_DELAY * 2 ** (attempts - 1) if kind == "error" else 0.0
            return ("PENDING", "QUEUED", attempts, at + delay, created, started, None, digest)
    if kind == "retry" and status == "FAILED":
        return ("PENDING", "QUEUED", 0, at, created, started, None, digest)
    if kind == "cancel" and status == "PENDING":
        return ("CANCELLED", where, attempts, None, created, started, at, digest)
    return state


def run_jobs(commands: DataFrame) -> DataFrame:
    """key and state after each micro-batch of commands (key, seq, kind, at, error, step, hash); works on a stream, with
    state in the state store, and a batch alike."""

    def fold(key: str, rows: pd.DataFrame, state: tuple | None) -> tuple[tuple | None, int]:
        applied = 0
        for c in rows.sort_values("seq").to_dict("records"):
            new = step(state, {k: (None if isinstance(v, float) and v != v else v) for k, v in c.items()})
            applied += new is not state
            state = new
        return state, applied

    if not commands.isStreaming:

        def batch(pdf: pd.DataFrame) -> pd.DataFrame:
            state, applied = fold(pdf["key"].iloc[0], pdf, None)
            rows = [(pdf["key"].iloc[0], *state, applied)] if state else []
            return pd.DataFrame(rows, columns=["key", *[x.split()[0] for x in STATE.split(", ")], "applied"])

        return commands.groupBy("key").applyInPandas(batch, OUTPUT)

    def stream(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, applied = (state.get if state.exists else None), 0
        current, applied = fold(key[0], pd.concat(list(parts)), current)
        if current is not None:
            state.update(current)
            yield pd.DataFrame([(key[0], *current, applied)], columns=["key", *[x.split()[0] for x in STATE.split(", ")], "applied"])

    return commands.groupBy("key").applyInPandasWithState(stream, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)
