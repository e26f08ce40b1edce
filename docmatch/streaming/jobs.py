"""Job status over a stream of ledger events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "project_id string, status string, created_at timestamp, updated_at timestamp"
OUTPUT = f"job_id string, {STATE}, timed_out boolean"


def ends(ts: pd.Series) -> tuple[int, pd.Timestamp]:
    """The place of the first latest time, and the earliest time; missing times count for neither.

    A job has few events in a slice, so what is spent per slice counts, not per event.
    """
    values = ts.to_numpy()
    if ts.hasnans:
        return ts.index.get_loc(ts.idxmax()), ts.min()
    if len(values) == 1:
        return 0, ts.iat[0]
    return int(values.argmax()), ts.iat[int(values.argmin())]


def job_state(events: DataFrame, *, watermark: str, timeout_seconds: int, ttl_seconds: int = 7 * 86_400) -> DataFrame:
    """Latest status per job, and a failure for jobs still pending after the timeout.

    ``events`` is a stream of ``(job_id, project_id, status, ts)``. Emits a row per job and
    micro-batch that changed it. State is one small record per job; a job's events arrive in slices
    and are reduced slice by slice, so a very busy job needs no memory for its events. Only pending
    jobs time out. Every other job, a finished one too, keeps its record until nothing has been heard
    of it for ``ttl_seconds``, so a late event still meets the job's first and last time.
    """
    def step(key: tuple, slices: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        project, status, created, updated = state.get if state.exists else (None, None, None, None)
        if state.hasTimedOut:
            if status == "pending":
                state.update((project, "failed", created, updated))
                state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + ttl_seconds * 1000)
                yield pd.DataFrame([(key[0], project, "failed", created, updated, True)], columns=_COLUMNS)
            else:
                state.remove()
            return
        for part in slices:
            at, first = ends(part["ts"])
            created = first if created is None else min(created, first)
            last = part["ts"].iat[at]
            if updated is None or last >= updated:
                project, status, updated = part["project_id"].iat[at], part["status"].iat[at], last
        state.update((project, status, created, updated))
        start, wait = (created, timeout_seconds) if status == "pending" else (updated, ttl_seconds)
        due = int(start.timestamp() * 1000) + wait * 1000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], project, status, created, updated, False)], columns=_COLUMNS)

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return timed.groupBy("job_id").applyInPandasWithState(
        step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


_COLUMNS = ["job_id", "project_id", "status", "created_at", "updated_at", "timed_out"]
