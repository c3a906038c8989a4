"""Documents on their way through the stages of ingestion, as a stream: a state a document, retries, and a timer for those that stall."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "stage int, failures int, n long, at_us long, event_id long"
STATUS = "document_id long, stage int, failures int, n long, status string"


def status_of(stage: int, failures: int, last: int, most_failures: int) -> str:
    if failures >= most_failures:
        return "failed"
    if failures:
        return "retrying"
    return "ready" if stage >= last else "processing"


def staged(events: DataFrame, last: int, most_failures: int = 3, stalled_after: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """document_id, stage, failures, n, status: a row whenever a batch has events of a document, or its timer has run out.

    ``events``: document_id, stage (from 1 to ``last``; 0 for an attempt that failed), ts, event_id. The stage is the furthest reached; failures
    count since the last success, and ``most_failures`` of them fail the document, until one succeeds. A document that is neither ready nor
    failed and has no event for ``stalled_after`` of event time is stalled, until one comes. Events of a batch are taken in the order of
    their time and id; one that is older than what the state has seen counts, and can raise the stage, but changes no failures; one that is
    later than ``delay`` allows is dropped.
    The state is as large for any number of events, and a stream that starts again goes on from its checkpoint.
    """
    wait_ms = int(pd.Timedelta(stalled_after).total_seconds() * 1000)

    def step(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stage, failures, n, at_us, event_id = state.get if state.exists else (0, 0, 0, -(2**62), -1)
        stalled = state.hasTimedOut
        if not stalled:
            rows = pd.concat([p[["ts", "event_id", "stage"]] for p in parts]).sort_values(["ts", "event_id"])
            for when, number, reached in zip((rows["ts"].astype("datetime64[us]").astype("int64")).tolist(), rows["event_id"].tolist(), rows["stage"].tolist(), strict=True):
                n, stage = n + 1, max(stage, reached)
                if (when, number) > (at_us, event_id):
                    at_us, event_id, failures = when, number, 0 if reached else failures + 1
            state.update((stage, failures, n, at_us, event_id))
        status = status_of(stage, failures, last, most_failures)
        if status in ("processing", "retrying"):
            if stalled:
                status = "stalled"
            else:
                state.setTimeoutTimestamp(max(at_us // 1000 + wait_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"document_id": [key[0]], "stage": [stage], "failures": [failures], "n": [n], "status": [status]})

    rows = events.filter(F.col("document_id").isNotNull() & F.col("ts").isNotNull()).select("document_id", F.col("stage").cast("int").alias("stage"), "ts", "event_id").withWatermark("ts", delay)
    return rows.groupBy("document_id").applyInPandasWithState(step, STATUS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
