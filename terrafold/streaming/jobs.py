"""Streaming twins of the job operators: an extension, as the batch forms are what records need."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import TRANSITIONS


def create_once(requests: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """The first request of each key; keys are forgotten `delay` after they were seen, which bounds the state."""
    return requests.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, retries, illegal = state.get if state.exists else ("QUEUED", 0, 0)
    events = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    for event in events["event"]:
        needs, leads = TRANSITIONS.get(event, (None, None))
        if status == needs:
            status, retries = leads, retries + (event in ("retry", "recover"))
        else:
            illegal += 1
    state.update((status, retries, illegal))
    yield pd.DataFrame({"job_id": [key[0]], "status": [status], "retry_count": [retries], "illegal": [illegal]})


def state_changes(events: DataFrame) -> DataFrame:
    """Current state of each job after every micro-batch: events (job_id, ts, event_id, event) in order within a batch."""
    rows = events.select(F.col("job_id").cast("long"), "ts", F.col("event_id").cast("long"), "event")
    return rows.groupBy("job_id").applyInPandasWithState(_fold, "job_id long, status string, retry_count int, illegal int", "status string, retry_count int, illegal int", "update", GroupStateTimeout.NoTimeout)
