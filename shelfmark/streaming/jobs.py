"""The job queue as a stream: events come in, and each job's state is kept with a lease that runs out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from shelfmark.operators.jobs import LEASE_MINUTES, RETRIES

STATE = "status string, attempts int, started_ms bigint"
OUTPUT = "job string, seq bigint, status string, attempts int"


def transition(status: str, attempts: int, event: str, retries: int = RETRIES) -> tuple[str, int]:
    """State after an event: claims count as attempts, and a failure is tried again while attempts are left."""
    if event == "running":
        return ("running", attempts + 1) if status == "pending" else (status, attempts)
    if event == "failed":
        return ("pending" if attempts < retries else "failed"), attempts
    return event, attempts


class JobStates(StatefulProcessor):
    """Emits the state of a job after each of its events, and a pending state when its lease runs out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, attempts, started = self.state.get() if self.state.exists() else ("pending", 0, None)
        events = pd.concat(list(rows)).sort_values("seq")
        out = []
        for e in events.itertuples():
            status, attempts = transition(status, attempts, e.status)
            started = int(e.ts.timestamp() * 1000) if status == "running" else None
            out.append((key[0], e.seq, status, attempts))
        self.state.update((status, attempts, started))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if started is not None:
            self.handle.registerTimer(started + LEASE_MINUTES * 60_000)
        yield pd.DataFrame(out, columns=["job", "seq", "status", "attempts"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, attempts, _ = self.state.get()
        if status == "running":
            self.state.update(("pending", attempts, None))
            yield pd.DataFrame([(key[0], None, "pending", attempts)], columns=["job", "seq", "status", "attempts"])

    def close(self) -> None:
        pass


def job_states(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """States from a stream of events (job, seq, status, ts); needs the RocksDB state store."""
    marked = events.select(F.col("job").cast("string").alias("job"), "seq", "status", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return marked.groupBy("job").transformWithStateInPandas(JobStates(), OUTPUT, "append", "EventTime")


def status_stream(events: DataFrame, late: str = "1 hour", every: str = "1 hour") -> DataFrame:
    """Events by window and status."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "status").agg(F.count("*").alias("events"))
