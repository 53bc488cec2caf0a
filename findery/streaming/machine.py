"""Jobs as a state machine: leases, attempts and retries, over a table of events or as a stream with timers.

A job is created, claimed by a worker for the time of a lease, kept by heartbeats and progress, and ends as succeeded, failed
or canceled; a failed or canceled one may be retried while attempts are left.  A job whose lease runs out is stale, and
any worker may claim it.  Events count in order of (at, event_id); those that the job's state does not allow are
refused and change nothing but their count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from findery.streaming.jobs import LAST_STAGE, STATE_OF

#: Milliseconds that a claim or heartbeat keeps a job, and how often a job may be claimed.
LEASE_MS, ATTEMPTS = 300_000, 3
STATES = "job_id long, status string, attempts int, worker string, lease_ms long, events long, refused long, at_ms long"
_FIELDS = [f.split()[0] for f in STATES.split(", ")]
_EVENT = ["event_id", "event_type", "worker", "stage"]


@dataclass(frozen=True)
class Job:
    """One job after some events; lease_ms is when its lease runs out, in milliseconds, or -1."""

    status: str = ""
    attempts: int = 0
    worker: str = ""
    lease_ms: int = -1
    events: int = 0
    refused: int = 0
    at_ms: int = -1

    def expired(self, now_ms: int) -> Job:
        """The job at a time when nothing happened: a running one whose lease has run out is stale."""
        late = self.status == "running" and self.lease_ms <= now_ms
        return replace(self, status="stale", worker="", at_ms=self.lease_ms) if late else self

    def after(self, at_ms: int, kind: str, worker: str, stage: str) -> Job:
        """The job after an event; expiry comes before it."""
        if kind not in STATE_OF:
            raise ValueError(f"unknown event type: {kind}")
        old = self.expired(at_ms)
        new = old._moved(at_ms, kind, worker, stage)
        return replace(new or old, events=old.events + 1, refused=old.refused + (new is None), at_ms=at_ms)

    def _moved(self, at_ms: int, kind: str, worker: str, stage: str) -> Job | None:
        held = self.status == "running" and worker == self.worker
        free = replace(self, worker="", lease_ms=-1)
        if kind in ("created", "queued"):
            return replace(free, status="queued") if not self.status else None
        if kind == "claimed":
            ready = self.status == "queued" or (self.status == "stale" and self.attempts < ATTEMPTS)
            return replace(self, status="running", attempts=self.attempts + 1, worker=worker, lease_ms=at_ms + LEASE_MS) if ready else None
        if kind == "succeeded" or (kind == "stage_succeeded" and stage == LAST_STAGE):
            return replace(free, status="succeeded") if held else None
        if kind == "failed":
            return replace(free, status="failed") if held else None
        if kind == "canceled":
            return replace(free, status="canceled") if self.status in ("queued", "running", "stale") else None
        if kind == "retried":
            return replace(free, status="queued") if self.status in ("failed", "canceled") and self.attempts < ATTEMPTS else None
        if kind == "deferred":
            return replace(free, status="queued") if held else None
        return replace(self, lease_ms=at_ms + LEASE_MS) if held else None  # heartbeat, progress and stages of work

    def row(self, job_id: int) -> list:
        return [job_id, self.status, self.attempts, self.worker, self.lease_ms, self.events, self.refused, self.at_ms]


def _prepared(events: DataFrame) -> DataFrame:
    own = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("worker", "stage")]
    return events.where("job_id IS NOT NULL AND at IS NOT NULL").select(F.col("job_id").cast("long").alias("job_id"), "at", F.unix_millis(F.col("at").cast("timestamp")).alias("ms"), F.col("event_id").cast("long").alias("event_id"), "event_type", *own)


def job_table(events: DataFrame, as_of: Column) -> DataFrame:
    """STATES of all jobs of ``events`` (job_id, event_id, event_type, at, worker, stage) at ``as_of``, from events up to then.

    Events of a job meet in one task in order, and a row at a time is held of them, however many there are.
    """
    dealt = _prepared(events.where(F.col("at").cast("timestamp") <= as_of)).withColumn("now", F.unix_millis(as_of)).repartition("job_id").sortWithinPartitions("job_id", "ms", "event_id")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, job, now = None, Job(), 0
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                if r.job_id != of:
                    if of is not None:
                        rows.append(job.expired(now).row(of))
                    of, job, now = r.job_id, Job(), r.now
                job = job.after(r.ms, r.event_type, r.worker, r.stage)
            yield pd.DataFrame(rows, columns=_FIELDS)
        if of is not None:
            yield pd.DataFrame([job.expired(now).row(of)], columns=_FIELDS)

    return dealt.select("job_id", "ms", "event_id", "event_type", "worker", "stage", "now").mapInPandas(fold, STATES)


class _Machine(StatefulProcessor):
    """Holds events until the watermark has passed them, so that late ones keep their place, and a timer for the lease."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", ", ".join(STATES.split(", ")[1:]))
        self.waiting = handle.getListState("waiting", "ms long, event_id long, event_type string, worker string, stage string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for r in frame.itertuples(index=False):
                self.waiting.appendValue((int(r.ms), int(r.event_id), r.event_type, r.worker, r.stage))
                self.handle.registerTimer(int(r.ms))
        yield pd.DataFrame(columns=_FIELDS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()  # no earlier event can come, and other timers may lie before it
        events = sorted(tuple(x) for x in self.waiting.get())
        ready, later = [e for e in events if e[0] <= now], [e for e in events if e[0] > now]
        before = job = Job(*self.job.get()) if self.job.exists() else Job()
        for ms, _, kind, worker, stage in ready:
            job = job.after(ms, kind, worker, stage)
        job = job.expired(now)
        if ready:
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        if job != before:
            self.job.update(tuple(job.row(0)[1:]))
            if job.status == "running":
                self.handle.registerTimer(job.lease_ms)
            yield pd.DataFrame([job.row(key[0])], columns=_FIELDS)
        else:
            yield pd.DataFrame(columns=_FIELDS)


def job_stream(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """A stream of STATES, a row whenever a job changes: after an event, or when its lease runs out with none.

    The state of a job is one row and the events that the watermark has not passed yet.  Needs the RocksDB state store.
    The last row of each job is what ``job_table`` gives at the watermark.
    """
    dealt = _prepared(events).withWatermark("at", late).groupBy("job_id")
    return dealt.transformWithStateInPandas(statefulProcessor=_Machine(), outputStructType=STATES, outputMode="Update", timeMode="EventTime")
