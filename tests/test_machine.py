import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from findery.streaming import jobs, machine

START = dt.datetime(2024, 1, 1)
SCHEMA = "job_id long, event_id long, event_type string, at timestamp, worker string, stage string"
KINDS = ["created", "claimed", "heartbeat", "stage_started", "progress", "stage_succeeded", "failed", "retried", "canceled"]


def some_events(seed, jobs_=25):
    """Lives of jobs: mostly sensible events, some that are refused, gaps longer than a lease."""
    r, rows, n = random.Random(seed), [], 0
    for job in range(jobs_):
        t = r.randint(0, 600)
        for k in range(r.randint(1, 25)):
            kind = "created" if k == 0 and r.random() < 0.9 else r.choice([*KINDS, "claimed", "claimed", "heartbeat", "retried", "stage_succeeded", "stage_succeeded"])
            rows.append((job, n, kind, START + dt.timedelta(seconds=t), r.choice(["w1", "w1", "w2", None]), r.choice(["chunking", "completed", "completed", None])))
            n, t = n + 1, t + r.choice([0, 1, 30, 120, 299, 300, 301, 900])
    return rows


def by_hand(rows, now):
    """A second telling of the rules, job by job."""
    out = {}
    for job in {r[0] for r in rows}:
        status, attempts, owner, lease, refused, n = None, 0, "", None, 0, 0
        for _, _, kind, at, worker, stage in sorted((r for r in rows if r[0] == job and r[3] <= now), key=lambda r: (r[3], r[1])):
            worker, n = worker or "", n + 1
            stale = status == "running" and at >= lease
            mine = status == "running" and not stale and worker == owner
            done = kind == "stage_succeeded" and stage == "completed"
            if kind == "created" and status is None:
                status = "queued"
            elif kind == "claimed" and (status == "queued" or stale and attempts < 3):
                status, attempts, owner, lease = "running", attempts + 1, worker, at + dt.timedelta(minutes=5)
            elif mine and done:
                status = "succeeded"
            elif mine and kind in ("heartbeat", "progress", "stage_started", "stage_succeeded"):
                lease = at + dt.timedelta(minutes=5)
            elif mine and kind == "failed":
                status = "failed"
            elif kind == "canceled" and status in ("queued", "running"):
                status = "canceled"
            elif kind == "retried" and status in ("failed", "canceled") and attempts < 3:
                status = "queued"
            else:
                refused += 1
        if n:
            out[job] = ("stale" if status == "running" and lease <= now else status or "", attempts, n, refused)
    return out


def told(rows):
    return {r.job_id: (r.status, r.attempts, r.events, r.refused) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_table_equals_the_rules_by_hand(spark, seed):
    rows = some_events(seed, 60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for minutes in (5, 30, 600):
        now = START + dt.timedelta(minutes=minutes)
        assert told(machine.job_table(df, F.lit(now)).collect()) == by_hand(rows, now)
    assert len({r[0] for r in by_hand(rows, START + dt.timedelta(hours=10)).values()}) >= 5


def test_unknown_events_fail(spark):
    df = spark.createDataFrame([(1, 1, "dreamt", START, None, None)], SCHEMA)
    with pytest.raises(Exception, match="unknown event type"):
        machine.job_table(df, F.lit(START)).collect()
    assert machine.job_table(df.limit(0), F.lit(START)).count() == 0


def test_stream_equals_the_table(spark, tmp_path):
    rows = some_events(3)
    end = max(r[3] for r in rows) + dt.timedelta(hours=1)
    rows.append((999, 10**6, "created", end + dt.timedelta(minutes=2), None, None))  # lets the watermark pass all others
    ordered = sorted(rows, key=lambda r: r[3])
    for k in range(5):  # files overlap by a few rows, so that events of one job come out of order
        part = ordered[k * len(ordered) // 5 : (k + 1) * len(ordered) // 5]
        spark.createDataFrame(random.Random(k).sample(part, len(part)), SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen = []
    try:
        stream = machine.job_stream(jobs.watch_files(spark, f"{tmp_path}/in", SCHEMA, 1))
        jobs.run_available(stream, lambda batch, _: seen.extend(batch.collect()), f"{tmp_path}/checkpoint", "update")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if old is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    last = {}
    for r in seen:
        last[r.job_id] = r if r.job_id not in last or (r.events, r.at_ms) >= (last[r.job_id].events, last[r.job_id].at_ms) else last[r.job_id]
    want = {r.job_id: r for r in machine.job_table(spark.createDataFrame(rows, SCHEMA), F.lit(end)).collect()}
    assert told(last.values()) == told(want.values()) and len(want) == 25
