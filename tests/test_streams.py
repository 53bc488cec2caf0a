import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from findery.operators import logs, sketches
from findery.streaming import jobs

START = dt.datetime(2024, 1, 1)
SCHEMA = "user_id long, event_id long, at timestamp"


def events(seed, n=200):
    r = random.Random(seed)
    return sorted(((r.choice([1, 1, 2, 3]), k, START + dt.timedelta(seconds=r.randint(0, 100_000))) for k in range(n)), key=lambda x: x[2])


def files(spark, rows, path, parts=4):
    """Rows in files by time, out of order within each."""
    for k in range(parts):
        own = rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]
        spark.createDataFrame(random.Random(k).sample(own, len(own)), SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_session_stream_equals_the_table_and_keeps_little(spark, tmp_path):
    rows = events(1)
    flush = (99, 10**6, START + dt.timedelta(days=5))  # the watermark passes all sessions before it
    late = (1, 10**6 + 1, START)  # long after the watermark: left out
    files(spark, rows, f"{tmp_path}/in")
    for row in (flush, late):
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = []
    stream = jobs.sessions(jobs.watch_files(spark, f"{tmp_path}/in", SCHEMA, 1), "user_id", "30 minutes", "1 hour")
    query = jobs.run_available(stream, lambda batch, _: seen.extend(batch.collect()), f"{tmp_path}/checkpoint")
    want = jobs.sessions(spark.createDataFrame(rows, SCHEMA), "user_id", "30 minutes").collect()
    assert sorted(map(tuple, seen)) == sorted(map(tuple, want))
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2  # all but what the last rows may still change is gone


def test_joined_streams_equal_the_table(spark, tmp_path):
    a, b = events(2), [(u, k + 1000, t) for u, k, t in events(3)]
    for name, rows in (("a", a), ("b", b)):
        files(spark, rows, f"{tmp_path}/{name}")
    seen = []
    sides = [jobs.watch_files(spark, f"{tmp_path}/{n}", SCHEMA, 1) for n in ("a", "b")]
    query = jobs.run_available(jobs.followed(*sides, "user_id", "20 MINUTES", "2 days"), lambda batch, _: seen.extend(batch.collect()), f"{tmp_path}/checkpoint")
    want = [(u, i, j) for u, i, t in a for v, j, s in b if u == v and t <= s <= t + dt.timedelta(minutes=20)]
    assert sorted(map(tuple, seen)) == sorted(want) and want and query.exception() is None
    table = jobs.followed(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "user_id", "20 MINUTES")
    assert sorted(map(tuple, table.collect())) == sorted(want)


@pytest.mark.parametrize("people", [50, 20_000])
def test_merged_sketches_stay_within_their_bounds(spark, people):
    r = random.Random(people)
    rows = [(r.choice("ab"), START + dt.timedelta(days=r.randint(0, 20)), r.choice([None, *range(people)]) if k % 50 == 0 else r.randrange(people), r.choice([None, r.expovariate(0.1)])) for k in range(30_000)]
    df = spark.createDataFrame(rows, "kind string, at timestamp, who long, ms double").repartition(6)
    days = sketches.daily(df, ["kind"], "at", "who", "ms")
    shares = {"p50": 0.5, "p99": 0.99}
    whole = {x.kind: x for x in sketches.read_out(sketches.merged(days, ["kind"]), shares).collect()}
    twice = {x.kind: x for x in sketches.read_out(sketches.merged(sketches.merged(days, ["kind", F.weekofyear("day").alias("week")]), ["kind"]), shares).collect()}
    direct = {x.kind: x for x in sketches.read_out(df.groupBy("kind").agg(F.count("*").alias("events"), F.hll_sketch_agg("who", 12).alias("people"), F.kll_sketch_agg_double("ms", F.lit(200)).alias("latencies")), shares).collect()}
    for kind in "ab":
        own = [x for x in rows if x[0] == kind]
        exact, times = len({x[2] for x in own} - {None}), sorted(x[3] for x in own if x[3] is not None)
        for got in (whole[kind], twice[kind], direct[kind]):
            assert got.events == len(own) and abs(got.people - exact) <= 0.05 * exact
            for name, share in shares.items():
                rank = sum(t <= got[name] for t in times) / len(times)
                assert abs(rank - share) < 0.033
        assert whole[kind].people == twice[kind].people or abs(whole[kind].people - twice[kind].people) < 0.03 * exact


def test_report_of_repeated_conditions(spark):
    at = lambda k: START + dt.timedelta(minutes=k)
    rows = [(1, "q", at(0), 10.0, None), (2, "q", at(5), None, "{}"), (3, "q", at(5), 30.0, '{"p": "down"}'), (4, "once", at(1), 1.0, None), (5, None, at(2), 4.0, None), (6, None, at(3), 6.0, '{"a": "b"}')]
    df = spark.createDataFrame(rows, "log_id long, query string, created_at timestamp, elapsed_ms double, failures string")
    results = spark.createDataFrame([(1,), (1,), (6,)], "log_id long")
    got = {r["query"]: tuple(r)[1:] for r in logs.duplicate_report(df, results, ["query"], "failures").collect()}
    assert got == {"q": (3, 1, 3, 2, 1, 20.0, at(0), at(5)), None: (2, 5, 6, 1, 1, 5.0, at(2), at(3))}
    assert [r["query"] for r in logs.duplicate_report(df, results, ["query"], "failures", limit=1).collect()] == ["q"]
    assert logs.duplicate_report(df, results, ["query"], "failures", least=4).count() == 0
