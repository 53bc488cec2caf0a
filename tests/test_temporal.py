import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from findery.functions.shared import scratch
from findery.operators import inverted, temporal, vector

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else START + dt.timedelta(seconds=seconds)


def sides(seed):
    """A key of a third of the rows, ties of time, nulls and rows alike."""
    r = random.Random(seed)
    key = lambda: r.choice([1, 1, 2, 3, 4, None])
    time = lambda: r.choice([None, r.randint(0, 400_000), r.randint(0, 30) * 3600])
    left = [(i, key(), time()) for i in range(300)] + [(1000, 1, 5), (1000, 1, 5)]
    right = [(i, key(), time(), r.choice([None, i * 1.5])) for i in range(200)]
    return left, right


@pytest.mark.parametrize(("before", "within"), [(False, None), (True, None), (False, 20_000), (True, 3600)])
def test_as_of_equals_brute_force(spark, before, within):
    left, right = sides(1)
    a = spark.createDataFrame([(i, k, at(t)) for i, k, t in left], "id long, k long, t timestamp").repartition(4)
    b = spark.createDataFrame([(i, k, at(t), v) for i, k, t, v in right], "rid long, k long, u timestamp, v double").repartition(3)
    got = temporal.as_of(a, b, ["k"], "t", "u", ["rid", "v"], "rid", 50_000, before, within)
    assert got.columns == ["id", "k", "t", "rid", "v"]
    want = []
    for i, k, t in left:
        own = [(u, j, v) for j, kk, u, v in right if None not in (k, kk, t, u) and k == kk and (u < t if before else u <= t)]
        best = max(own, key=lambda x: x[:2]) if own else None
        if best and within is not None and t - best[0] > within:
            best = None
        want.append((i, k, at(t), best and best[1], best and best[2]))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_intervals_equal_brute_force(spark):
    r = random.Random(5)
    points = [(i, r.choice([1, 1, 2, None]), r.choice([None, r.randint(0, 300_000)])) for i in range(200)]
    spans = []
    for j in range(120):
        s = r.choice([None, r.randint(0, 300_000), r.randint(0, 80) * 3600])
        spans.append((j, r.choice([1, 1, 2, None]), s, None if s is None else s + r.choice([-5, 0, 1, 60, 3600, 7200, 90_000, 10_000_000])))
    a = spark.createDataFrame([(i, k, at(t)) for i, k, t in points], "id long, k long, t timestamp")
    b = spark.createDataFrame([(j, k, at(s), at(e)) for j, k, s, e in spans], "j long, k long, s timestamp, e timestamp")
    found = temporal.interval_join(a, b, ["k"], "t", "s", "e")
    want = [(i, j) for i, k, t in points for j, kk, s, e in spans if None not in (k, kk, t, s) and k == kk and s <= t < e]
    assert sorted((x.id, x.j) for x in found.collect()) == sorted(want) and len(want) > 200
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert temporal.interval_join(a, b.limit(0), ["k"], "t", "s", "e").count() == 0


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_few_lists_give_nearly_all_neighbours(spark, metric):
    r = np.random.default_rng(3)
    centres = r.normal(0, 1, (40, 24))
    rows = [(i, (centres[i % 40] + r.normal(0, 0.4, 24)).tolist()) for i in range(3000)]
    rows += [(9000, [0.0] * 24), (9001, [1.0, 2.0]), (9002, [2.0, 1.0]), (9003, None), (9004, [float("nan")] * 24), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(5)
    queries = df.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding").union(spark.createDataFrame([(77_777, [1.0, 1.9])], "query_id long, embedding array<double>"))
    path = scratch(spark, "lists")
    inverted.build(df, path, metric)
    plain = lambda d: {(x.query_id, x.rank): (x.chunk_id, x.score, x.distance) for x in d.collect()}
    exact = plain(vector.vector_topk(queries, df, 10, metric=metric))
    assert plain(inverted.search(queries, path, 10, probes="all")) == exact
    few = inverted.search(queries, path, 10)
    assert 1 < spark.read.parquet(f"{path}/centroids").first().probes < 12
    got, want = {(q, c) for (q, _), (c, *_) in plain(few).items()}, {(q, c) for (q, _), (c, *_) in exact.items()}
    assert len(got & want) >= 0.9 * len(want)
    one = inverted.search(queries.where("query_id = 50"), path, 10, probes=2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "list" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_neighbours_of_the_testdata(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    path = scratch(spark, "lists")
    inverted.build(df, path)
    queries = df.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    pairs = lambda d: {(x.query_id, x.chunk_id) for x in d.collect()}
    want = pairs(vector.vector_topk(queries, df, 10))
    assert len(pairs(inverted.search(queries, path, 10)) & want) >= 0.9 * len(want)


def test_an_index_of_nothing(spark):
    path = scratch(spark, "lists")
    inverted.build(spark.createDataFrame([], "chunk_id long, embedding array<double>"), path)
    assert inverted.search(spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>"), path, 3).count() == 0
