import datetime as dt

import pytest
from pyspark.sql import functions as F

from findery import catalog
from findery.operators import answers, coverage, logs, ops, permission
from findery.sources import metrics, tables
from findery.streaming import jobs


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_permissions(spark):
    """Company 1 > division 2 > group 3 > teams 4 and 5, six documents, a member and a group lead."""
    units = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 3)], "unit_id long, parent_id long")
    users = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False)], "user_id long, is_active boolean")
    members = spark.createDataFrame([(1, "member", 4, True, 1), (2, "member", 5, True, 2), (3, "group_lead", 3, True, 3), (4, "member", 4, True, 4)], "user_id long, role_name string, unit_id long, is_primary boolean, membership_id long")
    docs = spark.createDataFrame(
        [(1, 1, 4, "personal"), (2, 2, 5, "personal"), (3, None, 4, "team"), (4, None, 5, "team"), (5, None, 3, "org_tree"), (6, None, 1, "company")], "document_id long, owner_user_id long, owner_unit_id long, access_scope string"
    )
    closure = permission.org_closure(units)
    actors = permission.actors(users, members, closure)
    assert actors.where("user_id = 4").count() == 0
    requests = spark.createDataFrame([(1, "company"), (3, "managed_org"), (1, "managed_org"), (1, "personal")], "user_id long, requested_scope string")
    found = permission.visible_documents(docs, permission.grants(actors, requests, closure, members))
    seen = {}
    for r in found.collect():
        seen.setdefault((r.user_id, r.requested_scope, r.effective_scope), set()).add(r.document_id)
    assert seen == {(1, "company", "company"): {1, 3, 5, 6}, (3, "managed_org", "managed_org"): {1, 2, 3, 4, 5, 6}, (1, "managed_org", "team"): {1, 3, 5, 6}, (1, "personal", "personal"): {1, 6}}


RESULT = "log_id long, profile_name string, rank long, chunk_id long, strategy string, score double, source_score double, reranker_score double, vector_score double, keyword_score double, source_count long"


@pytest.mark.parametrize(
    "strategy, row, status, reasons",
    [
        ("vector", (0.5, None, None, None, None, None), "answerable", []),
        ("vector", (0.4, None, None, None, None, None), "low_confidence", ["weak_vector_score"]),
        ("vector", (None, None, None, None, None, None), "low_confidence", ["missing_vector_score"]),
        ("bm25", (0.01, None, None, None, None, None), "answerable", []),
        ("hybrid", (0.02, None, None, 0.2, None, 1), "low_confidence", ["single_hybrid_source", "weak_vector_score", "weak_keyword_score"]),
        ("hybrid", (0.02, None, None, 0.2, None, 2), "answerable", []),
        ("reranked", (0.3, 0.2, None, None, None, None), "answerable", []),
        ("reranked", (-0.3, 0.2, None, None, None, None), "low_confidence", ["weak_source_vector_score", "weak_reranker_score"]),
    ],
)
def test_profile_confidence(spark, strategy, row, status, reasons):
    results = spark.createDataFrame([(1, "p", 1, 9, strategy, *row)], RESULT)
    profiles = spark.createDataFrame([(1, "p", 0, False)], "log_id long, profile_name string, position int, failed boolean")
    got = answers.profile_confidence(profiles, results).first()
    assert (got.confidence_status, got.reason_codes) == (status, reasons)


def test_overall_confidence_of_a_log(spark):
    logged = spark.createDataFrame([(1, '["a","b","c"]', '{"profile_failures": {"b": "timeout"}}')], "log_id long, profiles string, runtime_metadata string")
    results = spark.createDataFrame([(1, "c", 1, 9, "vector", 0.1, None, None, None, None, None)], RESULT)
    got = answers.overall_confidence(answers.profile_confidence(answers.logged_profiles(logged), results)).first()
    assert (got.confidence_status, got.no_context_profiles, got.failed_profiles, got.low_profiles) == ("low_confidence", 1, 1, 1)
    assert got.reason_codes == ["no_results", "profile_failed", "weak_vector_score"]


def test_context_budget(spark):
    text = "x" * 300
    data = [(1, k, "bm25_keyword", k, k % 3, "T", "S", None, text, "answerable") for k in range(1, 6)]
    schema = "log_id long, result_id long, profile_name string, rank long, chunk_id long, title string, source_label string, heading string, text string, confidence_status string"
    got = answers.context_packages(spark.createDataFrame(data, schema), 650, 5).orderBy("result_id").collect()
    assert [(r.result_id, r.included, r.truncated, r.exclusion_reason, r.supporting_count) for r in got] == [(1, True, False, None, 1), (2, True, True, None, 1), (3, False, False, "context_budget_exceeded", 0)]
    assert sum(r.context_chars for r in got) + 2 == 650 and got[1].context_text.endswith("[truncated]")
    low = answers.context_packages(spark.createDataFrame(data, schema).withColumn("confidence_status", F.lit("low_confidence")), 650, 2).orderBy("result_id").collect()
    assert [r.exclusion_reason for r in low] == ["low_confidence", "low_confidence", "max_items_exceeded"]


def test_citations(spark):
    df = spark.createDataFrame([(1, True, "RCP-001", "text", False, True), (1, True, None, " ", True, False), (1, False, None, "", False, False)], "log_id long, included boolean, k string, t string, truncated boolean, l boolean")
    c = {"included": F.col("included"), "citation_key": F.col("k"), "context_text": F.col("t"), "truncated": F.col("truncated"), "has_document": F.lit(True), "has_chunk": F.lit(True), "has_anchor": F.lit(False), "has_location": F.lit(False), "has_lineage": F.col("l")}
    issues = answers.citation_issues(c)
    assessed = df.select("log_id", "included", F.col("l").alias("anchored"), issues.alias("i"), F.size(issues).alias("issue_count"), answers.citation_status(issues).alias("citation_status"))
    got = assessed.collect()
    assert [r.citation_status for r in got] == ["ready", "failed", "warning"]
    assert [i.code for i in got[1].i] == ["missing_citation_key", "missing_generation_text", "weak_source_anchor", "missing_artifact_block_reference", "context_truncated"]
    total = answers.citation_readiness(assessed).first()
    assert (total.package_status, total.anchor_percent, total.ready_percent) == ("failed", 50.0, 33.33)


@pytest.mark.parametrize(
    "text, keys, guard, error, status, reasons",
    [
        ("see [RCP-001]", ["RCP-001"], "ok", False, "passed", []),
        ("see [RCP-001]", ["RCP-001", "RCP-002"], "ok", False, "warning", ["partial_citation_coverage"]),
        ("nothing", ["RCP-001"], "ok", False, "failed", ["missing_required_citation"]),
        ("I cannot answer", ["RCP-001"], "ok", False, "failed", ["unexpected_no_answer", "missing_required_citation"]),
        ("I cannot answer", [], "no_answer", False, "passed", []),
        ("sure [RCP-007]", [], "no_answer", False, "failed", ["guardrail_no_answer_not_reflected", "unexpected_citation_in_no_answer"]),
        ("  ", [], "ok", False, "failed", ["empty_answer"]),
        (None, ["RCP-001"], "ok", True, "not_evaluated", ["provider_error"]),
    ],
)
def test_answer_quality(spark, text, keys, guard, error, status, reasons):
    df = spark.createDataFrame([(text, keys, guard, error)], "answer_text string, expected_keys array<string>, guardrail_status string, provider_error boolean")
    got = answers.answer_quality(df).first()
    assert (got.quality_status, got.reason_codes) == (status, reasons)


def test_template_sections(spark):
    a = spark.createDataFrame([(1, "t", "# 1. Scope\nall [RCP-001]\n## 2) Risks\n\n## Plan\nsteps")], "answer_id long, template_key string, text string")
    s = spark.createDataFrame([("t", "Scope", True), ("t", "Risks", False), ("t", "Plan", True), ("t", "Cost", False)], "template_key string, heading string, requires_citation boolean")
    assert dict(rows(answers.template_completeness(a, s), "heading", "section_status")) == {"Scope": "passed", "Risks": "failed", "Plan": "warning", "Cost": "failed"}


def test_status_ladders(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, 0, 0, 0, 0), (2, 2, 0, 0, 0, 2, 0, 2), (2, 2, 1, 1, 0, 0, 0, 0), (2, 2, 0, 0, 1, 1, 0, 1), (2, 2, 1, 0, 1, 0, 0, 0), (2, 2, 0, 0, 0, 1, 1, 1), (2, 2, 0, 0, 0, 0, 2, 0), (2, 0, 0, 0, 0, 0, 0, 0)], "a int, b int, c int, d int, e int, f int, g int, h int")
    got = [r[0] for r in df.select(coverage.embedding_status(*map(F.col, "abcdefgh"))).collect()]
    assert got == ["not_chunked", "complete", "running", "failed", "pending", "partial", "skipped", "missing"]


def test_metric_text(spark):
    text = '# HELP x\nvllm:num_requests_running{engine="0",m="a\\"b"} 3\nvllm:num_requests_running{engine="1"} 2.0\nvllm:kv_cache_usage_perc NaN\nvllm:e2e_request_latency_seconds_sum 5\nvllm:e2e_request_latency_seconds_count 4\n\n'
    lines = spark.createDataFrame([(x,) for x in text.split("\n")], "value string")
    samples = metrics.prometheus_samples(lines)
    assert samples.count() == 4
    got = ops.runtime_snapshot(samples).first()
    assert (got.running_requests, got.average_e2e_request_latency_seconds, got.kv_cache_usage_ratio, got.metric_count) == (5, 1.25, None, 4)
    with pytest.raises(Exception, match="not a metric sample"):
        metrics.prometheus_samples(spark.createDataFrame([("what is this",)], "value string")).collect()


def test_host_probes(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    ps = metrics.processes(lines("  PID   RSS COMMAND", " 12 2048 python serve.py --port 1", " 13 1024 other"))
    ports = metrics.listening_ports(lines('LISTEN 0 128 0.0.0.0:8001 0.0.0.0:* users:(("python",pid=12,fd=3))'))
    memory = metrics.memory_info(lines("MemTotal: 4096 kB", "MemAvailable: 2048 kB", "SwapTotal: 1024 kB", "SwapFree: 0 kB"))
    system = memory.select("available_mb", "swap_used_mb", F.lit(1.0).alias("min_available_mb"), F.lit(0.5).alias("max_swap_mb"))
    targets = spark.createDataFrame([("a", 8001, "nothing", 1.0), ("b", 9, "other", 5.0), ("c", 9, "absent", 5.0)], "target string, port long, command_part string, rss_budget_mb double")
    got = {r.target: (r.pid, r.matched_by, r.reasons, r.resource_status) for r in ops.resource_report(targets, ps, ports, system).collect()}
    assert got == {"a": (12, "port", ["ram_budget_exceeded", "swap_high"], "warning"), "b": (13, "command", ["swap_high"], "warning"), "c": (None, None, ["process_not_found", "swap_high"], "missing")}


def test_claim_order_and_schedules(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    schema = "job_id long, status string, priority int, queued_at timestamp, lease_expires_at timestamp, attempts int, max_attempts int"
    df = spark.createDataFrame([(1, "running", 0, t(1), t(2), 1, 3), (2, "queued", 5, t(3), None, 0, 3), (3, "queued", 1, t(4), None, 0, 3), (4, "running", 0, t(1), t(9), 1, 3), (5, "running", 0, t(1), t(2), 3, 3)], schema)
    assert [r.job_id for r in ops.claim_order(df, F.lit(t(5))).collect()] == [3, 2, 1]
    s = spark.createDataFrame([("a", True, t(4)), ("b", True, None), ("c", False, None), ("d", True, t(9))], "schedule_name string, is_enabled boolean, next_run_at timestamp")
    assert [r.schedule_name for r in ops.due_schedules(s, F.lit(t(5))).collect()] == ["b", "a"]


def test_keyed_tables(spark):
    now = spark.createDataFrame([(1, "a", True), (2, "b", False)], "k long, v string, is_default boolean")
    new = spark.createDataFrame([(2, "c", True), (3, "d", False), (2, "e", False)], "k long, v string, is_default boolean")
    up = tables.upserted(now, new, ["k"], [F.col("v")])
    assert sorted(rows(up, "k", "v")) == [(1, "a"), (2, "c"), (3, "d")]
    one = tables.with_one_default(up, F.col("k") == 3)
    assert sorted(rows(one, "k", "is_default")) == [(1, False), (2, False), (3, True)]
    assert rows(tables.deleted(now, now.where("k = 1"), ["k"]), "k") == [(2,)]
    assert sorted(rows(tables.updated(now, F.col("k") == 1, {"v": F.lit("z")}), "v")) == [("b",), ("z",)]
    with pytest.raises(ValueError):
        tables.listed(now, [], [F.col("k")], 0)


def test_retention_in_batches(spark):
    df = spark.createDataFrame([(k, dt.datetime(2024, 1, k)) for k in range(1, 6)], "k long, at timestamp")
    old = logs.expired(df, "at", "k", F.lit(dt.datetime(2024, 1, 10)), 6, batch=2)
    assert [r.k for r in logs.purged(df, old, "k").orderBy("k").collect()] == [3, 4, 5]


def test_job_state_from_a_stream_equals_the_batch(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    data = [(1, 1, "queued", t(0)), (1, 2, "claimed", t(1)), (1, 3, "failed", t(2)), (1, 4, "retried", t(3)), (2, 5, "queued", t(0)), (2, 6, "claimed", t(4)), (2, 7, "succeeded", t(5)), (2, 7, "succeeded", t(5))]
    schema = "job_id long, event_id long, event_type string, at timestamp"
    df = spark.createDataFrame(data, schema)
    for k in range(2):
        df.where(F.col("event_id") % 2 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.deduplicated(jobs.watch_files(spark, f"{tmp_path}/in", schema, 1))
    seen = []
    jobs.run_available(stream, lambda batch, _: seen.extend(batch.collect()), f"{tmp_path}/checkpoint")
    got = jobs.job_state(spark.createDataFrame(seen, schema))
    want = jobs.job_state(df.dropDuplicates(["event_id"]))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(rows(got, "job_id", "status", "attempts")) == [(1, "queued", 1), (2, "succeeded", 1)]


def test_deep_organisations_are_whole(spark):
    units = spark.createDataFrame([(k, k - 1 if k else None) for k in range(50)], "unit_id long, parent_id long")
    top = permission.org_closure(units).where("unit_id = 49")
    assert sorted((r.ancestor_id, r.depth) for r in top.collect()) == [(k, 49 - k) for k in range(50)]


def test_chains_of_any_length_and_circles(spark):
    n = 5000
    units = spark.createDataFrame([(k, k - 1 if k else None) for k in range(n)] + [(9000, 8999), (9001, None)], "unit_id long, parent_id long")
    closure = permission.org_closure(units)
    assert closure.count() == n * (n + 1) // 2 + 3
    top = closure.where(f"unit_id = {n - 1}").agg(F.max("depth"), F.min("ancestor_id"), F.count("*"), F.count_distinct("ancestor_id")).first()
    assert tuple(top) == (n - 1, 0, n, n)
    assert sorted((r.ancestor_id, r.depth) for r in closure.where("unit_id = 9000").collect()) == [(8999, 1), (9000, 0)]
    assert "UnionLoop" not in closure._jdf.queryExecution().executedPlan().toString()
    for circle in ([(1, 2), (2, 3), (3, 1), (4, 1)], [(1, 1)]):
        with pytest.raises(ValueError, match="circle"):
            permission.org_closure(spark.createDataFrame(circle, "unit_id long, parent_id long"))
    assert permission.org_closure(units.limit(0)).count() == 0


def test_context_queries_use_the_defaults(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(answers, "context_packages", lambda rows, *limits: seen.append(limits) or rows)
    monkeypatch.setattr(catalog, "_context_rows", lambda read: None)
    catalog.context_package(None)
    assert seen == [()]


def test_whole_weeks_are_compared(spark, tmp_path):
    rows = [(1, 1.0, "2024-01-03 10:00:00"), (1, 2.0, "2024-01-12 10:00:00"), (2, 1.0, "2024-01-07 23:00:00"), (3, 1.0, "2024-01-14 23:00:00")]
    events = spark.createDataFrame(rows, "user_id long, value double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["snapshot_compare_weeks"](spark, str(tmp_path)).collect()
    assert {r.user_id: r.comparison_status for r in got} == {1: "common", 2: "removed", 3: "added"}


def test_log_detail_runs_its_operator(spark, monkeypatch):
    calls, real = [], logs.log_detail
    monkeypatch.setattr(logs, "log_detail", lambda *tables: calls.append(tables) or real(*tables))
    catalog.QUERIES["log_detail"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
