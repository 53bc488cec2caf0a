import base64
import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from findery.operators import chunking, evaluate, ops
from findery.sources import metrics
from findery.streaming import jobs


def test_headings_fences_and_rules_by_scanning():
    headings = {"# A": (1, "A"), "###### A b ##": (6, "A b"), "####### A": None, "#A": None, " # A": None, "# a # #": (1, "a #"), "## ##": (2, "#"), "# ": None, "#   ": (1, ""), "#\tT#  ": (1, "T"), "": None}
    assert {k: chunking.heading(k) for k in headings} == headings
    fences = {"```": ("`", 3, ""), "  ~~~~ python x": ("~", 4, " python x"), "``": None, "`` `": None, "x```": None, "": None, "```~~~": ("`", 3, "~~~")}
    assert {k: chunking.fence(k) for k in fences} == fences
    rows = {"---": True, "| --- | :-: |": False, "| :--- | ---: |": True, "|:---:|": True, "| - |": False, "||": False, "": False, "--- | x": False, ":": False, "----:|": True}
    assert {k: chunking._rules(k) for k in rows} == rows
    text = "~~~ py\ncode\n```\n~~~~ \nafter\n| a | b |\n|---|:---:|\n| 1 | 2 |\nend"
    assert [(b["block_type"], b["block_text"], b["language"]) for b in chunking.markdown_blocks(text)] == [("code_block", "code\n```", "py"), ("paragraph", "after", None), ("table", "| a | b |\n|---|:---:|\n| 1 | 2 |", None), ("paragraph", "end", None)]


def test_every_event_gives_a_status(spark):
    at = lambda k: dt.datetime(2024, 1, 1, 0, k)
    kinds = ["created", "claimed", "heartbeat", "stage_started", "progress", "stage_succeeded", "failed", "retried", "canceled"]
    rows = [(k, k, kind, at(k), "chunking") for k, kind in enumerate(kinds)] + [(20, 20, "claimed", at(1), "parsing"), (20, 21, "stage_succeeded", at(2), "completed")]
    df = spark.createDataFrame(rows, "job_id long, event_id long, event_type string, at timestamp, stage string")
    got = {r.job_id: r.status for r in jobs.job_state(df).collect()}
    assert got == dict(enumerate(["queued", "running", "running", "running", "running", "running", "failed", "queued", "canceled"])) | {20: "succeeded"}
    with pytest.raises(Exception, match="unknown event type"):
        jobs.job_state(df.withColumn("event_type", F.lit("dreamt"))).collect()


def test_status_of_batches(spark):
    cases = {"succeeded": ["succeeded", "succeeded"], "failed": ["succeeded", "failed", "running"], "running": ["pending"], "canceled": ["canceled", "succeeded"]}
    rows = [(k, s) for k, v in cases.items() for s in v] + [("odd", "paused"), ("odd", "succeeded"), ("null", None), ("mixed", "pending"), ("mixed", "canceled")]
    got = {r.b: r.batch_status for r in evaluate.batch_status(spark.createDataFrame(rows, "b string, status string"), "b").collect()}
    assert got == {k: k for k in cases} | {"odd": "failed", "null": "failed", "mixed": "running"}


def test_batch_keys_say_all_seven_fields(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "ü/b", 'q"x']), r.choice([None, "p"]), r.choice([["x", "y"], ["y", "x"], []]), r.choice([1, 2]), r.choice([None, 0.5, 0.25]), r.choice(["v", "h"]), r.choice([5, 10])) for _ in range(60)]
    names = [f.split()[0] for f in evaluate.BATCH_FIELDS.split(", ")]
    df = spark.createDataFrame(rows, evaluate.BATCH_FIELDS).select(F.struct(*names).alias("s"))
    got = df.select("s", evaluate.batch_key(F.col("s")).alias("k")).withColumn("back", evaluate.batch_fields(F.col("k"))).collect()
    for x in got:
        plain = json.dumps({n: x.s[n] for n in names}, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
        assert x.k == base64.urlsafe_b64encode(plain.encode()).decode().rstrip("=") and x.back == x.s
    assert len({x.k for x in got}) == len({str(x.s) for x in got})
    for bad in ("!!", "e30", base64.urlsafe_b64encode(b'{"question_set_id":1,"top_k":0,"profile_names":[]}').decode()):
        with pytest.raises(Exception, match="batch key"):
            spark.createDataFrame([(bad,)], "k string").select(evaluate.batch_fields(F.col("k"))).collect()


def test_prefixes_of_run_names(spark):
    rows = [("b / Q7", 7, "b"), ("b / Q7 / Q8", 8, "b / Q7"), ("b / Q7", 9, "b"), ("b", 1, "b"), ("x / Q1 / Q2", None, "x / Q1")]
    got = spark.createDataFrame(rows, "n string, q long, want string").select("want", evaluate.batch_prefix(F.col("n"), F.col("q")).alias("p")).collect()
    assert all(r.p == r.want for r in got)


def test_profiles_without_results_stay(spark):
    q = spark.createDataFrame([(1,), (2,)], "question_id long")
    results = spark.createDataFrame([(1, 10, 1, "a")], "question_id long, chunk_id long, rank long, profile string")
    targets = spark.createDataFrame([(1, 10, 3, "visible"), (2, 11, 3, "visible")], "question_id long, chunk_id long, grade long, expectation string")
    groups = spark.createDataFrame([("a",), ("b",)], "profile string")
    found = evaluate.metric_summary(evaluate.question_metrics(q, results, targets, 5, ["profile"], groups), ["profile"])
    assert {r.profile: (r.question_count, r.mean_recall_at_k) for r in found.collect()} == {"a": (2, 0.5), "b": (2, 0.0)}


def test_a_tie_of_a_mean_is_rounded_alike_in_any_order(spark):
    values = [0.471079, 0.100377, 0.920338, 0.731364]  # mean 0.5557895; as doubles, added from the last on, just below
    for own in (values, values[::-1]):
        rows = [(v, v, v, 0, True) for v in own]
        metrics = spark.createDataFrame(rows, "recall_at_k double, reciprocal_rank double, ndcg double, hidden_violation_count long, no_answer_success boolean").coalesce(1)
        got = evaluate.metric_summary(metrics).first()
        assert (got.mean_recall_at_k, got.mean_reciprocal_rank, got.mean_ndcg) == (0.55579, 0.55579, 0.55579)


def test_labels_of_metrics(spark):
    rows = {r'x{a="q\"uo,te",b="back\\slash",c="two\nlines",} 1': {"a": 'q"uo,te', "b": "back\\slash", "c": "two\nlines"}, "y 2": {}, 'z{ d="1" , e="" } 3': {"d": "1", "e": ""}}
    got = metrics.prometheus_samples(spark.createDataFrame([(k,) for k in rows], "value string")).collect()
    assert [r.labels for r in sorted(got, key=lambda r: r.value)] == list(rows.values())
    for bad in ("y{bad} 2", 'y{a="1" b="2"} 2', 'y{a="1",a="2"} 2', 'y{a="open} 2'):
        with pytest.raises(Exception, match="metric"):
            metrics.prometheus_samples(spark.createDataFrame([(bad,)], "value string")).collect()


def test_readiness_of_runtimes(spark):
    now = dt.datetime(2024, 1, 2)
    ago = lambda m: now - dt.timedelta(minutes=m)
    rows = [("good", 1, ago(5), 9, 10.0, 0, 0, 0, 0.5, 1.0), ("good", 2, ago(2), 9, 10.0, 0, 0, 0, None, 1.0), ("slow", 3, ago(12), 9, 85.0, 2, 0, 0, 6.0, None), ("bare", 4, ago(-3), 0, None, None, None, None, None, None), ("old", 5, ago(31), 1, 90.0, 5, 3, 10, 2.0, 30.0)]
    names = ["kv_cache_usage_percent", "waiting_requests", "swapped_requests", "num_preemptions_total", "average_time_to_first_token_seconds", "average_e2e_request_latency_seconds"]
    kinds = ["double", "long", "long", "long", "double", "double"]
    snapshots = spark.createDataFrame(rows, "provider string, snapshot_id long, sampled_at timestamp, vllm_metric_count long, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
    providers = spark.createDataFrame([(p,) for p in ("good", "slow", "bare", "old", "never")], "provider string")
    got = {r.provider: r for r in ops.runtime_readiness(providers, snapshots, F.lit(now)).collect()}
    assert {p: r.status for p, r in got.items()} == {"good": "ok", "slow": "critical", "bare": "critical", "old": "critical", "never": "unknown"}
    assert got["good"].snapshot_id == 2 and [s.code for s in got["good"].signals] == ["snapshot_stale", "missing_vllm_metrics", "kv_cache_pressure", "waiting_queue_pressure", "swapped_request_pressure", "preemption_pressure", "e2e_latency"]
    assert got["slow"].reason_codes == ["snapshot_stale", "kv_cache_pressure", "waiting_queue_pressure", "ttft_latency"]
    assert got["bare"].reason_codes == ["missing_vllm_metrics"] and got["bare"].signals[0].actual == 0 and got["never"].reason_codes == ["no_runtime_snapshot"]
    assert len(got["old"].reason_codes) == 7 and {s.status for s in got["old"].signals if s.code in ("ttft_latency", "e2e_latency")} == {"warning"}


def test_processes_on_gpus(spark):
    lines = spark.createDataFrame([("12, 100 MiB",), ("12, 50",), ("7, 3 MiB",), ("pid, used",)], "value string")
    assert sorted(map(tuple, metrics.gpu_processes(lines).collect())) == [(7, 3.0), (12, 150.0)]


def test_failures_of_five_sources(spark):
    at = lambda k: dt.datetime(2024, 1, 1, 0, k)
    jobs_schema = "job_id long, status string, finished_at timestamp, updated_at timestamp, queued_at timestamp, last_error_at timestamp, created_at timestamp, error_message string, document_id long"
    job = lambda i, s, last=None: (i, s, None, at(1), at(0), last, at(0), "why", 5)
    pipeline = spark.createDataFrame([job(1, "failed"), job(2, "canceled"), job(3, "running")], jobs_schema)
    embedding = spark.createDataFrame([job(1, "failed", at(9)), job(2, "canceled")], jobs_schema)
    events = spark.createDataFrame([(1, k, "progress", at(k // 2)) for k in range(25)] + [(3, 99, "progress", at(1))], "job_id long, event_id long, event_type string, created_at timestamp")
    files = spark.createDataFrame([(1, "a.md", "failed", "bad", at(3)), (2, "b.md", "succeeded", None, at(3)), (3, "c.md", "failed", None, at(3))], "file_id long, original_file_name string, parse_status string, parse_error_message string, updated_at timestamp")
    documents = spark.createDataFrame([(1, 12), (1, 11), (2, 13)], "file_id long, document_id long")
    logs = [(1, "ERROR", "crash", None), (2, "CRITICAL", "crash", at(1)), (3, "INFO", "note", None), (4, "INFO", ops.ALERTS[0], None), (5, "ERROR", ops.ALERTS[1], at(2))]
    logs = spark.createDataFrame([(*x, "text", at(4)) for x in logs], "log_id long, level string, event_type string, acknowledged_at timestamp, message string, occurred_at timestamp")
    got = {(r.source, r.reference_id): r for r in ops.all_failures(pipeline, events, embedding, files, documents, logs).collect()}
    assert {k: (r.severity, r.status) for k, r in got.items()} == {
        ("pipeline", "1"): ("error", "failed"), ("pipeline", "2"): ("warning", "canceled"), ("embedding", "1"): ("error", "failed"), ("parsing", "1"): ("warning", "failed"), ("parsing", "3"): ("warning", "failed"),
        ("app_log", "1"): ("error", "ERROR"), ("app_log", "2"): ("critical", "acknowledged"), ("provider_alert", "4"): ("info", "unacknowledged"), ("provider_alert", "5"): ("error", "acknowledged"),
    }
    assert [e.event_id for e in got["pipeline", "1"].events] == list(range(24, 14, -1)) and got["pipeline", "2"].events == []
    assert got["parsing", "1"].document_id == 11 and got["parsing", "3"].document_id is None and got["embedding", "1"].occurred_at == at(9) and got["pipeline", "1"].occurred_at == at(1)
