"""Operational rollups: indicators, queues, throughput, failures, health, runtime metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITY = {"critical": 2, "warning": 1}


def core_indicators(rows: DataFrame, content: str) -> DataFrame:
    """One row: rows, distinct contents, groups of copies and rows in excess of one a group."""
    groups = rows.groupBy(content).agg(F.count("*").alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_count"), F.count("*").alias("distinct_count"), F.count_if(F.col("n") > 1).alias("duplicate_group_count"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_count")
    )


def top_groups(rows: DataFrame, keys: list[str], limit: int = 8) -> DataFrame:
    """The largest groups with their counts, ties by key."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), *[F.col(k).asc_nulls_last() for k in keys]).limit(limit)


def queue_summary(jobs: DataFrame, as_of: Column, by: list[str] | None = None, totals: bool = False) -> DataFrame:
    """Jobs by status, stale leases and attempts left, by group; with ``totals`` also a row for all (null keys)."""
    stale = (F.col("status") == "running") & (F.col("lease_expires_at") < as_of)
    left = F.col("attempts") < F.col("max_attempts")
    states = ("queued", "running", "succeeded", "failed", "canceled")
    keys = [F.col(k) for k in by or []]
    grouped = jobs.rollup(*keys) if totals and keys else jobs.groupBy(*keys)
    return grouped.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in states], F.count_if(stale).alias("stale_running"),
        F.count_if((F.col("status") == "failed") & left).alias("retryable_failed"), F.count_if((F.col("status") == "failed") & ~left).alias("exhausted_failed"), F.min(F.when(F.col("status") == "queued", F.col("queued_at"))).alias("oldest_queued_at"),
    )


def stale_jobs(jobs: DataFrame, as_of: Column) -> DataFrame:
    return jobs.where((F.col("status") == "running") & (F.col("lease_expires_at") < as_of))


def claim_order(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Jobs that can be claimed with their turn: queued ones, then expired ones with attempts left; by priority, then age."""
    open_now = (F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("lease_expires_at") < as_of) & (F.col("attempts") < F.col("max_attempts")))
    return jobs.where(open_now).orderBy((F.col("status") != "queued"), F.col("priority"), F.col("queued_at").asc_nulls_first(), F.col("job_id"))


def due_schedules(schedules: DataFrame, as_of: Column) -> DataFrame:
    """Enabled schedules that never ran or are due, those that never ran first."""
    due = F.col("is_enabled") & (F.col("next_run_at").isNull() | (F.col("next_run_at") <= as_of))
    return schedules.where(due).orderBy(F.col("next_run_at").asc_nulls_first(), "schedule_name")


def elapsed_ms(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000


def throughput(jobs: DataFrame, stages: DataFrame, as_of: Column, lookback_hours: int) -> DataFrame:
    """(stage, completed, failed, per_second, success_percent, average_ms, max_ms) of every stage, in the order given.

    ``stages``: stage, position.  Time runs from the start, or from queueing where no start is known.
    """
    recent = jobs.where((F.col("finished_at") >= as_of - F.make_dt_interval(F.lit(0), F.lit(lookback_hours))) & (F.col("finished_at") <= as_of))
    spent = elapsed_ms(F.coalesce("started_at", "queued_at"), F.col("finished_at"))
    done = F.col("status") == "succeeded"
    counted = recent.groupBy("stage").agg(F.count_if(done).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(F.avg(F.when(done, spent)), 3).alias("average_ms"), F.round(F.max(F.when(done, spent)), 3).alias("max_ms"))
    rows = F.broadcast(stages).join(counted, "stage", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("completed", "failed")})
    total = F.col("completed") + F.col("failed")
    return rows.select(
        "stage", "position", "completed", "failed", F.round(F.col("completed") / (lookback_hours * 3600.0), 6).alias("per_second"), F.round(F.try_divide(F.col("completed") * 100.0, total), 2).alias("success_percent"), "average_ms", "max_ms"
    )


def recent_failures(sources: dict[str, DataFrame], limit: int) -> DataFrame:
    """The latest failures of all sources (id, at, detail), each cut to ``limit`` before they are merged."""
    out = None
    for name, df in sources.items():
        order = [F.col("at").desc(), F.col("id").desc()]
        one = df.select(F.lit(name).alias("source_name"), F.col("id").cast("long").alias("id"), "at", "detail").orderBy(*order).limit(limit)
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.col("at").desc(), "source_name", F.col("id").desc()).limit(limit)


def health_signals(counts: DataFrame, rules: list[tuple[str, str, int]]) -> DataFrame:
    """(code, severity, signal_count, threshold): of a one-row table of counts those that reach their threshold, the worst first."""
    signals = F.array(*[F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(code).cast("long").alias("signal_count"), F.lit(max(1, least)).cast("long").alias("threshold")) for code, severity, least in rules])
    rows = counts.select(F.explode(signals).alias("s")).select("s.*").where("signal_count >= threshold")
    rank = F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    return rows.orderBy(rank.desc(), F.col("signal_count").desc(), "code")


def health_status(signals: DataFrame) -> DataFrame:
    """One row: overall status and numbers of signals."""
    critical, warning = F.count_if(F.col("severity") == "critical"), F.count_if(F.col("severity") == "warning")
    return signals.agg(F.when(critical > 0, "critical").when(warning > 0, "warning").otherwise("healthy").alias("health"), F.count("*").alias("signal_count"), critical.alias("critical_count"), warning.alias("warning_count"))


# Names under which inference servers publish a metric, and how the samples of one scrape combine.
METRICS = {
    "kv_cache_usage_ratio": (("vllm:kv_cache_usage_perc", "vllm:gpu_cache_usage_perc"), "max"),
    "cpu_cache_usage_ratio": (("vllm:cpu_cache_usage_perc",), "max"),
    "running_requests": (("vllm:num_requests_running",), "sum"),
    "waiting_requests": (("vllm:num_requests_waiting",), "sum"),
    "swapped_requests": (("vllm:num_requests_swapped",), "sum"),
    "request_success_total": (("vllm:request_success_total",), "sum"),
    "prompt_tokens_total": (("vllm:prompt_tokens_total",), "sum"),
    "generation_tokens_total": (("vllm:generation_tokens_total",), "sum"),
    "prefix_cache_hits_total": (("vllm:prefix_cache_hits_total", "vllm:gpu_prefix_cache_hits_total"), "sum"),
    "prefix_cache_queries_total": (("vllm:prefix_cache_queries_total", "vllm:gpu_prefix_cache_queries_total"), "sum"),
    "num_preemptions_total": (("vllm:num_preemptions_total",), "sum"),
}
HISTOGRAMS = {
    "average_time_to_first_token_seconds": ("vllm:time_to_first_token_seconds",),
    "average_inter_token_latency_seconds": ("vllm:inter_token_latency_seconds", "vllm:time_per_output_token_seconds"),
    "average_e2e_request_latency_seconds": ("vllm:e2e_request_latency_seconds",),
    "average_request_queue_time_seconds": ("vllm:request_queue_time_seconds", "vllm:time_in_queue_requests"),
    "average_request_prefill_time_seconds": ("vllm:request_prefill_time_seconds",),
    "average_request_decode_time_seconds": ("vllm:request_decode_time_seconds",),
}


def runtime_snapshot(samples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Samples (name, value) of each scrape as one row: maxima and sums over aliases, histogram means, ratios."""
    value, name = F.col("value"), F.col("name")
    own = [(F.max if how == "max" else F.sum)(F.when(name.isin(*names), value)).alias(metric) for metric, (names, how) in METRICS.items()]
    parts = [F.sum(F.when(name == f"{base}_{end}", value)).alias(f"{base}_{end}") for bases in HISTOGRAMS.values() for base in bases for end in ("sum", "count")]
    wide = samples.groupBy(*(by or [])).agg(F.count("*").alias("metric_count"), F.count_if(name.startswith("vllm:")).alias("vllm_metric_count"), *own, *parts)
    mean = lambda base: F.when(F.col(f"`{base}_count`") > 0, F.round(F.col(f"`{base}_sum`") / F.col(f"`{base}_count`"), 6))
    counts = [F.greatest(F.bround(F.col(m)).cast("long"), F.lit(0)).alias(m) for m, (_, how) in METRICS.items() if how == "sum"]
    hits, queries = (F.greatest(F.bround(F.col(c)).cast("long"), F.lit(0)) for c in ("prefix_cache_hits_total", "prefix_cache_queries_total"))
    return wide.select(
        *(by or []), "metric_count", "vllm_metric_count", *counts,
        *[F.bround(m, 6).alias(m) for m in ("kv_cache_usage_ratio", "cpu_cache_usage_ratio")],
        F.when(queries > 0, F.bround(hits / queries, 6)).alias("prefix_cache_hit_rate"),
        *[F.coalesce(*map(mean, bases)).alias(m) for m, bases in HISTOGRAMS.items()],
    )


def snapshot_summary(snapshots: DataFrame, key: str, at: str, metrics: list[str]) -> DataFrame:
    """Of each key: snapshots, the latest value, mean and maximum of each metric."""
    return snapshots.groupBy(key).agg(
        F.count("*").alias("snapshot_count"), F.max(at).alias("latest_at"), *[f for m in metrics for f in (F.max_by(m, F.struct(at)).alias(f"latest_{m}"), F.round(F.avg(m), 6).alias(f"mean_{m}"), F.max(m).alias(f"max_{m}"))]
    )


# Codes of the checks of a runtime, the column that each looks at, and its limits for a warning and for critical.
READINESS = {
    "snapshot_stale": ("age_minutes", 10.0, 30.0),
    "kv_cache_pressure": ("kv_cache_usage_percent", 80.0, 90.0),
    "waiting_queue_pressure": ("waiting_requests", 1.0, 5.0),
    "swapped_request_pressure": ("swapped_requests", 1.0, 3.0),
    "preemption_pressure": ("num_preemptions_total", 1.0, 10.0),
    "ttft_latency": ("average_time_to_first_token_seconds", 2.0, 5.0),
    "e2e_latency": ("average_e2e_request_latency_seconds", 30.0, 60.0),
}
#: From the best status to the worst.
READINESS_ORDER = ("ok", "unknown", "warning", "critical")


def runtime_readiness(providers: DataFrame, snapshots: DataFrame, as_of: Column, limits: dict[str, tuple[str, float, float]] | None = None) -> DataFrame:
    """(provider, snapshot_id, status, reason_codes, signals) of every provider, by its latest snapshot at ``as_of``.

    ``snapshots``: provider, snapshot_id, sampled_at, vllm_metric_count and the columns of READINESS.  signals are
    structs (code, status, actual): the age, whether there are metrics at all, and each metric that has a value; status
    is the worst of them, reason_codes those that are not ok.  A provider without a snapshot is unknown.
    """
    checks = limits or READINESS
    names = [c for c, _, _ in checks.values() if c != "age_minutes"]
    latest = snapshots.groupBy("provider").agg(F.max_by(F.struct("snapshot_id", "sampled_at", "vllm_metric_count", *names), F.struct("sampled_at", "snapshot_id")).alias("s"))
    rows = providers.select("provider").distinct().join(latest, "provider", "left").select("provider", "s.*")
    rows = rows.withColumn("age_minutes", F.greatest(F.lit(0.0), F.round((F.unix_micros(as_of) - F.unix_micros(F.col("sampled_at").cast("timestamp"))) / 60e6, 2)))

    def signal(code: str, status: Column, actual: Column) -> Column:
        return F.struct(F.lit(code).alias("code"), status.alias("status"), actual.cast("double").alias("actual"))

    made = {code: signal(code, F.when(F.col(c) >= critical, "critical").when(F.col(c) >= warning, "warning").otherwise("ok"), F.col(c)) for code, (c, warning, critical) in checks.items()}
    made = {code: F.when(F.col(checks[code][0]).isNotNull(), x) for code, x in made.items()}
    count = F.coalesce("vllm_metric_count", F.lit(0))
    present = signal("missing_vllm_metrics", F.when(count <= 0, "critical").otherwise("ok"), count)
    none = F.array(signal("no_runtime_snapshot", F.lit("unknown"), F.lit(None)))
    first, *others = made.values()
    signals = F.when(F.col("snapshot_id").isNull(), none).otherwise(F.array_compact(F.array(first, present, *others)))
    rows = rows.select("provider", "snapshot_id", signals.alias("signals"))
    worst = F.array_max(F.transform("signals", lambda x: F.array_position(F.lit(list(READINESS_ORDER)), x["status"]))).cast("int")
    status = F.element_at(F.array(*map(F.lit, READINESS_ORDER)), worst)
    reasons = F.transform(F.filter("signals", lambda x: x["status"] != "ok"), lambda x: x["code"])
    return rows.select("provider", "snapshot_id", status.alias("status"), reasons.alias("reason_codes"), "signals")


def resource_report(targets: DataFrame, processes: DataFrame, ports: DataFrame, system: DataFrame) -> DataFrame:
    """(target, pid, matched_by, rss_mb, reasons, resource_status): processes by listening port, else by a part of their command.

    ``targets``: target, port, command_part, rss_budget_mb.  ``system``: one row of available_mb, swap_used_mb, min_available_mb, max_swap_mb.
    """
    by_port = targets.join(ports, "port").groupBy("target").agg(F.min("pid").alias("port_pid"))
    commands = targets.join(processes, F.contains(F.col("command"), F.col("command_part"))).groupBy("target").agg(F.min("pid").alias("command_pid"))
    rows = targets.join(by_port, "target", "left").join(commands, "target", "left").withColumn("pid", F.coalesce("port_pid", "command_pid"))
    rows = rows.join(processes.select("pid", "rss_mb"), "pid", "left").crossJoin(F.broadcast(system))
    rules = [("process_not_found", F.col("pid").isNull()), ("ram_budget_exceeded", F.col("rss_mb") > F.col("rss_budget_mb")), ("system_ram_low", F.col("available_mb") < F.col("min_available_mb")), ("swap_high", F.col("swap_used_mb") > F.col("max_swap_mb"))]
    reasons = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules]))
    how = F.when(F.col("port_pid").isNotNull(), "port").when(F.col("command_pid").isNotNull(), "command")
    status = F.when(F.col("pid").isNull(), "missing").when(F.size(reasons) > 0, "warning").otherwise("ok")
    return rows.select("target", "pid", how.alias("matched_by"), "rss_mb", reasons.alias("reasons"), status.alias("resource_status"))


#: Events of a failed pipeline job that its detail shows, the latest.
DETAIL_EVENTS = 10
EVENTS = "array<struct<created_at:timestamp,event_id:bigint,event_type:string>>"


def failure_details(pipeline_jobs: DataFrame, pipeline_events: DataFrame, embedding_jobs: DataFrame, error_logs: DataFrame) -> DataFrame:
    """(failure_id, source, reference_id, severity, status, message, occurred_at, events) of every failure of the three sources.

    Pipeline jobs that failed or were canceled, a cancellation being a warning, with their latest events;
    failed embedding jobs; error logs by level, acknowledged or not.
    """
    recent = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("created_at", "event_id", "event_type")))), 1, DETAIL_EVENTS)
    failed = pipeline_jobs.where(F.col("status").isin("failed", "canceled"))
    events = pipeline_events.join(failed.select("job_id"), "job_id", "left_semi").groupBy("job_id").agg(recent.alias("events"))
    none = F.array().cast(EVENTS)
    at = F.coalesce("finished_at", "updated_at", "queued_at").alias("occurred_at")

    def shaped(df: DataFrame, source: str, key: str, severity: Column, status: Column, message: str, occurred: Column, own: Column) -> DataFrame:
        return df.select(F.concat_ws(":", F.lit(source), F.col(key).cast("string")).alias("failure_id"), F.lit(source).alias("source"), F.col(key).cast("string").alias("reference_id"), severity.alias("severity"), status.alias("status"), F.col(message).alias("message"), occurred, own.alias("events"))

    pipeline = shaped(failed.join(events, "job_id", "left"), "pipeline", "job_id", F.when(F.col("status") == "canceled", "warning").otherwise("error"), F.col("status"), "error_message", at, F.coalesce(F.col("events").cast(EVENTS), none))
    embedding = shaped(embedding_jobs.where("status = 'failed'"), "embedding", "job_id", F.lit("error"), F.col("status"), "error_message", at, none)
    logged = shaped(error_logs.where(F.col("level").isin("ERROR", "CRITICAL")), "app_log", "log_id", F.lower("level"), F.when(F.col("acknowledged_by").isNull(), "unacknowledged").otherwise("acknowledged"), "message", F.col("occurred_at"), none)
    return pipeline.unionByName(embedding).unionByName(logged)


# Log events of a provider that raise an alert, whatever their level.
ALERTS = ("embedding_provider_route_health_alert", "embedding_provider_route_contract_alert")


def all_failures(pipeline_jobs: DataFrame, pipeline_events: DataFrame, embedding_jobs: DataFrame, files: DataFrame, documents: DataFrame, logs: DataFrame) -> DataFrame:
    """(source, reference_id, title, severity, status, message, occurred_at, document_id, events) of every failure of five sources.

    Pipeline jobs that failed or were canceled (a warning) with their latest DETAIL_EVENTS events; failed embedding
    jobs; files that could not be parsed (a warning) with their first document; error and critical logs, acknowledged
    or by their level; alerts of providers, acknowledged or not.  Only the latest events of a job are ever gathered.
    """
    failed = pipeline_jobs.where(F.col("status").isin("failed", "canceled"))
    latest = Window.partitionBy("job_id").orderBy(F.desc("created_at"), F.desc("event_id"))
    kept = pipeline_events.join(failed.select("job_id"), "job_id", "left_semi").withColumn("place", F.row_number().over(latest)).where(F.col("place") <= DETAIL_EVENTS)
    events = kept.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "created_at", "event_id", "event_type"))), lambda e: F.struct(e["created_at"].cast("timestamp").alias("created_at"), e["event_id"].cast("long").alias("event_id"), e["event_type"].alias("event_type"))).alias("events"))
    first = documents.groupBy("file_id").agg(F.min("document_id").alias("document_id"))
    nothing = F.lit(None).cast("long")
    alert = F.col("event_type").isin(*ALERTS)
    acknowledged = F.col("acknowledged_at").isNotNull()

    def shaped(df: DataFrame, source: str, key: str, title: Column, severity: Column, status: Column, message: str, at: Column, document: Column = nothing, own: Column | None = None) -> DataFrame:
        events = F.array().cast(EVENTS) if own is None else F.coalesce(own.cast(EVENTS), F.array().cast(EVENTS))
        return df.select(
            F.lit(source).alias("source"), F.col(key).cast("string").alias("reference_id"), title.alias("title"), severity.alias("severity"), status.alias("status"), F.col(message).alias("message"), at.cast("timestamp").alias("occurred_at"),
            document.cast("long").alias("document_id"), events.alias("events"),
        )

    named = lambda kind: F.concat(F.lit(f"{kind} job #"), F.col("job_id").cast("string"))
    parts = [
        shaped(failed.join(events, "job_id", "left"), "pipeline", "job_id", named("Pipeline"), F.when(F.col("status") == "canceled", "warning").otherwise("error"), F.col("status"), "error_message", F.coalesce("finished_at", "updated_at", "queued_at"), F.col("document_id"), F.col("events")),
        shaped(embedding_jobs.where("status = 'failed'"), "embedding", "job_id", named("Embedding"), F.lit("error"), F.col("status"), "error_message", F.coalesce("last_error_at", "finished_at", "updated_at", "created_at"), F.col("document_id")),
        shaped(files.where("parse_status = 'failed'").join(first, "file_id", "left"), "parsing", "file_id", F.col("original_file_name"), F.lit("warning"), F.col("parse_status"), "parse_error_message", F.col("updated_at"), F.col("document_id")),
        shaped(logs.where(F.col("level").isin("ERROR", "CRITICAL") & ~alert), "app_log", "log_id", F.col("event_type"), F.lower("level"), F.when(acknowledged, "acknowledged").otherwise(F.col("level")), "message", F.col("occurred_at")),
        shaped(logs.where(alert), "provider_alert", "log_id", F.col("event_type"), F.lower("level"), F.when(acknowledged, "acknowledged").otherwise("unacknowledged"), "message", F.col("occurred_at")),
    ]
    return reduce(DataFrame.unionByName, parts)
