"""Analytics over search logs: outliers, failures, repeats, feedback, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_list(logs: DataFrame, results: DataFrame, feedback: DataFrame) -> DataFrame:
    """Each log with its results, feedback and labels counted; results are counted once however much feedback they have."""
    by_result = feedback.groupBy("result_id").agg(F.count("*").alias("feedback_count"), F.count_if(F.col("label") == "relevant").alias("relevant_count"))
    counted = results.join(by_result, "result_id", "left").groupBy("log_id").agg(
        F.count("*").alias("result_count"), F.coalesce(F.sum("feedback_count"), F.lit(0)).alias("feedback_count"), F.coalesce(F.sum("relevant_count"), F.lit(0)).alias("relevant_count")
    )
    out = logs.join(counted, "log_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("result_count", "feedback_count", "relevant_count")})


def runtime_failures(logs: DataFrame, failures: Column) -> DataFrame:
    """(log_id, profile_name, reason): a row for each entry of a JSON object of failures."""
    return logs.select("log_id", F.explode(F.from_json(failures, "map<string,string>")).alias("profile_name", "reason"))


def latency_outliers(logs: DataFrame, threshold: float, limit: int) -> DataFrame:
    """The slowest logs at or above the threshold, the slowest first, then by id."""
    return logs.where(F.col("elapsed_ms") >= threshold).orderBy(F.col("elapsed_ms").desc(), F.col("log_id").desc()).limit(limit)


def without_results(logs: DataFrame, results: DataFrame) -> DataFrame:
    """Logs that found nothing."""
    return logs.join(results.select("log_id"), "log_id", "left_anti")


def duplicate_conditions(logs: DataFrame, condition: list[str], at: str, key: str) -> DataFrame:
    """Conditions that were used more than once, with the first and the latest use; grouped by the columns, not by a hash."""
    return (
        logs.groupBy(*condition)
        .agg(F.count("*").alias("uses"), F.min_by(key, F.struct(at, key)).alias("first_id"), F.max_by(key, F.struct(at, key)).alias("latest_id"))
        .where("uses > 1")
    )


def duplicate_report(logs: DataFrame, results: DataFrame, condition: list[str], failures: str, least: int = 2, limit: int | None = None) -> DataFrame:
    """Conditions used at least ``least`` times: uses, first and latest log and time, uses without results, with failures, and their mean time.

    ``failures`` is a JSON object of a log's failed profiles; null and ``{}`` are none.  The mean leaves out logs without a
    time.  ``limit`` keeps the conditions of most uses, the latest first among equals.
    """
    counted = results.groupBy("log_id").agg(F.count("*").alias("result_count"))
    own = logs.join(counted, "log_id", "left")
    key = F.struct("created_at", "log_id")
    failed = F.size(F.coalesce(F.json_object_keys(failures), F.array().cast("array<string>"))) > 0
    found = own.groupBy(*condition).agg(
        F.count("*").alias("uses"),
        F.min_by("log_id", key).alias("first_id"),
        F.max_by("log_id", key).alias("latest_id"),
        F.count_if(F.coalesce("result_count", F.lit(0)) == 0).alias("zero_result_count"),
        F.count_if(failed).alias("runtime_failure_count"),
        F.round(F.avg("elapsed_ms"), 6).alias("average_elapsed_ms"),
        F.min("created_at").alias("first_created_at"),
        F.max("created_at").alias("latest_created_at"),
    ).where(F.col("uses") >= least)
    return found if limit is None else found.orderBy(F.desc("uses"), F.desc("latest_created_at"), F.desc("latest_id")).limit(limit)


def operations_summary(logs: DataFrame, as_of: Column, lookback_hours: int, condition: list[str], slow_ms: float) -> DataFrame:
    """One row: searches in the time before ``as_of``, failures, slow ones, and how often conditions repeat."""
    recent = logs.where((F.col("created_at") >= as_of - F.make_dt_interval(F.lit(0), F.lit(lookback_hours))) & (F.col("created_at") <= as_of))
    one = recent.agg(
        F.count("*").alias("search_count"), F.count_if("failed").alias("failure_count"), F.count_if(F.col("elapsed_ms") >= slow_ms).alias("slow_count"), F.round(F.avg("elapsed_ms"), 6).alias("average_elapsed_ms"), F.max("elapsed_ms").alias("max_elapsed_ms")
    )
    groups = recent.groupBy(*condition).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_group_count"), F.coalesce(F.max("n"), F.lit(0)).alias("max_group_size"))
    return one.crossJoin(groups)


def feedback_summary(profiles: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """(profile, total, a count for each label): profiles without feedback keep a row of zeros."""
    counts = labels.groupBy("profile").agg(F.count("*").alias("total"), *[F.count_if(F.col("label") == n).alias(n) for n in names])
    out = profiles.select("profile").distinct().join(counts, "profile", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total", *names)})


def log_detail(logs: DataFrame, results: DataFrame, feedback: DataFrame) -> DataFrame:
    """Each log with an array of its results by rank, each with an array of its feedback."""
    notes = feedback.groupBy("result_id").agg(F.array_sort(F.collect_list(F.struct("feedback_id", "label", "comment"))).alias("feedback"))
    nested = results.join(notes, "result_id", "left").groupBy("log_id").agg(F.array_sort(F.collect_list(F.struct("rank", "result_id", "chunk_id", "score", "feedback"))).alias("results"))
    return logs.join(nested, "log_id", "left")


def expired(rows: DataFrame, at: str, key: str, as_of: Column, keep_days: int, batch: int | None = None) -> DataFrame:
    """Keys of rows older than the retention, the oldest first; ``batch`` of them at most if given."""
    old = rows.where(F.col(at) < as_of - F.make_dt_interval(F.lit(keep_days))).select(key, at).orderBy(at, key)
    return old.limit(batch) if batch else old


def purged(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows that stay."""
    return rows.join(keys.select(key), key, "left_anti")


def feedback_comments(feedback: DataFrame, results: DataFrame, logs: DataFrame, users: DataFrame, limit: int) -> DataFrame:
    """Feedback with a comment that is not blank, with its result, search and actor if there is one: the latest ``limit`` (1 to 100)."""
    if not 1 <= limit <= 100:
        raise ValueError("limit is 1 to 100")
    said = feedback.where(F.length(F.trim("comment")) > 0)
    rows = said.join(results, "result_id").join(logs, "log_id").join(users, "actor_user_id", "left")
    return rows.orderBy(F.col("created_at").desc(), F.col("feedback_id").desc()).limit(limit)
