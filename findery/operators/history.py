"""Histories and audits: generation runs, summaries, evaluation audits, promotions, change logs, threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findery.functions.shared import scratch, written
from findery.operators.permission import Grants, owned, personal_key
from findery.sources.metrics import json_number


def json_status(text: Column, *paths: str, default: str = "unknown") -> Column:
    """The first of several JSON paths that holds something."""
    return F.coalesce(*[F.get_json_object(text, p) for p in paths], F.lit(default))


def run_history(runs: DataFrame, status: Column, mode: str | None = None, wanted: str | None = None) -> DataFrame:
    """Runs with their status, filtered where a filter is given, the latest first."""
    rows = runs.withColumn("run_status", status)
    for column, value in (("mode", mode), ("run_status", wanted)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(F.col("created_at").desc(), F.col("run_id").desc())


def provider_metrics(runs: DataFrame, latest: int) -> DataFrame:
    """(mode, run_count, succeeded_count, mean_elapsed_ms, mean_tokens) over the latest runs."""
    recent = runs.orderBy(F.col("created_at").desc(), F.col("run_id").desc()).limit(latest)
    return recent.groupBy("mode").agg(F.count("*").alias("run_count"), F.count_if(F.col("run_status") == "succeeded").alias("succeeded_count"), F.round(F.avg("elapsed_ms"), 6).alias("mean_elapsed_ms"), F.round(F.avg("tokens"), 6).alias("mean_tokens"))


def summary_readiness(chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """One row: documents with text, and those of them summarised by a succeeded run that names them in its JSON."""
    have = chunks.where(F.length(F.trim("text")) > 0).select("document_id").distinct()
    done = summaries.where("run_status = 'succeeded'").select(json_number(F.col("metadata"), "$.document_id").alias("document_id")).distinct().withColumn("done", F.lit(True))
    return have.join(done, "document_id", "left").agg(F.count("*").alias("document_count"), F.count_if("done").alias("summarized_count"))


def permission_audit(results: DataFrame, documents: DataFrame, granted: Grants) -> DataFrame:
    """(user_id, question_id, rank, chunk_id, document_id, is_visible) of stored results against what each user may see.

    ``documents``: a row for each chunk with its document_id, scope and owners; ``granted`` as permission.grants gives it.
    Each pair of a user and an owner in the results is tried once, against the grants that name the owner.
    """
    owners = written(owned(documents).distinct(), scratch(results.sparkSession, "owners"))
    rows = results.join(owned(documents, "chunk_id", "document_id"), "chunk_id").drop("user", "unit")
    tried = rows.select("user_id", "key").distinct().join(granted.requests.select("user_id", "profile", "own"), "user_id").join(granted.naming(owners), "key")
    tried = tried.select("user_id", "key", "profile", "own", F.explode("grants").alias("grant")).join(granted.side(granted.profiles.withColumn("named", F.lit(True))), ["profile", "grant"], "left")
    may = tried.where(F.col("named") | F.col("own") & (F.col("grant") == personal_key("user_id"))).select("user_id", "key", F.lit(True).alias("may")).distinct()
    return rows.join(may, ["user_id", "key"], "left").select("user_id", "question_id", "rank", "chunk_id", "document_id", F.coalesce("may", F.lit(False)).alias("is_visible"))


def count_violations(runs: DataFrame, total: str, parts: list[str]) -> DataFrame:
    """Runs whose total is not the sum of its parts, or that have a negative count."""
    added = sum((F.col(p) for p in parts), F.lit(0))
    negative = F.greatest(*[F.when(F.col(c) < 0, 1).otherwise(0) for c in [total, *parts]]) == 1
    return runs.withColumn("violation", F.when(negative, "negative_count").when(F.col(total) != added, "sum_differs")).where("violation IS NOT NULL")


def promoted(chosen: DataFrame, results: DataFrame, questions: DataFrame) -> DataFrame:
    """(result_id, outcome) of results picked for promotion: promoted, already_promoted or missing."""
    known = results.select("result_id").distinct().withColumn("known", F.lit(True))
    taken = questions.select("result_id").distinct().withColumn("taken", F.lit(True))
    rows = chosen.select("result_id").distinct().join(known, "result_id", "left").join(taken, "result_id", "left")
    return rows.select("result_id", F.when(F.col("known").isNull(), "missing").when(F.col("taken"), "already_promoted").otherwise("promoted").alias("outcome"))


def coverage_detail(chunks: DataFrame, jobs: DataFrame, embedded: DataFrame) -> DataFrame:
    """Chunks with the latest job of each profile that has one, and whether they are embedded; ``coverage_cells`` lists all profiles."""
    latest = jobs.groupBy("chunk_id", "profile").agg(F.max_by(F.struct("job_id", "status"), "job_id").alias("j"))
    have = embedded.select("chunk_id", "profile").distinct().withColumn("is_embedded", F.lit(True))
    rows = chunks.join(latest, "chunk_id", "left").join(have, ["chunk_id", "profile"], "left")
    return rows.select(*chunks.columns, "profile", F.col("j.job_id").alias("job_id"), F.col("j.status").alias("job_status"), F.coalesce("is_embedded", F.lit(False)).alias("is_embedded"))


def coverage_cells(chunks: DataFrame, profiles: DataFrame, jobs: DataFrame, embedded: DataFrame) -> DataFrame:
    """Every chunk under every profile with the latest job there and whether it is embedded, with or without a job."""
    latest = jobs.groupBy("chunk_id", "profile").agg(F.max_by(F.struct("job_id", "status"), "job_id").alias("j"))
    have = embedded.select("chunk_id", "profile").distinct().withColumn("is_embedded", F.lit(True))
    cells = chunks.crossJoin(F.broadcast(profiles.select("profile")))  # a handful of profiles
    rows = cells.join(latest, ["chunk_id", "profile"], "left").join(have, ["chunk_id", "profile"], "left")
    return rows.select(*chunks.columns, "profile", F.col("j.job_id").alias("job_id"), F.col("j.status").alias("job_status"), F.coalesce("is_embedded", F.lit(False)).alias("is_embedded"))


def search_readiness(chunks: DataFrame, embedded: DataFrame, profiles: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """(policy, profile, chunk_count, embedded_count, is_ready) over the chunks that can be seen."""
    if visible is not None:
        chunks = chunks.join(visible.select("document_id"), "document_id", "left_semi")
    rows = chunks.select("policy", "chunk_id").crossJoin(F.broadcast(profiles.select("profile"))).join(embedded.select("chunk_id", "profile").distinct().withColumn("e", F.lit(True)), ["chunk_id", "profile"], "left")
    return rows.groupBy("policy", "profile").agg(F.count("*").alias("chunk_count"), F.count_if("e").alias("embedded_count")).withColumn("is_ready", (F.col("chunk_count") > 0) & (F.col("embedded_count") == F.col("chunk_count")))


def change_history(app_logs: DataFrame, kind: str, since: Column | None = None) -> DataFrame:
    """Log rows of one kind of change by its JSON detail, the latest first."""
    rows = app_logs.where(F.get_json_object("detail", "$.change") == kind)
    return (rows.where(F.col("created_at") >= since) if since is not None else rows).orderBy(F.col("created_at").desc(), F.col("log_id").desc())


def threads(messages: DataFrame, links: DataFrame) -> DataFrame:
    """(session_id, messages): an array of each session's messages in order, each with what it links to."""
    own = links.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("link_type", "target_id"))).alias("links"))
    rows = messages.join(own, "message_id", "left")
    return rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "message_id", "role", "content", "links"))).alias("messages"))


def last_turn(messages: DataFrame, role: str) -> DataFrame:
    """The last message of a role in each session."""
    w = Window.partitionBy("session_id").orderBy(F.col("seq").desc())
    return messages.where(F.col("role") == role).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def dashboard(counts: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each table."""
    out = None
    for name, df in counts.items():
        one = df.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)
    return out
