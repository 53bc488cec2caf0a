"""How much of a corpus is chunked, indexed and embedded: scaffolds of small dimensions, left-joined counts, status ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findery.functions.text import percent


def scaffold(*dimensions: DataFrame) -> DataFrame:
    """Every combination: the first dimension may be large, the others are configuration and broadcast."""
    out = dimensions[0]
    for d in dimensions[1:]:
        out = out.crossJoin(F.broadcast(d))
    return out


def filled(df: DataFrame, *columns: str) -> DataFrame:
    """Nulls of left-joined counts as 0."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in columns})


def index_status(policy_chunks: Column, chunks: Column, indexed: Column, stat_terms: Column, stat_chunks: Column) -> Column:
    """State of a keyword index cell; the first rule that holds."""
    return (
        F.when(chunks == 0, "not_chunked")
        .when((stat_terms == 0) & (indexed == 0), "missing")
        .when(stat_chunks != policy_chunks, "stale")
        .when(indexed >= chunks, "complete")
        .when(indexed > 0, "partial")
        .otherwise("missing")
    )


def embedding_status(chunks: Column, jobs: Column, pending: Column, running: Column, failed: Column, succeeded: Column, skipped: Column, embedded: Column) -> Column:
    """State of an embedding cell; the first rule that holds."""
    return (
        F.when(chunks == 0, "not_chunked")
        .when(embedded >= chunks, "complete")
        .when(running > 0, "running")
        .when((failed > 0) & (pending == 0), "failed")
        .when(pending > 0, "pending")
        .when((embedded > 0) | (succeeded > 0), "partial")
        .when((jobs > 0) & (skipped == jobs), "skipped")
        .otherwise("missing")
    )


def keyword_coverage(documents: DataFrame, policies: DataFrame, chunks: DataFrame, terms: DataFrame, statistics: DataFrame) -> DataFrame:
    """(document_id, policy, chunk_count, indexed_count, missing_count, coverage_percent, index_status) of every document and policy."""
    per_policy = chunks.groupBy("policy").agg(F.count("*").alias("policy_chunks"))
    per_cell = chunks.groupBy("document_id", "policy").agg(F.count("*").alias("chunk_count"))
    indexed = terms.select("policy", "chunk_id").distinct().join(chunks.select("policy", "chunk_id", "document_id"), ["policy", "chunk_id"]).groupBy("document_id", "policy").agg(F.count("*").alias("indexed_count"))
    stats = statistics.groupBy("policy").agg(F.count("*").alias("stat_terms"), F.max("corpus_chunk_count").alias("stat_chunks"))
    cells = scaffold(documents.select("document_id"), policies.select("policy")).join(F.broadcast(per_policy), "policy", "left").join(F.broadcast(stats), "policy", "left")
    cells = filled(cells.join(per_cell, ["document_id", "policy"], "left").join(indexed, ["document_id", "policy"], "left"), "policy_chunks", "stat_terms", "stat_chunks", "chunk_count", "indexed_count")
    return cells.select(
        "document_id", "policy", "chunk_count", "indexed_count", F.greatest(F.col("chunk_count") - F.col("indexed_count"), F.lit(0)).alias("missing_count"), percent(F.col("indexed_count"), F.col("chunk_count")).alias("coverage_percent"),
        index_status(F.col("policy_chunks"), F.col("chunk_count"), F.col("indexed_count"), F.col("stat_terms"), F.col("stat_chunks")).alias("index_status"),
    )


JOB_STATES = ("pending", "running", "failed", "succeeded", "skipped")


def embedding_coverage(documents: DataFrame, profiles: DataFrame, chunks: DataFrame, jobs: DataFrame, embedded: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, percent and status of every document and profile, and of each value of ``by`` (such as the policy).

    ``chunks``: chunk_id, document_id and ``by``; ``jobs``: chunk_id, profile, status; ``embedded``: chunk_id, profile.
    """
    by = by or []
    cell = ["document_id", *by]
    counts = chunks.groupBy(*cell).agg(F.count("*").alias("chunk_count"))
    own = chunks.select("chunk_id", *cell)
    made = embedded.select("chunk_id", "profile").distinct().select("chunk_id", "profile", F.lit(None).cast("string").alias("status"), F.lit(1).alias("made"))
    rows = jobs.select("chunk_id", "profile", "status", F.lit(0).alias("made")).unionByName(made).join(own, "chunk_id")
    by_state = rows.groupBy(*cell, "profile").agg(F.count_if(F.col("made") == 0).alias("job_count"), *[F.count_if(F.col("status") == s).alias(s) for s in JOB_STATES], F.sum("made").alias("embedded_count"))
    base = documents.select("document_id")
    if by:
        base = scaffold(base, chunks.select(*by).distinct())
    cells = scaffold(base, profiles.select("profile")).join(counts, cell, "left").join(by_state, [*cell, "profile"], "left")
    cells = filled(cells, "chunk_count", "job_count", *JOB_STATES, "embedded_count")
    c = F.col
    return cells.withColumns(
        {
            "coverage_percent": percent(c("embedded_count"), c("chunk_count")),
            "embedding_status": embedding_status(c("chunk_count"), c("job_count"), c("pending"), c("running"), c("failed"), c("succeeded"), c("skipped"), c("embedded_count")),
        }
    )


def coverage_summary(cells: DataFrame, status: str, by: list[str]) -> DataFrame:
    """Cells, chunks and embedded or indexed chunks by group, with the share in percent and a map of statuses."""
    return cells.groupBy(*by).agg(
        F.count("*").alias("cell_count"), F.sum("chunk_count").alias("chunk_count"), F.count_if(F.col(status) == "complete").alias("complete_count"), F.count_if(F.col(status) == "missing").alias("missing_count")
    )


def unscheduled(chunks: DataFrame, profiles: DataFrame, jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """(chunk_id, profile) pairs without any job, in order; for appending jobs."""
    todo = scaffold(chunks.select("chunk_id"), profiles.select("profile")).join(jobs.select("chunk_id", "profile"), ["chunk_id", "profile"], "left_anti").orderBy("chunk_id", "profile")
    return todo.limit(limit) if limit else todo


def retryable(jobs: DataFrame) -> DataFrame:
    """Failed jobs with attempts left."""
    return jobs.where("status = 'failed' AND attempts < max_attempts")


def document_inventory(documents: DataFrame, chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """Documents with chunk counts and their latest job, which may name the document or its file.

    The two ways are two equi-joins whose union gives the latest, not one join on an OR.
    """
    stats = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("token_count"))
    own = jobs.where("document_id IS NOT NULL").select("document_id", "job_id", "status", "queued_at")
    files = documents.select("document_id", "file_id")
    by_file = jobs.where("document_id IS NULL").drop("document_id").join(files, "file_id").select("document_id", "job_id", "status", "queued_at")
    latest = own.union(by_file).groupBy("document_id").agg(F.max_by(F.struct("job_id", "status"), F.struct("queued_at", "job_id")).alias("latest"))
    return filled(documents.join(stats, "document_id", "left"), "chunk_count", "token_count").join(latest, "document_id", "left").withColumns({"latest_job_id": F.col("latest.job_id"), "latest_job_status": F.col("latest.status")}).drop("latest")


def permission_readiness(rows: DataFrame, owner: str, unit: str, scope: str) -> DataFrame:
    """One row: documents, those ready for permission filters, three kinds of gaps, and the share ready to 4 digits."""
    no_owner, no_unit, no_scope = F.col(owner).isNull(), F.col(unit).isNull(), F.col(scope).isNull()
    ready = ~no_owner & ~no_unit & ~no_scope
    return rows.agg(
        F.count("*").alias("total_count"), F.count_if(ready).alias("ready_count"), F.count_if(no_owner).alias("missing_owner_count"), F.count_if(no_unit).alias("missing_unit_count"), F.count_if(no_scope).alias("missing_scope_count"),
        F.coalesce(F.round(F.try_divide(F.count_if(ready) * 100.0, F.count("*")), 4), F.lit(0.0)).alias("ready_percent"),
    )


def route_readiness(health: DataFrame, contract: DataFrame) -> DataFrame:
    """(route_id, readiness): from the latest health and contract check of each route."""
    h = health.groupBy("route_id").agg(F.max_by("status", F.struct("checked_at", "snapshot_id")).alias("health"))
    c = contract.groupBy("route_id").agg(F.max_by("status", F.struct("checked_at", "snapshot_id")).alias("contract"))
    state = F.when(F.col("health").isNull(), "unchecked").when(F.col("health") != "ok", "unhealthy").when(F.col("contract").isNull(), "contract_unchecked").when(F.col("contract") != "ok", "contract_failed").otherwise("ready")
    return h.join(c, "route_id", "full_outer").select("route_id", state.alias("readiness"))


def model_availability(profiles: DataFrame, models: DataFrame, routes: DataFrame) -> DataFrame:
    """(profile, route_count, ready_route_count, availability): the first rule that holds."""
    counted = routes.groupBy("profile").agg(F.count("*").alias("route_count"), F.count_if("is_active").alias("active"), F.count_if(F.col("is_active") & (F.col("readiness") == "ready")).alias("ready_route_count"))
    rows = filled(profiles.select("profile").join(models, "profile", "left").join(counted, "profile", "left"), "route_count", "active", "ready_route_count")
    state = (
        F.when(~F.coalesce("is_present", F.lit(False)), "model_missing")
        .when(~F.coalesce("is_complete", F.lit(False)), "model_incomplete")
        .when(F.col("ready_route_count") > 0, "ready")
        .when(F.col("active") > 0, "route_not_ready")
        .when(F.col("route_count") > 0, "route_inactive")
        .otherwise("missing_route")
    )
    return rows.select("profile", "route_count", "ready_route_count", state.alias("availability"))
