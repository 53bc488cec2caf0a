"""The engine's keyed tables as configuration: what each is found, listed, filtered and flagged by.

An entity says in which order its rows are listed, by which columns a list may be filtered, which flag
keeps inactive rows out, and within which group one row is the default.  Operators take many keys or
groups at once: a lookup is a join with the keys wanted, a list is the first rows of each group.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findery.sources.tables import updated, upserted, with_one_default


@dataclass(frozen=True)
class Entity:
    """``order``: columns of a list, a minus before those that descend; ``within``: the group of the default row, "" for the whole table."""

    key: str
    order: tuple[str, ...]
    filters: tuple[str, ...] = ()
    active: str | None = None
    default: str | None = None
    within: str = ""
    most: int = 500


# Keys, orders, filters and limits of the tables.
ENTITIES = {
    "app_logs": Entity("log_id", ("-occurred_at", "-log_id"), ("level", "event_type", "source")),
    "chat_message_links": Entity("chat_message_link_id", ("chat_message_link_id",), ("chat_message_id",)),
    "chat_messages": Entity("chat_message_id", ("sequence_no", "chat_message_id"), ("chat_session_id",)),
    "chat_sessions": Entity("chat_session_id", ("-updated_at", "-chat_session_id"), ("status", "actor_user_id")),
    "chunk_policies": Entity("chunk_policy_name", ("chunk_policy_name",)),
    "chunks": Entity("chunk_id", ("chunk_policy_name", "chunk_seq", "chunk_id"), ("document_id", "chunk_policy_name")),
    "document_blocks": Entity("block_id", ("block_seq", "block_id"), ("document_id", "artifact_id")),
    "embedding_jobs": Entity("job_id", ("-created_at", "-job_id"), ("chunk_id", "profile_name", "status")),
    "embedding_profiles": Entity("profile_name", ("profile_name",), active="is_active"),
    "evaluation_results": Entity("evaluation_result_id", ("question_id",), ("evaluation_run_id",)),
    "evaluation_runs": Entity("evaluation_run_id", ("-created_at", "-evaluation_run_id"), ("question_set_id", "profile_name", "status")),
    "experiment_runs": Entity("experiment_run_id", ("-created_at", "-experiment_run_id"), ("status", "strategy_name")),
    "extraction_artifacts": Entity("artifact_id", ("-created_at", "-artifact_id"), ("document_id", "artifact_type")),
    "extraction_profiles": Entity("extraction_profile_name", ("extraction_profile_name",), active="is_active"),
    "extraction_quality": Entity("snapshot_id", ("-created_at", "-snapshot_id"), ("document_id", "artifact_id"), most=100),
    "extraction_runs": Entity("extraction_run_id", ("-created_at", "-extraction_run_id"), ("document_id",)),
    "files": Entity("file_id", ("document_id", "file_id"), ("sha256_checksum",)),
    "generation_citations": Entity("generation_run_citation_id", ("citation_index", "generation_run_citation_id"), ("generation_run_id",)),
    "generation_configs": Entity("provider_config_id", ("-is_default", "provider_name", "provider_config_id"), ("provider_mode", "provider_name"), "is_active", "is_default"),
    "generation_runs": Entity("generation_run_id", ("-created_at", "-generation_run_id"), ("status",)),
    "generation_templates": Entity("template_key", ("-is_default", "template_family", "template_version", "template_key"), ("language",), "is_active", "is_default", "language"),
    "metric_snapshots": Entity("snapshot_id", ("-captured_at", "-snapshot_id"), ("question_set_id",)),
    "pipeline_events": Entity("event_id", ("created_at", "event_id"), ("job_id",)),
    "pipeline_jobs": Entity("job_id", ("-queued_at", "-job_id"), ("status", "job_type")),
    "preflight_runs": Entity("run_id", ("-completed_at", "-run_id"), ("schedule_name", "profile_name", "status")),
    "preflight_schedules": Entity("schedule_name", ("schedule_name",), active="is_enabled"),
    "route_contracts": Entity("snapshot_id", ("-checked_at", "-snapshot_id"), ("profile_name", "route_id")),
    "route_health": Entity("snapshot_id", ("-checked_at", "-snapshot_id"), ("profile_name", "route_id")),
    "routes": Entity("route_id", ("profile_name", "priority", "route_id"), ("profile_name",), "is_active"),
    "sample_sets": Entity("sample_set_name", ("-is_default", "sample_set_name"), (), "is_active", "is_default"),
    "search_log_results": Entity("search_log_result_id", ("profile_name", "rank"), ("search_log_id",)),
}

# Settings by group, each with the value that stands where none is stored.
SETTINGS = {
    "search_log_retention": {"retention_days": "365", "purge_batch": "1000"},
    "route_snapshot_retention": {"health_days": "30", "contract_days": "90"},
    "batch_run_retention": {"retention_days": "180"},
    "app_log": {"minimum_level": "INFO", "retention_days": "90"},
}


def ordered(entity: str, descending_nulls_last: bool = True) -> list[Column]:
    """The columns a list of the entity is sorted by."""
    return [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in ENTITIES[entity].order]


def _chosen(entity: str, rows: DataFrame, active_only: bool, filters: dict[str, object]) -> DataFrame:
    own = ENTITIES[entity]
    if unknown := filters.keys() - set(own.filters):
        raise ValueError(f"{entity} has no filter {', '.join(sorted(unknown))}; known: {', '.join(own.filters) or 'none'}")
    tests = [F.col(c) == v for c, v in filters.items() if v is not None]
    if active_only and own.active:
        tests.append(F.col(own.active))
    return rows.where(reduce(lambda a, b: a & b, tests)) if tests else rows


def listing(entity: str, rows: DataFrame, limit: int | None = None, active_only: bool = False, **filters: object) -> DataFrame:
    """The rows of an entity by its order: filters by column, inactive rows left out if asked, a limit of 1 to the entity's most.

    Without a limit the rows are sorted by ranges over all tasks.
    """
    if limit is not None and not 1 <= limit <= ENTITIES[entity].most:
        raise ValueError(f"limit is 1 to {ENTITIES[entity].most}")
    found = _chosen(entity, rows, active_only, filters).orderBy(*ordered(entity))
    return found if limit is None else found.limit(limit)


def listing_by(entity: str, rows: DataFrame, group: str, limit: int, active_only: bool = False, **filters: object) -> DataFrame:
    """The first ``limit`` rows of each group, with ``rank``: the lists of all groups at once.  Spark drops other rows before it shuffles."""
    if not 1 <= limit <= ENTITIES[entity].most:
        raise ValueError(f"limit is 1 to {ENTITIES[entity].most}")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*ordered(entity))).cast("long")
    return _chosen(entity, rows, active_only, filters).withColumn("rank", rank).where(F.col("rank") <= limit)


def found(entity: str, rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Each wanted key with its row and ``is_found``; keys that no row has keep a row of nulls."""
    key = ENTITIES[entity].key
    return keys.select(key).distinct().join(rows.withColumn("is_found", F.lit(True)), key, "left").withColumn("is_found", F.coalesce("is_found", F.lit(False)))


def created(entity: str, current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The table with new rows; a key that is there already, or comes twice, is an error when the rows are read."""
    key = ENTITIES[entity].key
    both = current.select(key).unionByName(incoming.select(key)).groupBy(key).agg(F.count("*").alias("times")).where("times > 1")
    taken = incoming.join(both, key, "left")
    checked = F.when(F.col("times") > 1, F.raise_error(F.concat(F.lit(f"{entity}: key exists: "), F.col(key).cast("string"))).cast(incoming.schema[key].dataType)).otherwise(F.col(key))
    return current.unionByName(taken.withColumn(key, checked).drop("times"), allowMissingColumns=True)


def changed(entity: str, current: DataFrame, changes: DataFrame) -> DataFrame:
    """The table after partial updates (key and some columns): a null leaves the old value; unknown keys change nothing."""
    key = ENTITIES[entity].key
    values = [c for c in changes.columns if c != key]
    incoming = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in values])
    return current.join(incoming, key, "left").withColumns({c: F.coalesce(f"new_{c}", c) for c in values}).drop(*[f"new_{c}" for c in values])


def stored(entity: str, current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The table after an upsert by key; where an incoming row is the default, no other row of its group stays one."""
    own = ENTITIES[entity]
    after = upserted(current, incoming, [own.key])
    if own.default is None:
        return after
    new = incoming.where(F.col(own.default)).select(F.col(own.key).alias("k")).distinct().withColumn("is_new", F.lit(True))
    group = own.within or F.lit("")
    marked = after.join(F.broadcast(new), F.col(own.key) == F.col("k"), "left").withColumn("group", F.col(group) if own.within else group)
    touched = marked.where("is_new").select(F.col("group").alias("g")).distinct()
    out = marked.join(F.broadcast(touched), F.col("group") == F.col("g"), "left")
    return out.withColumn(own.default, F.when(F.col("g").isNotNull(), F.coalesce("is_new", F.lit(False))).otherwise(F.col(own.default))).drop("k", "is_new", "group", "g")


def made_default(entity: str, rows: DataFrame, key: object) -> DataFrame:
    """The row of that key as the one default of its group; an inactive row cannot be it."""
    own = ENTITIES[entity]
    this = F.col(own.key) == F.lit(key)
    if own.active:
        rows = rows.withColumn(own.default, F.when(this & ~F.col(own.active), F.raise_error(F.lit(f"{entity}: an inactive row cannot be the default")).cast("boolean")).otherwise(F.col(own.default)))
    return with_one_default(rows, this, own.default, own.within or None)


def activated(entity: str, rows: DataFrame, key: object, active: bool) -> DataFrame:
    """The row of that key with its flag set."""
    own = ENTITIES[entity]
    return updated(rows, F.col(own.key) == F.lit(key), {own.active: F.lit(active)})


def default_of(entity: str, rows: DataFrame) -> DataFrame:
    """The default row of each group: active, flagged, the first by key."""
    own = ENTITIES[entity]
    usable = rows.where(F.col(own.default) & (F.col(own.active) if own.active else F.lit(True)))
    w = Window.partitionBy(*([own.within] if own.within else [F.lit(0)])).orderBy(own.key)
    return usable.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def selected_routes(routes: DataFrame) -> DataFrame:
    """The route that each profile uses: active, of the least priority number, then the least id."""
    return listing_by("routes", routes, "profile_name", 1, active_only=True).drop("rank")


def unknown_references(rows: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Values of ``column`` that no row of ``known`` has as its key; nulls refer to nothing."""
    wanted = rows.where(F.col(column).isNotNull()).select(column).distinct()
    return wanted.join(known.select(F.col(key).alias(column)), column, "left_anti")


def parent_problems(incoming: DataFrame, messages: DataFrame) -> DataFrame:
    """(chat_message_id, problem) of new messages whose parent is missing or belongs to another session."""
    parents = messages.select(F.col("chat_message_id").alias("parent_message_id"), F.col("chat_session_id").alias("parent_session"))
    rows = incoming.where("parent_message_id IS NOT NULL").join(parents, "parent_message_id", "left")
    problem = F.when(F.col("parent_session").isNull(), "missing_parent").when(F.col("parent_session") != F.col("chat_session_id"), "other_session")
    return rows.select("chat_message_id", problem.alias("problem")).where("problem IS NOT NULL")


def pending_profiles(jobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(profile_name, pending_count, max_token_count, max_char_count, min_job_id, max_job_id) of pending embedding jobs whose chunk exists."""
    rows = jobs.where("status = 'pending'").join(chunks.select("chunk_id", "token_count", "char_count"), "chunk_id")
    return rows.groupBy("profile_name").agg(
        F.count("*").alias("pending_count"), F.max("token_count").alias("max_token_count"), F.max("char_count").alias("max_char_count"), F.min("job_id").alias("min_job_id"), F.max("job_id").alias("max_job_id")
    )


def quality_summary(snapshots: DataFrame) -> DataFrame:
    """(document_id, snapshot_count, passed_count, warning_count, failed_count, latest_snapshot_id, latest_status) of each document."""
    latest = F.max_by(F.struct("snapshot_id", "status"), F.struct("created_at", "snapshot_id"))
    counts = [F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("passed", "warning", "failed")]
    found = snapshots.groupBy("document_id").agg(F.count("*").alias("snapshot_count"), *counts, latest.alias("latest"))
    return found.select("document_id", "snapshot_count", "passed_count", "warning_count", "failed_count", F.col("latest.snapshot_id").alias("latest_snapshot_id"), F.col("latest.status").alias("latest_status"))
