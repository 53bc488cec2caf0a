"""The state of jobs from their events, in batch and as a stream, and ingestion of new files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: What each event makes of its job: nine of pipeline jobs, and three that embedding jobs have besides.
STATE_OF = {
    "created": "queued", "claimed": "running", "heartbeat": "running", "stage_started": "running", "progress": "running", "stage_succeeded": "running", "failed": "failed", "retried": "queued", "canceled": "canceled",
    "queued": "queued", "succeeded": "succeeded", "deferred": "queued",
}
#: The last stage of a pipeline job: when it succeeds, the job has.
LAST_STAGE = "completed"


def state_of(event_type: Column, stage: Column | None = None) -> Column:
    """The status after an event; an unknown type is an error."""
    pairs = F.create_map(*[x for pair in STATE_OF.items() for x in map(F.lit, pair)])
    known = F.coalesce(F.try_element_at(pairs, event_type), F.raise_error(F.concat(F.lit("unknown event type: "), F.coalesce(event_type, F.lit("null")))))
    return known if stage is None else F.when((event_type == "stage_succeeded") & (stage == LAST_STAGE), "succeeded").otherwise(known)


def job_state(events: DataFrame) -> DataFrame:
    """(job_id, status, attempts, last_event_at, events) from (job_id, event_id, event_type, at) and stage, if there: the latest event decides.

    A plain aggregate, so it runs on a table as well as on a stream in update mode; repeated events
    count once if dropped before, by event_id.
    """
    state = state_of(F.col("event_type"), F.col("stage") if "stage" in events.columns else None)
    return events.groupBy("job_id").agg(
        F.max_by(state, F.struct("at", "event_id")).alias("status"), F.count_if(F.col("event_type") == "claimed").alias("attempts"), F.max("at").alias("last_event_at"), F.count("*").alias("events")
    )


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream of events, each event_id once within the watermark."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(events: DataFrame, width: str, late: str = "1 day") -> DataFrame:
    """(window_start, event_type, n) over tumbling windows of event time."""
    grouped = events.withWatermark("at", late).groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"))
    return grouped.select(F.col("window.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, key: str, gap: str, late: str = "1 day") -> DataFrame:
    """(key, session_start, session_end, n): runs of a key's events with less than ``gap`` between them; the end is a gap after the last.

    On a stream in append mode a session comes out when the watermark has passed its end, and its state goes.
    """
    grouped = events.withWatermark("at", late).groupBy(key, F.session_window("at", gap).alias("session")).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), "n")


def followed(first: DataFrame, then: DataFrame, key: str, within: str, late: str = "1 hour") -> DataFrame:
    """(key, first_id, then_id) of each (key, event_id, at) with those of ``then`` of the same key from its time on, up to ``within`` later.

    Both sides may be streams: watermarks and the range of time bound how long rows are kept; rows later than that are left out.
    """
    a = first.withWatermark("at", late).select(F.col(key), F.col("event_id").alias("first_id"), F.col("at").alias("first_at"))
    b = then.withWatermark("at", late).select(F.col(key).alias("of"), F.col("event_id").alias("then_id"), F.col("at").alias("then_at"))
    near = (F.col(key) == F.col("of")) & (F.col("then_at") >= F.col("first_at")) & (F.col("then_at") <= F.col("first_at") + F.expr(f"INTERVAL {within}"))
    return a.join(b, near).select(key, "first_id", "then_id")


def run_available(stream: DataFrame, sink, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there now and stop: a bounded batch worker whose place is in the checkpoint."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def watch_files(spark: SparkSession, path: str, schema: str, per_batch: int = 100) -> DataFrame:
    """A stream of Parquet rows from files as they arrive, so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)
