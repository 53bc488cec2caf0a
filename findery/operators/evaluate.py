"""Retrieval metrics by question, their summaries, and comparisons of stored snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible_targets(targets: DataFrame) -> DataFrame:
    """(question_id, chunk_id, grade, hidden) by chunk: the greatest visible grade, and whether it must not be found.

    Targets without a chunk, such as headings, don't count.
    """
    own = targets.where(F.col("chunk_id").isNotNull())
    return own.groupBy("question_id", "chunk_id").agg(
        F.coalesce(F.max(F.when(F.col("expectation") == "visible", F.col("grade"))), F.lit(0)).cast("long").alias("grade"),
        F.max(F.col("expectation") == "hidden").alias("hidden"),
    )


def _gain(grade: Column, place: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(place + 1)


def question_metrics(questions: DataFrame, results: DataFrame, targets: DataFrame, k: int, by: list[str] | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Metrics of every question (and of each value of ``by``), those without results or targets included.

    ``groups`` has the values of ``by``, such as the profiles that were asked; without it they are those of the
    results, and a profile that found nothing for any question would be missing.

    recall, reciprocal rank and nDCG are null without a visible target; then no_answer_success says
    whether nothing was found, and it is null otherwise.  Gains are discounted by the place in the sorted
    list, the reciprocal rank takes the stored rank, and a chunk found again gains nothing at its place.
    """
    by = by or []
    keys = ["question_id", *by]
    graded = visible_targets(targets)
    expected = graded.where("grade > 0")
    ideal = expected.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("grade"), "chunk_id"))).groupBy("question_id").agg(
        F.count("*").alias("visible_count"), F.sum(F.when(F.col("place") <= k, _gain(F.col("grade"), F.col("place")))).alias("idcg")
    )
    order = Window.partitionBy(*keys).orderBy("rank", "chunk_id")
    ranked = results.where(F.col("rank") <= k).withColumns(
        {"place": F.row_number().over(order), "again": F.row_number().over(Window.partitionBy(*keys, "chunk_id").orderBy("rank")) > 1}
    )
    joined = ranked.join(graded, ["question_id", "chunk_id"], "left")
    hit = (F.col("grade") > 0) & ~F.col("again")
    found = joined.groupBy(*keys).agg(
        F.count("*").alias("result_count"),
        F.count_if(hit).alias("matched_count"),
        F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first_rank"),
        F.sum(F.when(hit, _gain(F.col("grade"), F.col("place"))).otherwise(0.0)).alias("dcg"),
        F.count_if(F.coalesce("hidden", F.lit(False)) & ~F.col("again")).alias("hidden_violation_count"),
    )
    base = questions.select("question_id").distinct()
    if by:
        base = base.crossJoin((results if groups is None else groups).select(*by).distinct())  # every question under every profile
    rows = base.join(found, keys, "left").join(ideal, "question_id", "left")
    visible = F.coalesce("visible_count", F.lit(0))
    some = visible > 0
    return rows.select(
        *keys,
        visible.alias("visible_count"),
        F.coalesce("result_count", F.lit(0)).alias("result_count"),
        F.coalesce("matched_count", F.lit(0)).alias("matched_count"),
        F.when(some, F.round(F.coalesce("matched_count", F.lit(0)) / visible, 6)).alias("recall_at_k"),
        F.when(some, F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 6)).alias("reciprocal_rank"),
        F.when(some, F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("idcg"), 6)).alias("ndcg"),
        F.coalesce("hidden_violation_count", F.lit(0)).alias("hidden_violation_count"),
        F.when(~some, F.coalesce("result_count", F.lit(0)) == 0).alias("no_answer_success"),
    )


def _mean(value: Column) -> Column:
    """The mean of values of six digits, from their exact sum: a tie in the seventh digit does not depend on the order of rows."""
    return F.round(F.sum(value.cast("decimal(18,6)")).cast("double") / F.count(value), 6)


def metric_summary(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means over the questions that have a value, sums and rates; one row, or one for each value of ``by``."""
    return metrics.groupBy(*(by or [])).agg(
        F.count("*").alias("question_count"),
        F.count("recall_at_k").alias("evaluated_count"),
        _mean(F.col("recall_at_k")).alias("mean_recall_at_k"),
        _mean(F.col("reciprocal_rank")).alias("mean_reciprocal_rank"),
        _mean(F.col("ndcg")).alias("mean_ndcg"),
        F.sum("hidden_violation_count").alias("hidden_violation_count"),
        F.count("no_answer_success").alias("no_answer_count"),
        F.round(F.avg(F.col("no_answer_success").cast("double")), 6).alias("no_answer_success_rate"),
    )


def target_violations(targets: DataFrame, results: DataFrame) -> DataFrame:
    """(rule, n) of rows that break a rule: positive ids, grades 0 to 3, ranks unique within a question."""
    repeated = results.groupBy("question_id", "rank").agg(F.count("*").alias("c")).where("c > 1")
    rules = [
        ("positive_ids", targets.where("question_id <= 0 OR chunk_id <= 0")),
        ("grade_range", targets.where("grade < 0 OR grade > 3")),
        ("unique_ranks", repeated),
    ]
    out = None
    for name, rows in rules:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
        out = one if out is None else out.union(one)
    return out


def latest_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; rows that cannot be first are dropped before the shuffle."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def compare_snapshots(base: DataFrame, target: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Each key of either snapshot with its status (added, removed, common) and target minus base of each metric."""
    b = base.select(*keys, *[F.col(m).alias(f"base_{m}") for m in metrics], F.lit(True).alias("in_base"))
    t = target.select(*keys, *[F.col(m).alias(f"target_{m}") for m in metrics], F.lit(True).alias("in_target"))
    status = F.when(F.col("in_base").isNull(), "added").when(F.col("in_target").isNull(), "removed").otherwise("common")
    deltas = [F.round(F.col(f"target_{m}") - F.col(f"base_{m}"), 6).alias(f"{m}_delta") for m in metrics]
    return b.join(t, keys, "full_outer").select(*keys, status.alias("comparison_status"), *deltas)


SNAPSHOT_FIELDS = {
    "batch_key": "batch_key_differs",
    "question_set_id": "question_set_differs",
    "strategy_name": "strategy_differs",
    "top_k": "top_k_differs",
    "score_threshold": "score_threshold_differs",
    "chunk_policy_name": "chunk_policy_differs",
}


def snapshot_warnings(base: Column, target: Column) -> Column:
    """Codes of what makes two snapshot structs hard to compare, in a fixed order."""
    codes = [F.when(~base[f].eqNullSafe(target[f]), F.lit(code)) for f, code in SNAPSHOT_FIELDS.items()]
    codes.append(F.when(F.array_sort(F.array_distinct(base["profile_names"])) != F.array_sort(F.array_distinct(target["profile_names"])), F.lit("profile_set_differs")))
    codes.append(F.when(target["created_at"] < base["created_at"], F.lit("target_older_than_base")))
    return F.array_compact(F.array(*codes))


def metric_trend(snapshots: DataFrame, key: str, time: str, tie: str, metrics: list[str]) -> DataFrame:
    """Snapshots of each key in order of time with their number and the change of each metric since the last."""
    w = Window.partitionBy(key).orderBy(time, tie)
    return snapshots.select(
        key, time, tie, *metrics, F.row_number().over(w).cast("long").alias("sequence"), *[F.round(F.col(m) - F.lag(m).over(w), 6).alias(f"{m}_delta") for m in metrics]
    )


#: What makes a batch of runs: these fields together, in the order of sorted JSON.
BATCH_FIELDS = "batch_prefix string, chunk_policy_name string, profile_names array<string>, question_set_id long, score_threshold double, strategy_name string, top_k long"


def batch_prefix(run_name: Column, question_id: Column) -> Column:
    """A run's name without `` / Q`` and its question: of the run's own question if it ends so, else from the last such mark on."""
    suffix = F.concat(F.lit(" / Q"), question_id.cast("string"))
    last = F.regexp_extract(run_name, r"(?s)^(.*) / Q", 1)
    return F.when(F.endswith(run_name, suffix), F.left(run_name, F.length(run_name) - F.length(suffix))).when(F.contains(run_name, F.lit(" / Q")), last).otherwise(run_name)


def batch_key(fields: Column) -> Column:
    """A name for a batch, from a struct with BATCH_FIELDS: base64url, without padding, of its sorted compact JSON with nulls; null without a question set."""
    names = [f.split()[0] for f in BATCH_FIELDS.split(", ")]
    text = F.to_json(F.struct(*[fields[n].alias(n) for n in names]), {"ignoreNullFields": "false"})
    return F.when(fields["question_set_id"].isNotNull(), F.rtrim(F.translate(F.base64(text.cast("binary")), "+/\r\n", "-_"), F.lit("=")))


def batch_fields(key: Column) -> Column:
    """The struct that a key stands for; a key that is none, or without profiles, a question set or a positive top_k, is an error."""
    padded = F.rpad(F.translate(key, "-_", "+/"), (F.ceil(F.length(key) / 4) * 4).cast("int"), F.lit("="))
    bad = F.raise_error(F.concat(F.lit("not a batch key: "), key))
    found = F.from_json(F.try_to_binary(padded, F.lit("base64")).cast("string"), BATCH_FIELDS)
    good = (found["question_set_id"] > 0) & (found["top_k"] > 0) & found["profile_names"].isNotNull()
    return F.when(F.coalesce(good, F.lit(False)), found).otherwise(bad.cast(f"struct<{', '.join(f.replace(' ', ':', 1) for f in BATCH_FIELDS.split(', '))}>"))


def batch_status(statuses: DataFrame, key: str) -> DataFrame:
    """(key, batch_status, runs) of the runs' statuses: succeeded if all are; else failed, then running (pending too), then canceled; failed for anything else."""
    has = lambda *s: F.coalesce(F.max(F.col("status").isin(*s)), F.lit(False))
    all_good = F.min(F.coalesce(F.col("status") == "succeeded", F.lit(False)))
    return statuses.groupBy(key).agg(
        F.when(all_good, "succeeded").when(has("failed"), "failed").when(has("running", "pending"), "running").when(has("canceled"), "canceled").otherwise("failed").alias("batch_status"), F.count("*").alias("runs")
    )


def promotion_candidates(feedback: DataFrame, results: DataFrame, promoted: DataFrame) -> DataFrame:
    """Results that feedback calls relevant and no question stems from, with their labels and latest comment."""
    own = feedback.groupBy("result_id").agg(
        F.array_sort(F.collect_set("relevance_label")).alias("labels"), F.max_by(F.when(F.col("comment") != "", F.col("comment")), F.struct(F.col("comment").isNotNull(), "created_at", "feedback_id")).alias("comment")
    )
    chosen = own.where(F.array_contains("labels", "relevant"))
    return results.join(chosen, "result_id").join(promoted.select("result_id"), "result_id", "left_anti")
