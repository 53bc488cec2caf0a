"""Keyed tables on plain Parquet: upserts, deletes, default flags, exchange of question sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(current: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """The table after incoming rows replaced those of their keys; of several incoming rows the first in ``order`` counts."""
    if order:
        w = Window.partitionBy(*keys).orderBy(*order)
        incoming = incoming.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
    else:
        incoming = incoming.dropDuplicates(keys)
    return current.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming, allowMissingColumns=True)


def deleted(current: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return current.join(keys.select(*on), on, "left_anti")


def updated(current: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """The table with new values in the rows where the condition holds."""
    return current.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def with_one_default(rows: DataFrame, chosen: Column, flag: str = "is_default", within: str | None = None) -> DataFrame:
    """The flag on the chosen rows only; where ``within`` is given, in their groups only, others keep theirs."""
    if within is None:
        return rows.withColumn(flag, chosen)
    groups = rows.where(chosen).select(within).distinct().withColumn("__touched", F.lit(True))
    out = rows.join(F.broadcast(groups), within, "left")
    return out.withColumn(flag, F.when(F.col("__touched"), chosen).otherwise(F.col(flag))).drop("__touched")


def appended_in_sequence(current: DataFrame, incoming: DataFrame, group: str, seq: str, order: list[str]) -> DataFrame:
    """Incoming rows numbered on from the last of their group."""
    last = current.groupBy(group).agg(F.max(seq).alias("__last"))
    w = Window.partitionBy(group).orderBy(*order)
    return incoming.join(last, group, "left").withColumn(seq, F.coalesce("__last", F.lit(0)) + F.row_number().over(w)).drop("__last")


def listed(rows: DataFrame, where: list[Column], order: list[Column], limit: int) -> DataFrame:
    """A page: filters, a full order, and a limit of 1 to 500."""
    if not 1 <= limit <= 500:
        raise ValueError("limit is 1 to 500")
    for w in where:
        rows = rows.where(w)
    return rows.orderBy(*order).limit(limit)


QUESTION_SET = "struct<version:int,name:string,questions:array<struct<question_id:bigint,text:string,targets:array<struct<chunk_id:bigint,grade:int,expectation:string>>>>>"


def exported_questions(questions: DataFrame, targets: DataFrame, name: str) -> DataFrame:
    """One row ``json`` of a question set with its targets."""
    own = targets.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "grade", "expectation"))).alias("targets"))
    rows = questions.join(own, "question_id", "left").select("question_id", F.col("question_text").alias("text"), F.coalesce("targets", F.expr("CAST(array() AS array<struct<chunk_id:bigint,grade:int,expectation:string>>)")).alias("targets"))
    whole = F.array_sort(F.collect_list(F.struct("question_id", "text", "targets")))
    return rows.agg(F.to_json(F.struct(F.lit(1).alias("version"), F.lit(name).alias("name"), whole.alias("questions"))).alias("json"))


def imported_questions(exported: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions, targets) of exported sets; an unknown version fails."""
    parsed = exported.select(F.from_json("json", QUESTION_SET).alias("s"))
    version = F.when(F.coalesce(F.col("s.version"), F.lit(0)) != 1, F.raise_error(F.lit("unknown version of a question set")).cast("int")).otherwise(F.col("s.version"))
    rows = parsed.select(version.alias("version"), F.explode("s.questions").alias("q"))
    questions = rows.select("version", "q.question_id", F.col("q.text").alias("question_text"))
    return questions, rows.select("q.question_id", F.explode("q.targets").alias("t")).select("question_id", "t.*")
