"""As-of and interval joins without nested loops, whatever share of the rows one key has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findery.functions.shared import scratch, written

_MICROS = 1_000_000


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def as_of(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str], tie: str, slice_seconds: int = 86_400, before: bool = False, within_seconds: int | None = None) -> DataFrame:
    """``left`` with ``values`` of the latest ``right`` row of the same key at or before its time, null if there is none.

    ``before`` takes strictly earlier rows only, ``within_seconds`` none older than that.  Of right rows at one time that
    with the greatest ``tie`` counts.  Null keys and times match nothing; all rows of ``left`` stay.

    Both sides are united and carried forward within a key and a slice of time, so a key with very many rows is
    spread over its slices; what a slice starts with comes from the last row of each earlier slice, a small table.
    """
    match = [F.col(c).alias(f"_k{i}") for i, c in enumerate(on)]
    keys = [f"_k{i}" for i in range(len(on))]
    kept = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(values)])
    own = written(left.withColumn("_row", F.monotonically_increasing_id()), scratch(left.sparkSession, "left"))
    some = lambda df, time: df.where(F.col(time).isNotNull() & ~F.greatest(F.lit(False), *[F.col(c).isNull() for c in on]))
    asks = some(own, left_time).select(*match, _micros(F.col(left_time)).alias("_t"), F.lit(0 if before else 2).alias("_side"), F.lit(None).alias("_tie"), "_row", F.lit(None).cast("bigint").alias("_at"), F.lit(None).alias("_v"))
    tells = some(right, right_time).select(*match, _micros(F.col(right_time)).alias("_t"), F.lit(1).alias("_side"), F.col(tie).alias("_tie"), F.lit(None).cast("bigint").alias("_row"), _micros(F.col(right_time)).alias("_at"), kept.alias("_v"))
    tells = written(tells, scratch(left.sparkSession, "right"))
    cut = lambda df: df.withColumn("_slice", F.floor(F.col("_t") / (slice_seconds * _MICROS)).cast("long"))
    both = cut(tells.unionByName(asks))
    last = lambda w: F.last(F.when(F.col("_at").isNotNull(), F.struct("_at", "_v")), ignorenulls=True).over(w)
    order = Window.partitionBy(*keys, "_slice").orderBy("_t", "_side", F.asc_nulls_first("_tie")).rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("_found", last(order)).where("_row IS NOT NULL").select(*keys, "_slice", "_row", "_t", "_found")
    ends = cut(tells).groupBy(*keys, "_slice").agg(F.max_by(F.struct("_at", "_v"), F.struct("_t", "_tie")).alias("_end"))
    marks = ends.unionByName(cut(asks).select(*keys, "_slice").distinct().withColumn("_end", F.lit(None)))
    marks = marks.groupBy(*keys, "_slice").agg(F.first("_end", ignorenulls=True).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice of a key
    carried = marks.select(*keys, "_slice", F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    found = here.join(carried, [*keys, "_slice"], "left").select("_row", "_t", F.coalesce("_found", "_before").alias("_found"))
    if within_seconds is not None:
        found = found.where(F.col("_t") - F.col("_found._at") <= within_seconds * _MICROS)
    rows = own.join(found.select("_row", "_found"), "_row", "left")
    return rows.select(*[F.col(c) for c in left.columns], *[F.col(f"_found._v.v{i}").alias(c) for i, c in enumerate(values)])


def interval_join(points: DataFrame, intervals: DataFrame, on: list[str], time: str, start: str, end: str, finest_seconds: int = 3600) -> DataFrame:
    """Each point with each interval of the same key that holds it, start included and end not; columns of both, keys once.

    An interval lies in a level by its length, where it meets two cells of time at most; a point looks in one cell of
    each level that has intervals.  So both sides meet by an equality of key, level and cell, and a key is spread over
    its cells.  Null keys and times and empty intervals match nothing.  Names other than keys must differ.
    """
    finest = finest_seconds * _MICROS
    length = _micros(F.col(end)) - _micros(F.col(start))
    level = F.greatest(F.lit(0), F.ceil(F.log2(length / finest))).cast("int")
    width = F.call_function("shiftleft", F.lit(finest).cast("long"), F.col("_level"))
    own = intervals.where(length > 0).withColumn("_level", level)
    cells = F.sequence(F.floor(_micros(F.col(start)) / width).cast("long"), F.floor((_micros(F.col(end)) - 1) / width).cast("long"))
    placed = own.withColumn("_cell", F.explode(cells))
    levels = [r[0] for r in own.select("_level").distinct().collect()]  # some forty at most
    asks = points.where(F.col(time).isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    asks = asks.withColumn("_cell", F.floor(_micros(F.col(time)) / width).cast("long"))
    met = asks.join(placed, [*on, "_level", "_cell"])
    return met.where((F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))).drop("_level", "_cell")
