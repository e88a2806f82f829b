"""Picking rows by time: latest revisions, as-of views and joins, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order (end it with a unique column)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__place", place).filter("__place = 1").drop("__place")


def best_row(rows: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The columns of the row with the greatest ``order``, as one aggregate that
    combines before the shuffle: cheaper than a window where few columns are kept."""
    best = F.max_by(F.struct(*columns), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    return rows.groupBy(*keys).agg(best.alias("__best")).select(*keys, *[F.col(f"__best.{c}").alias(c) for c in columns])


def latest_revision(rows: DataFrame, keys: list[str], known_at: str, tie: str, retraction: str | None = None) -> DataFrame:
    """The last known revision of each key; keys whose last revision is a retraction
    are gone."""
    last = first_by(rows, keys, [F.col(known_at).desc_nulls_last(), F.col(tie).desc_nulls_last()])
    return last.filter(~F.coalesce(F.col(retraction), F.lit(False))) if retraction else last


def as_of_view(rows: DataFrame, keys: list[str], as_of: Column, known_at: str, tie: str, retraction: str | None = None) -> DataFrame:
    """What was known at ``as_of``: no revision that became known later counts."""
    return latest_revision(rows.filter(F.col(known_at) <= as_of), keys, known_at, tie, retraction)


def as_of_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, columns: list[str], left_key: list[str], tie: str | None = None) -> DataFrame:
    """For each left row the columns of the last right row of its key at or before its
    time, null if there is none. Both sides are united and carried forward in one
    window, so no left row meets more than its own key's rows once."""
    order = [right_time] + ([tie] if tie else [])
    a = left.select(*left.columns, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.select(F.struct(*columns).alias("s")).schema["s"].dataType).alias("__row"), F.lit(None).cast(right.schema[tie].dataType if tie else "int").alias("__tie"))
    b = right.select(*[F.col(c) if c in on else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.col(order[0]).alias("__t"), F.lit(0).alias("__side"), F.struct(*columns).alias("__row"), (F.col(tie) if tie else F.lit(None).cast("int")).alias("__tie"))
    w = Window.partitionBy(*on).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__found", F.last("__row", ignorenulls=True).over(w))
    return both.filter("__side = 1").select(*left.columns, *[F.col(f"__found.{c}").alias(c) for c in columns])


def range_join_sum(left: DataFrame, right: DataFrame, on: list[str], lower: Column, upper: Column, at: str, value: str, keys: list[str], name: str) -> DataFrame:
    """Sum of the right values with ``at`` between two columns of the left row; 0 for
    left rows that meet none."""
    r = right.select(*on, F.col(at).alias("__at"), F.col(value).alias("__value"))
    met = left.join(r, on).filter(F.col("__at").between(lower, upper))
    sums = met.groupBy(*keys).agg(F.sum("__value").alias(name))
    return left.join(sums, keys, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0.0)))


def valid_at(left: DataFrame, intervals: DataFrame, on: list[str], at: str, begin: str, end: str) -> DataFrame:
    """Joined with the intervals ``begin <= at < end``; an open end is null."""
    joined = left.join(intervals, on)
    return joined.filter((F.col(begin) <= F.col(at)) & (F.col(end).isNull() | (F.col(at) < F.col(end))))


def next_if_adjacent(rows: DataFrame, key: str, season: str, value: str, name: str) -> DataFrame:
    """The value of the following season, null if the next row is of a later one."""
    w = Window.partitionBy(key).orderBy(season)
    return rows.withColumn(name, F.when(F.lead(season).over(w) == F.col(season) + 1, F.lead(value).over(w)))
