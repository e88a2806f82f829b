"""Ordered prefixes of entities: what was known so far, and what came after."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _order(key: str, season: str):
    return Window.partitionBy(key).orderBy(season)


def prefix_features(rows: DataFrame, key: str, season: str, value: str, peak: int = 7) -> DataFrame:
    """Counts and sums up to each row: seasons, total, trailing means with and without
    the row, running maximum, positive seasons, and the sum of the ``peak`` best."""
    w = _order(key, season)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    best = F.slice(F.sort_array(F.collect_list(value).over(upto), asc=False), 1, peak)
    return rows.select(
        "*",
        F.row_number().over(w).alias("seasons_so_far"),
        F.sum(value).over(upto).alias("total_so_far"),
        F.avg(value).over(w.rowsBetween(-2, 0)).alias("trailing3"),
        F.avg(value).over(w.rowsBetween(-3, -1)).alias("prior3"),
        F.max(value).over(upto).alias("best_so_far"),
        F.sum((F.col(value) > 0).cast("int")).over(upto).alias("positive_so_far"),
        F.aggregate(best, F.lit(0.0), lambda a, x: a + x).alias("peak_so_far"),
    )


def remaining(rows: DataFrame, key: str, season: str, value: str, cutoff: int, quiet: int = 3) -> DataFrame:
    """Total minus what came so far; null while the entity may still add to it, that is
    unless its last season lies ``quiet`` seasons before ``cutoff``."""
    w = _order(key, season)
    last = F.max(season).over(Window.partitionBy(key))
    so_far = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(value).over(Window.partitionBy(key))
    resolved = last <= cutoff - quiet
    return rows.select("*", last.alias("last_season"), resolved.alias("resolved"), F.when(resolved, total - so_far).alias("remaining"))


def next_calendar_sum(rows: DataFrame, key: str, season: str, value: str, years: int, name: str) -> DataFrame:
    """Sum over the following calendar years; years without a row count as nothing."""
    w = _order(key, season).rangeBetween(1, years)
    return rows.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0.0)))


def first_sustained(rows: DataFrame, key: str, at: str, value: str, name: str) -> DataFrame:
    """Where the value is first at or below zero twice running, else where it is
    nearest to zero."""
    w = _order(key, at)
    t = rows.withColumn("__both", (F.col(value) <= 0) & (F.lead(value).over(w) <= 0))
    return t.groupBy(key).agg(F.coalesce(F.min(F.when(F.col("__both"), F.col(at))), F.min_by(at, F.struct(F.abs(value), at))).alias(name))


def monotone(rows: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """The running maximum, which never falls."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.max(value).over(w))


def monotone_violations(rows: DataFrame, keys: list[str], order: str, value: str, tolerance: float = 0.0) -> DataFrame:
    """The rows that fall below the one before them."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("before", before).filter(F.col(value) < F.col("before") - tolerance)


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing sequence in weighted least squares."""
    pools: list[list[float]] = []
    for v, w in zip(values, weights):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools.pop()
            pools.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in pools]) if pools else np.zeros(0)


def isotonic(rows: DataFrame, keys: list[str], order: str, value: str, weight: str, name: str) -> DataFrame:
    """``pool_adjacent`` within each entity's few ordered points. A batch has the points of many
    entities; those that never fall are as they are fitted."""
    columns = rows.columns
    own = [c for c in columns if c not in keys]
    point = F.struct(F.col(order).isNull().alias("__null"), F.col(order).alias("__order"), *own)
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("__points"))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keys))
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            points = dict(zip(["__null", "__order", *own], lists.flatten().flatten()))
            v, w = (points[c].to_numpy(zero_copy_only=False).astype(float) for c in (value, weight))
            ends = np.cumsum(n)
            entity = np.repeat(np.arange(len(n)), n)
            falls = np.unique(entity[1:][(v[1:] < v[:-1]) & (entity[1:] == entity[:-1])])
            fitted = v.copy()
            for i in falls:
                fitted[ends[i] - n[i] : ends[i]] = pool_adjacent(v[ends[i] - n[i] : ends[i]].tolist(), w[ends[i] - n[i] : ends[i]].tolist())
            of_keys = dict(zip(keys, (batch.column(i).take(pa.array(entity)) for i in range(len(keys)))))
            yield pa.RecordBatch.from_arrays([*(of_keys[c] if c in of_keys else points[c] for c in columns), pa.array(fitted)], names=[*columns, name])

    return listed.mapInArrow(project, T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())]))


def forward_target(snapshots: DataFrame, values: DataFrame, key: str, edition: str, season: str, value: str, years: int, last_complete: int, thresholds: tuple[float, ...] = ()) -> DataFrame:
    """Sum of the ``years`` seasons after the edition, the edition's own left out. A
    window that ends after ``last_complete`` is immature and null; a mature one without
    rows is 0. ``at_least_<t>`` tells whether a threshold is reached."""
    per = values.groupBy(key, season).agg(F.sum(value).alias("__v"))
    near = snapshots.select(key, edition).distinct().withColumn(season, F.explode(F.sequence(F.col(edition) + 1, F.col(edition) + years)))
    sums = near.join(per, [key, season]).groupBy(key, edition).agg(F.sum("__v").alias("__sum"))
    mature = F.col(edition) + years <= last_complete
    out = snapshots.join(sums, [key, edition], "left").withColumn("mature", mature).withColumn("target", F.when(mature, F.coalesce("__sum", F.lit(0.0)))).drop("__sum")
    return out.select("*", *[(F.col("target") >= t).alias(f"at_least_{t:g}") for t in thresholds])


def role_by_share(part: Column, other: Column, share: float = 0.4) -> Column:
    return F.when(part / F.nullif(part + other, F.lit(0)) >= share, "first").otherwise("second")
