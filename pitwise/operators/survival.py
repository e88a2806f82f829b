"""Censored labels, person-periods, folds and splits without leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HORIZONS = (12, 24, 36, 48, 60)


def censored_labels(snapshots: DataFrame, as_of: str, event: str, cutoff: Column, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """For each horizon ``observed_<h>m`` (the event came within it, or the horizon ends
    by the cutoff) and ``event_<h>m`` (null unless observed). An event at or before the
    snapshot is quarantined: its labels are null."""
    wrong = F.coalesce(F.col(event) <= F.col(as_of), F.lit(False))
    known = F.when(F.col(event) <= cutoff, F.col(event))
    out = snapshots.withColumn("quarantine", F.when(wrong, "event_not_after_snapshot"))
    for h in horizons:
        end = F.add_months(F.col(as_of), h)
        within = F.coalesce(known <= end, F.lit(False))
        observed = ~wrong & (within | (end <= cutoff))
        out = out.withColumn(f"observed_{h}m", observed).withColumn(f"event_{h}m", F.when(observed, within))
    return out


def person_periods(snapshots: DataFrame, key: list[str], as_of: str, event: str, cutoff: Column, intervals: int = 5, months: int = 12) -> DataFrame:
    """A row for each interval that an entity entered at risk and that is fully
    observed: up to the interval of its event, or those that end by the cutoff."""
    known = F.when(F.col(event) <= cutoff, F.col(event))
    t = snapshots.withColumn("__event", known).withColumn("interval", F.explode(F.sequence(F.lit(1), F.lit(intervals))))
    begin, end = F.add_months(F.col(as_of), (F.col("interval") - 1) * months), F.add_months(F.col(as_of), F.col("interval") * months)
    at_risk = F.col("__event").isNull() | (F.col("__event") > begin)
    happened = F.coalesce(F.col("__event") <= end, F.lit(False))
    return t.filter(at_risk & (happened | (end <= cutoff))).select(*key, as_of, "interval", happened.cast("int").alias("event"))


def expanding_folds(rows: DataFrame, entity: str, origin: str, years: int, label: str, test_origins: list[int], least_rows: int = 1000, least_events: int = 20) -> DataFrame:
    """For each test origin the rows to train on (whose labels were complete before it,
    and whose entity is not tested) and to test on, as ``fold, part``; folds without
    support on either part are left out. One pass for all folds."""
    folds = F.explode(F.array(*[F.lit(o) for o in test_origins]))
    t = rows.filter(F.col(label).isNotNull()).withColumn("fold", folds)
    part = F.when(F.col(origin) == F.col("fold"), "test").when(F.col(origin) + years < F.col("fold"), "train")
    t = t.withColumn("part", part).filter("part is not null")
    tested = F.max((F.col("part") == "test").cast("int")).over(Window.partitionBy("fold", entity))
    t = t.withColumn("__tested", tested).filter("part = 'test' or __tested = 0").drop("__tested")
    size = t.groupBy("fold", "part").agg(F.count("*").alias("n"), F.sum(F.col(label).cast("int")).alias("e"))
    good = size.filter((F.col("n") >= least_rows) & (F.col("e") >= least_events) & (F.col("e") < F.col("n")))
    able = good.groupBy("fold").agg(F.count("*").alias("parts")).filter("parts = 2").select("fold")
    return t.join(F.broadcast(able), "fold")


def chronological_split(rows: DataFrame, entity: str, season: str, train: float = 0.6, validate: float = 0.2) -> DataFrame:
    """``entity, split``: entities in order of their last season, whole seasons to one
    part, the cuts where the counts first reach the shares."""
    ends = rows.groupBy(entity).agg(F.max(season).alias("end"))
    per = ends.groupBy("end").agg(F.count("*").alias("n"))
    w = Window.orderBy("end").rowsBetween(Window.unboundedPreceding, 0)  # one row a season
    share = per.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.orderBy("end").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    before = (F.col("upto") - F.col("n")) / F.col("total")
    named = share.select("end", F.when(before < train, "train").when(before < train + validate, "validate").otherwise("test").alias("split"))
    return ends.join(F.broadcast(named), "end").select(entity, "end", "split")


def balanced_cut(entities: DataFrame, year: str, event: str, least: int = 5, least_events: int = 1) -> DataFrame:
    """The year that cuts the entities most evenly in time with support on both sides:
    one row ``year, before, after``."""
    per = entities.groupBy(F.col(year).alias("year")).agg(F.count("*").alias("n"), F.sum(F.col(event).cast("int")).alias("e"))
    upto = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)  # one row a year
    onward = Window.orderBy("year").rowsBetween(0, Window.unboundedFollowing)
    c = per.select(
        "year", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.sum("n").over(onward).alias("after"),
        F.coalesce(F.sum("e").over(upto), F.lit(0)).alias("eb"), F.sum("e").over(onward).alias("ea"),
    )
    able = c.filter((F.col("before") >= least) & (F.col("after") >= least) & (F.col("eb") >= least_events) & (F.col("ea") >= least_events))
    best = able.agg(F.min(F.struct(F.abs(F.col("before") - F.col("after")).alias("gap"), "year", "before", "after")).alias("b"))
    return best.select("b.year", "b.before", "b.after")
