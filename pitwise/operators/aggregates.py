"""Weighted, ordered and hierarchical aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_mean(value: Column, weight: Column) -> Column:
    """Over rows that have a value."""
    w = F.when(value.isNotNull(), weight)
    return F.sum(value * w) / F.nullif(F.sum(w), F.lit(0))


def entity_weight(*entity: str) -> Column:
    """``1 / rows of the entity``."""
    return 1.0 / F.count("*").over(Window.partitionBy(*entity))


def mean_one_weights(rows: DataFrame, entity: list[str], name: str) -> DataFrame:
    """``1 / rows of the entity``, scaled to a mean of one over all rows: entities weigh the
    same, and the weights sum to the rows."""
    per = rows.groupBy(*entity).agg(F.count("*").alias("__n")).withColumnsRenamed({k: f"__k_{k}" for k in entity})
    mean = per.agg((F.count("*") / F.sum("__n")).alias("__mean"))  # one row: entities over rows
    on = F.lit(True)
    for k in entity:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    met = rows.join(per, on).join(F.broadcast(mean))
    return met.withColumn(name, 1.0 / F.col("__n") / F.col("__mean")).drop("__n", "__mean", *[f"__k_{k}" for k in entity])


def two_level_weights(rows: DataFrame, entity: str, snapshot: str, name: str) -> DataFrame:
    """``1 / snapshots of the entity / rows of the snapshot``."""
    per = rows.groupBy(entity).agg(F.countDistinct(snapshot).alias("__s"))
    n = F.count("*").over(Window.partitionBy(entity, snapshot))
    return rows.withColumn("__n", n).join(per, entity).withColumn(name, 1.0 / F.col("__s") / F.col("__n")).drop("__s", "__n")


def top_k_sum(value: Column, k: int) -> Column:
    """An aggregate: sum of the ``k`` largest values of a group of bounded length."""
    return F.aggregate(F.slice(F.sort_array(F.collect_list(value), asc=False), 1, k), F.lit(0.0), lambda a, x: a + x)


def weighted_mode(rows: DataFrame, keys: list[str], category: str, weight: str, order: str, name: str) -> DataFrame:
    """The category of greatest weight; ties go to the latest, then the greatest."""
    per = rows.groupBy(*keys, category).agg(F.sum(weight).alias("w"), F.max(order).alias("last"))
    return per.groupBy(*keys).agg(F.max_by(category, F.struct("w", "last", category)).alias(name))


def ordered_set(value: Column, separator: str = " | ") -> Column:
    """An aggregate: the sorted distinct values as one string."""
    return F.array_join(F.array_sort(F.collect_set(value)), separator)


def latest_non_null(value: str, order: str) -> Column:
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def weighted_quantiles(rows: DataFrame, keys: list[str], value: str, weight: str, levels: tuple[float, ...]) -> DataFrame:
    """Quantiles of the weighted distribution whose steps are centred on the values:
    linear between the middles of the weights, held at the ends."""
    order = Window.partitionBy(*keys).orderBy(value)
    some = rows.filter(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*keys, value).agg(F.sum(weight).alias("w"))
    upto = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("w").over(Window.partitionBy(*keys))
    placed = some.withColumn("at", (upto - F.col("w") / 2) / total)
    after = placed.withColumn("next_at", F.lead("at").over(order)).withColumn("next", F.lead(value).over(order)).withColumn("first", F.row_number().over(order) == 1)
    v, nxt = F.col(value), F.col("next")
    aggs = []
    for q in levels:
        inside = (F.col("at") <= q) & (F.col("next_at") > q)
        below = F.col("first") & (F.col("at") > q)
        above = F.col("next_at").isNull() & (F.col("at") <= q)
        here = F.when(inside, v + (nxt - v) * (q - F.col("at")) / (F.col("next_at") - F.col("at"))).when(below | above, v)
        aggs.append(F.max(here).alias(f"q{round(q * 100):02d}"))
    return after.groupBy(*keys).agg(*aggs)


def shrunken_rates(rows: DataFrame, levels: list[list[str]], event: str, prior: float = 50.0, weight: str | None = None) -> list[DataFrame]:
    """A table for each level, from none (one row) to the finest: ``n, events, rate``
    with ``rate = (events + prior * parent's rate) / (n + prior)``. One pass over the
    rows makes the finest counts; coarser ones are sums of those."""
    w = F.col(weight) if weight else F.lit(1.0)
    base = rows.groupBy(*levels[-1]).agg(F.sum(w).alias("n"), F.sum(w * F.col(event)).alias("events"))
    out = []
    for i, keys in enumerate(levels):
        t = base.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("events").alias("events"))
        if i == 0:
            t = t.withColumn("rate", F.col("events") / F.nullif(F.col("n"), F.lit(0)))
        else:
            above = out[-1].select(*levels[i - 1], F.col("rate").alias("__above"))
            t = t.join(above, levels[i - 1]) if levels[i - 1] else t.join(F.broadcast(above))
            t = t.withColumn("rate", (F.col("events") + prior * F.col("__above")) / (F.col("n") + prior)).drop("__above")
        out.append(t)
    return out


def kernel_curve(rows: DataFrame, keys: list[str], at: str, value: str, entity: str, bandwidth: int = 2, least: int = 100) -> DataFrame:
    """Mean of ``value`` around each whole ``at`` with a triangular kernel, where at
    least ``least`` entities are near. Rows are spread over their few neighbours."""
    near = rows.withColumn("point", F.explode(F.sequence(F.col(at) - bandwidth, F.col(at) + bandwidth)))
    w = 1.0 - F.abs(F.col("point") - F.col(at)) / (bandwidth + 1.0)
    found = near.groupBy(*keys, "point").agg(weighted_mean(F.col(value), w).alias("mean"), F.countDistinct(entity).alias("entities"))
    return found.filter(F.col("entities") >= least)


def consensus(rows: DataFrame, keys: list[str], rank: str, percentile: str, source: str, day: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.median(rank).alias("median_rank"), F.median(percentile).alias("median_percentile"), F.countDistinct(source).alias("sources"), F.max(day).alias("as_of"))


def survival(hazard: Column, partition: list[str], order: str) -> Column:
    """Cumulative ``1 - prod(1 - h)``."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return 1 - F.exp(F.sum(F.log(1 - hazard)).over(w))
