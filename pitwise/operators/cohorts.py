"""Complete cohorts and standing within cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwise.operators.sizes import broadcast_if_small
from pitwise.operators.split import SPLIT_ROWS, placed_values, running
from pitwise.sources.scratch import cut


def complete_cohorts(rows: DataFrame, keys: list[str], member: str, size: int) -> DataFrame:
    """The keys with exactly ``size`` distinct members."""
    return rows.groupBy(*keys).agg(F.countDistinct(member).alias("members")).filter(F.col("members") == size)


def latest_complete_cohort(rows: DataFrame, within: list[str], slice_col: str, member: str, size: int) -> DataFrame:
    """The rows of the last complete slice (of each ``within`` group, if any)."""
    done = complete_cohorts(rows, [*within, slice_col], member, size)
    last = done.groupBy(*within).agg(F.max(slice_col).alias(slice_col))
    return rows.join(F.broadcast(last) if not within else last, [*within, slice_col], "left_semi")


def cohort_percent_rank(rows: DataFrame, keys: list[str], value: str, name: str, least_peers: int = 25, digits: int = 6, alone: float | None = None, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Percent rank times 100 within the cohort; null below ``least_peers`` peers or
    without a value. With ``least_peers`` 1, ``alone`` is given to a cohort of one."""
    counted = running(rows, keys, value, {"rank": F.when(F.col(value).isNotNull(), 1).otherwise(0)}, split_rows)
    peers = F.col("all_rank")
    rank = F.when(peers > 1, 100.0 * (F.col("upto_rank") - F.col("tied_rank")) / (peers - 1)).otherwise(F.lit(0.0 if alone is None else alone))
    out = counted.withColumn("peers", peers).withColumn(name, F.when(F.col(value).isNotNull() & (peers >= least_peers), F.round(rank, digits)))
    return out.drop("upto_rank", "tied_rank", "all_rank")


def mid_rank_percentile(rows: DataFrame, keys: list[str], value: str, weight: Column, name: str, digits: int | None = None, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``100 (below + tied / 2) / total`` in weights; with ``digits`` values tie that agree to
    as many decimals."""
    if digits is None:
        out = running(rows, keys, value, {"w": weight}, split_rows)
    else:
        out = running(rows.withColumn("__rounded", F.round(value, digits)), keys, "__rounded", {"w": weight}, split_rows).drop("__rounded")
    return out.withColumn(name, 100 * (F.col("upto_w") - F.col("tied_w") / 2) / F.nullif(F.col("all_w"), F.lit(0))).drop("upto_w", "tied_w", "all_w")


def adaptive_window_percentile(
    targets: DataFrame, peers: DataFrame, on: list[str], age: str, value: str, entity: str, season: str, windows: tuple[int, ...] = (0, 1, 2, 3), least: int = 100, by_row: bool = False, split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """The standing of each target among earlier seasons of others, in the narrowest
    age window with ``least`` distinct entities; null if none has as many. Each entity
    in the window weighs the same, however many rows it has there; with ``by_row`` each
    row does. Values that agree to twelve decimals tie; a peer without a value weighs as any, and lies neither below nor beside.

    No target meets a peer. A *pool* is the peers of one cohort, target season, target age
    and window. Which window is wide enough is read from the season in which each peer first
    came within each window of an age, so that takes no row per later season; only the pools
    that are then used are laid out, sorted by value once, with the targets among them at
    weight nothing, so a running sum gives every target the weight below and beside it; what
    the target's own rows weigh there is worked out from those rows and taken out.

    Peers are dealt out by entity, and what ages and pools they meet is broadcast where it is small,
    so the rows laid out for them are counted and weighed where they lie: only sums are
    shuffled. Both inputs are read more than once; give tables."""
    widest, keys = max(windows), list(dict.fromkeys([*on, entity, season, age, value]))
    exact = F.round(F.col(value).cast("double"), 12)
    t = targets.select(*keys).repartition(*on, entity).distinct().select("*", exact.alias("__v"))
    p = peers.select(*on, F.col(age).alias("__own"), F.col(season).alias("__season"), F.col(entity).alias("__peer"), exact.alias("__v")).repartition(*on, "__peer")
    wanted = cut(targets.select(*on, F.col(season).alias("__at"), F.col(age).alias("__age")).distinct(), "wanted")
    ages = broadcast_if_small(wanted.select(*on, "__age").distinct())
    near = p.withColumn("__age", F.explode(F.sequence(F.col("__own") - widest, F.col("__own") + widest))).withColumn("__gap", F.abs(F.col("__age") - F.col("__own")))
    # the season in which each peer first comes within each window of an age, and how many had by each target's
    first = near.join(ages, [*on, "__age"], "left_semi").groupBy(*on, "__age", "__peer").agg(*[F.min(F.when(F.col("__gap") <= w, F.col("__season"))).alias(f"__f{w}") for w in windows])
    came = first.unpivot([*on, "__age"], [f"__f{w}" for w in windows], "__w", "__f").filter("__f is not null").groupBy(*on, "__age", "__w", "__f").agg(F.count("*").alias("__n"))
    have = wanted.join(came, [*on, "__age"]).filter(F.col("__f") < F.col("__at"))  # seasons by seasons
    have = cut(have.groupBy(*on, "__at", "__age").agg(*[F.coalesce(F.sum(F.when(F.col("__w") == f"__f{w}", F.col("__n"))), F.lit(0)).alias(f"__n{w}") for w in windows]), "peers")
    named = lambda rows: rows.withColumnsRenamed({"__at": season, "__age": age})
    # the target's own rows in each window: how many, and how many of them lie below it
    mine = p.withColumnsRenamed({**{k: f"__on_{k}" for k in on}, "__v": "__mine"})
    gap, met = F.abs(F.col(age) - F.col("__own")), F.col(entity) == F.col("__peer")
    for k in on:
        met = met & (F.col(k) == F.col(f"__on_{k}"))
    t = t.join(mine, met & (F.col("__season") < F.col(season)) & (gap <= widest), "left")
    below = F.when(F.col("__mine") < F.col("__v"), 1.0).when(F.col("__mine") == F.col("__v"), 0.5).otherwise(0.0)
    own = [x for w in windows for x in (F.count_if(gap <= w).alias(f"__c{w}"), F.sum(F.when(gap <= w, below)).alias(f"__s{w}"))]
    t = t.groupBy(*keys, "__v").agg(*own).join(broadcast_if_small(named(have)), [*on, season, age], "left")
    t = t.withColumn("window", F.coalesce(*[F.when(F.col(f"__n{w}") - (F.col(f"__c{w}") > 0).cast("int") >= least, F.lit(w)) for w in windows]))
    count, score = (F.coalesce(*[F.when(F.col("window") == w, F.col(f"__{c}{w}")) for w in windows], F.lit(0)) for c in "cs")
    t = cut(t.select(*keys, "__v", "window", (count if by_row else F.least(count, F.lit(1))).alias("__all"), (score if by_row else score / F.greatest(count, F.lit(1))).alias("__score")), "windows")
    # the pools that are used, weighed
    whole = [*on, "__at", "__age", "__window"]
    asked = t.filter("window is not null").select(*on, F.col(season).alias("__at"), F.col(age).alias("__age"), F.col("window").alias("__window"), "__v").distinct()
    pools = asked.select(*whole).distinct().withColumn("__own", F.explode(F.sequence(F.col("__age") - F.col("__window"), F.col("__age") + F.col("__window"))))
    weighed = p.join(broadcast_if_small(pools), [*on, "__own"]).filter(F.col("__season") < F.col("__at"))
    weight = F.lit(1.0) if by_row else 1 / F.count("*").over(Window.partitionBy(*whole, "__peer"))
    sums = weighed.select(*whole, "__v", weight.alias("__w")).unionByName(asked.withColumn("__w", F.lit(0.0)))
    along = named(placed_values(sums, whole, "__v", {"w": F.when(F.col("__v").isNotNull(), F.col("__w")).otherwise(0.0), "any": F.col("__w")}, split_rows)).withColumnRenamed("__window", "window")
    percentile = 100 * (F.col("upto_w") - F.col("tied_w") / 2 - F.col("__score")) / (F.col("all_any") - F.col("__all"))
    return t.join(along, [*on, season, age, "window", "__v"], "left").select(*keys, "window", percentile.alias("percentile"))
