"""Calibration and discrimination of probabilities, as aggregates over rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwise.operators.ranking import ranked
from pitwise.operators.sizes import broadcast_if_small
from pitwise.sources.scratch import cut

CLIP = 1e-6


def brier(p: Column, y: Column, w: Column | None = None) -> Column:
    w = F.lit(1.0) if w is None else w
    return F.sum(w * (p - y) * (p - y)) / F.nullif(F.sum(w), F.lit(0))


def log_loss(p: Column, y: Column, w: Column | None = None) -> Column:
    w = F.lit(1.0) if w is None else w
    q = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
    return -F.sum(w * (y * F.log(q) + (1 - y) * F.log(1 - q))) / F.nullif(F.sum(w), F.lit(0))


def _by_score(rows: DataFrame, keys: list[str], p: str, y: str, w: str | None) -> DataFrame:
    """Positive and negative weight of each distinct score: what follows windows over
    distinct scores, not over rows."""
    weight = F.col(w) if w else F.lit(1.0)
    return rows.groupBy(*keys, F.col(p).alias("p")).agg(F.sum(weight * F.col(y)).alias("pos"), F.sum(weight * (1 - F.col(y))).alias("neg"))


def auc(rows: DataFrame, keys: list[str], p: str, y: str, w: str | None = None) -> DataFrame:
    """``auc`` by the rank sum, ties halved; null without both classes."""
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    t = _by_score(rows, keys, p, y, w).withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
    return t.groupBy(*keys).agg((F.sum("won") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def average_precision(rows: DataFrame, keys: list[str], p: str, y: str, w: str | None = None) -> DataFrame:
    """``ap``: precision at each distinct score, weighted by the recall it adds."""
    onward = Window.partitionBy(*keys).orderBy(F.col("p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = F.sum("pos").over(onward)
    t = _by_score(rows, keys, p, y, w).withColumn("precision", found / F.nullif(found + F.sum("neg").over(onward), F.lit(0)))
    return t.groupBy(*keys).agg((F.sum(F.col("pos") * F.col("precision")) / F.nullif(F.sum("pos"), F.lit(0))).alias("ap"))


def reliability(rows: DataFrame, keys: list[str], p: str, y: str, bins: int = 10, edges: tuple[float, ...] | None = None) -> DataFrame:
    """``bin, n, mean_p, mean_y`` in equal widths, or between fixed inner edges."""
    x = F.col(p)
    if edges:
        b = sum(((x > e).cast("int") for e in edges), F.lit(0))
    else:
        b = F.least(F.floor(x * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))


def expected_calibration_error(table: DataFrame, keys: list[str]) -> DataFrame:
    gap = F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.nullif(F.sum("n"), F.lit(0))
    return table.groupBy(*keys).agg(gap.alias("ece"))


def top_lift(rows: DataFrame, keys: list[str], p: str, y: str, share: float = 0.1) -> DataFrame:
    """Event rate of all rows that score at least as the ``ceil(share n)``-th, over the
    rate of all: ties at the cut are in."""
    scores = rows.groupBy(*keys, F.col(p).alias("p")).agg(F.count("*").alias("n"), F.sum(F.col(y)).alias("e"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(F.col("p").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy(*keys))
    t = scores.withColumn("inside", before < F.ceil(total * share))
    rate = F.sum(F.when(F.col("inside"), F.col("e"))) / F.sum(F.when(F.col("inside"), F.col("n")))
    return t.groupBy(*keys).agg((rate / F.nullif(F.sum("e") / F.sum("n"), F.lit(0))).alias("lift"))


def interval_quality(low: str, mid: str, high: str, actual: str) -> list[Column]:
    inside = F.col(actual).between(F.col(low), F.col(high))
    return [F.avg(inside.cast("int")).alias("coverage"), F.avg(F.abs(F.col(mid) - F.col(actual))).alias("mae"), F.median(F.col(high) - F.col(low)).alias("median_width")]


def sufficient_cells(rows: DataFrame, keys: list[str], entity: str, y: str, least_rows: int = 2500, least_entities: int = 100) -> DataFrame:
    t = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col(y) == 1, F.col(entity))).alias("event_entities"), F.countDistinct(F.when(F.col(y) == 0, F.col(entity))).alias("other_entities"))
    return t.withColumn("sufficient", (F.col("n") >= least_rows) & (F.col("event_entities") >= least_entities) & (F.col("other_entities") >= least_entities))


def drawn_of_block(seed: int, clusters: int, size: int, block: int, replicates: int) -> np.ndarray:
    """How many of each replicate's ``clusters`` draws fall to a block of ``size`` consecutive
    clusters: the range is halved down to the block, and at each halving the draws are
    split by a binomial that depends on seed and range alone, so all blocks agree and
    their counts sum to the draws."""
    lo, hi, drawn = 0, -(-clusters // size), np.full(replicates, clusters)
    while hi - lo > 1:
        middle = (lo + hi) // 2
        share = (middle - lo) * size / (min(clusters, hi * size) - lo * size)
        left = np.random.Generator(np.random.Philox(key=[seed, lo << 32 | hi])).binomial(drawn, share)
        lo, hi, drawn = (lo, middle, left) if block < middle else (middle, hi, drawn - left)
    return drawn


def multiplicities(seed: int, clusters: int, size: int, block: int, replicates: int) -> np.ndarray:
    """replicates x clusters of the block: the multinomial counts of one resampling of all
    clusters with replacement, seen from this block."""
    n = min(clusters, (block + 1) * size) - block * size
    rng = np.random.Generator(np.random.Philox(key=[seed ^ 0x5851F42D4C957F2D, block]))
    return rng.multinomial(drawn_of_block(seed, clusters, size, block, replicates), np.full(n, 1 / n))


def cluster_bootstrap(rows: DataFrame, cluster: str, statistics: dict[str, tuple[Column, Column]], replicates: int = 2000, seed: int = 29, cells: tuple[str, ...] = (), block: int = 1024) -> DataFrame:
    """``replicate, cells`` and each statistic (a ratio of two sums), in each replicate over as
    many clusters as there are, drawn with replacement; all rows of a cluster go together,
    and the draw is the same for all statistics and cells.

    Rows are summed to one a cluster and cell, clusters are numbered by a hash, and a block of
    consecutive numbers gives one row of sums a replicate and cell: its part of the
    multinomial counts follows from seed and block alone, so no task sees the clusters of
    another and nothing grows with clusters times replicates."""
    sums = []
    for name, (top, bottom) in statistics.items():
        sums += [F.sum(top).cast("double").alias(f"{name}_t"), F.sum(bottom).cast("double").alias(f"{name}_b")]
    columns = [f"{n}_{e}" for n in statistics for e in "tb"]
    per = cut(rows.groupBy(F.col(cluster).alias("__c"), *cells).agg(*sums), "clusters")
    numbered = ranked(per.select("__c").distinct().withColumn("__h", F.xxhash64(F.lit(seed), F.col("__c").cast("string"))), [F.col("__h"), F.col("__c")], "__n")
    clusters = per.select("__c").distinct().count()
    placed = per.join(numbered.select(F.col("__c").alias("__d"), (F.col("__n") - 1).alias("__n")), F.col("__c").eqNullSafe(F.col("__d")))
    placed = placed.select(*cells, *columns, F.expr(f"__n div {block}").alias("__block"), (F.col("__n") % block).cast("int").alias("__at"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = multiplicities(seed, clusters, block, int(pdf["__block"].iloc[0]), replicates)
        out = []
        for values, own in pdf.groupby(list(cells), dropna=False, sort=False) if cells else [((), pdf)]:
            made = pd.DataFrame(counts[:, own["__at"].to_numpy()] @ own[columns].fillna(0.0).to_numpy(), columns=columns)
            made["replicate"] = np.arange(replicates, dtype=np.int32)
            for name, value in zip(cells, values):
                made[name] = [None if value is None or value != value else value] * replicates
            out.append(made[["replicate", *cells, *columns]])
        return pd.concat(out)

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in cells)
    drawn = placed.groupBy("__block").applyInPandas(draw, "replicate int, " + (kinds + ", " if cells else "") + ", ".join(f"`{c}` double" for c in columns))
    return drawn.groupBy("replicate", *cells).agg(*[(F.sum(f"{n}_t") / F.nullif(F.sum(f"{n}_b"), F.lit(0.0))).alias(n) for n in statistics])


def bootstrap_intervals(replicates: DataFrame, names: list[str], low: float = 0.025, high: float = 0.975, cells: tuple[str, ...] = ()) -> DataFrame:
    """``cells`` and the interval of each statistic over the replicates that have it."""
    return replicates.groupBy(*cells).agg(*[F.percentile(n, F.lit(q)).alias(f"{n}_{w}") for n in names for w, q in (("low", low), ("high", high))])  # a value a replicate


def paired_improvements(rows: DataFrame, cluster: str, cells: tuple[str, ...], y: str, candidate: str, baselines: list[str], replicates: int = 2000, seed: int = 29) -> tuple[DataFrame, DataFrame]:
    """How much lower than each baseline's the candidate's Brier score is, in each cell:
    ``cells, baseline, rows, clusters, estimate``, and the same of each replicate (``replicate, cells, baseline, estimate``)."""
    better = {b: (F.col(b) - F.col(y)) ** 2 - (F.col(candidate) - F.col(y)) ** 2 for b in baselines}
    listed = F.explode(F.array(*[F.struct(F.lit(b).alias("baseline"), F.col(b).alias("estimate")) for b in baselines])).alias("x")
    points = rows.groupBy(*cells).agg(F.count("*").alias("rows"), F.countDistinct(cluster).alias("clusters"), *[F.avg(v).alias(b) for b, v in better.items()])
    drawn = cluster_bootstrap(rows, cluster, {b: (v, F.lit(1.0)) for b, v in better.items()}, replicates, seed, cells)
    return points.select(*cells, "rows", "clusters", listed).select(*cells, "rows", "clusters", "x.*"), drawn.select("replicate", *cells, listed).select("replicate", *cells, "x.*")


def macro_comparison(points: DataFrame, drawn: DataFrame, cells: tuple[str, ...], share: float = 0.75) -> DataFrame:
    """A row for each baseline: the mean improvement over its cells, every cell weighing the
    same, its interval over replicates that have all cells, and gates: ``macro_ok`` (the interval lies above
    nothing), ``none_worse`` (no cell's interval lies below it), ``most_better`` (``share`` of the cells
    improve), ``passed`` (all of them)."""
    by = points.groupBy("baseline").agg(F.count("estimate").alias("cells"), F.avg("estimate").alias("macro"), F.count_if(F.col("estimate") > 0).alias("better"))
    macro = drawn.groupBy("replicate", "baseline").agg(F.avg("estimate").alias("macro"), F.count("estimate").alias("__n")).join(broadcast_if_small(by.select("baseline", "cells")), "baseline")
    whole = bootstrap_intervals(macro.filter(F.col("__n") == F.col("cells")), ["macro"], cells=("baseline",))
    worse = bootstrap_intervals(drawn, ["estimate"], cells=(*cells, "baseline")).groupBy("baseline").agg(F.count_if(F.col("estimate_high") < 0).alias("worse"))
    out = by.join(whole, "baseline", "left").join(worse, "baseline", "left")
    gates = {"macro_ok": F.coalesce(F.col("macro_low") > 0, F.lit(False)), "none_worse": F.col("worse") == 0, "most_better": F.col("better") >= share * F.col("cells")}
    out = out.withColumns(gates)
    return out.withColumn("passed", F.col("macro_ok") & F.col("none_worse") & F.col("most_better"))


def promotion_gates(cells: DataFrame, gates: dict[str, Column], share: float = 0.75) -> DataFrame:
    """``gate, passed, cells, ok``: a gate holds if ``share`` of the cells pass it."""
    made = [F.struct(F.lit(n).alias("gate"), F.coalesce(g, F.lit(False)).alias("pass")) for n, g in gates.items()]
    t = cells.select(F.inline(F.array(*made))).groupBy("gate").agg(F.count_if("pass").alias("passed"), F.count("*").alias("cells"))
    return t.withColumn("ok", F.col("passed") >= share * F.col("cells"))
