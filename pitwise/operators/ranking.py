"""Total orders, ranks, percentiles and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwise.operators.split import running
from pitwise.sources.scratch import cut


def ordering(*keys: tuple[str, str]) -> list[Column]:
    """Sort keys ``(column, asc or desc)``, nulls last either way."""
    return [F.col(c).asc_nulls_last() if way == "asc" else F.col(c).desc_nulls_last() for c, way in keys]


def ranked(rows: DataFrame, order: list[Column], name: str = "rank", within: list[str] | None = None) -> DataFrame:
    """Ordinal ranks by a total order, of the whole table or ``within`` groups. Rows are
    ranged by group and order and numbered by partition, so no task sees a whole group."""
    keys = within or []
    ranged = cut(rows.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "ranked")  # written, so that a part stays what it was
    sizes = ranged.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    before = sizes.select(*[F.col(k).alias(f"__key_{k}") for k in keys], F.col("__part").alias("__of"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    on = F.col("__part") == F.col("__of")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    own = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))
    met = ranged.withColumn("__own", own).join(before, on)
    return met.withColumn(name, F.col("__before") + F.col("__own")).drop("__part", "__of", "__own", "__before", *[f"__key_{k}" for k in keys])


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of a total order."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def top_k(rows: DataFrame, within: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` of each group; Spark keeps ``k`` a group of every task before it shuffles."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order))).filter(F.col(name) <= k)


def top_share(rows: DataFrame, within: list[str], order: list[Column], share: float) -> DataFrame:
    """The first ``ceil(share * n)`` of each group."""
    n = rows.groupBy(*within).agg(F.count("*").alias("__n")).withColumnsRenamed({k: f"__of_{k}" for k in within})
    on = F.lit(True)
    for k in within:
        on = on & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return ranked(rows, order, "rank", within).join(n, on).filter(F.col("rank") <= F.ceil(F.col("__n") * share)).drop("__n", *[f"__of_{k}" for k in within])


def rank_among(live: DataFrame, reference: DataFrame, score: str, key: str, within: list[str]) -> DataFrame:
    """The rank each live row would take in the frozen reference, which wins ties."""
    both = live.select(*within, key, score, F.lit(1).alias("__live")).unionByName(reference.select(*within, key, score, F.lit(0).alias("__live")))
    counted = running(both, within, score, {"ref": 1 - F.col("__live")}).filter("__live = 1")
    return counted.withColumn("rank", F.col("all_ref") - F.col("upto_ref") + F.col("tied_ref") + 1).drop("__live", "all_ref", "upto_ref", "tied_ref")


def tail_band(percentile: Column) -> Column:
    out = F.lit("rest")
    for share in (25.0, 10.0, 5.0, 1.0, 0.1):
        out = F.when(percentile >= 100 - share, f"top {share:g}%").otherwise(out)
    return F.when(percentile.isNotNull(), out)
