"""Sums, places and exact quantiles along a sorted column within keys, however large a key.

A window over a few keys puts each key's rows into one task. Here rows are first summed by
(key, value), with partial sums before any shuffle, so a value repeated any number of times
is one row; the sums are written, and only if some key has more than ``SPLIT_ROWS`` distinct
values are they dealt out by ranges of (key, value): each part then runs on its own and
starts from the sums of the parts before it, a row a part and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwise.sources.scratch import cut

SPLIT_ROWS = 2_000_000


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def placed_values(rows: DataFrame, keys: list[str], value: str, sums: dict[str, Column], split_rows: int = SPLIT_ROWS) -> DataFrame:
    """A row for each key and value: for each of ``sums``, its sum over the rows of this value
    (``tied_``), of this or a smaller one (``upto_``), and of all the key's (``all_``). A null
    value is the smallest."""
    order = F.col(value).asc_nulls_first()
    per = cut(rows.groupBy(*keys, value).agg(*[F.sum(what).alias(f"tied_{n}") for n, what in sums.items()]), "values")
    large = per.groupBy(*keys).count().filter(F.col("count") > split_rows).limit(1).count() if per.limit(split_rows + 1).count() > split_rows else 0
    if not large:
        upto, whole = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
        return per.select("*", *[F.sum(f"tied_{n}").over(upto).alias(f"upto_{n}") for n in sums], *[F.sum(f"tied_{n}").over(whole).alias(f"all_{n}") for n in sums])
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-per.count() // split_rows))
    ranged = cut(per.repartitionByRange(parts, *keys, order).withColumn("__part", F.spark_partition_id()), "ranged")  # written, so that a part stays what it was
    totals = ranged.groupBy(*keys, "__part").agg(*[F.sum(f"tied_{n}").alias(f"__{n}") for n in sums])
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    offsets = totals.select(
        *[F.col(k).alias(f"__key_{k}") for k in keys], F.col("__part").alias("__of"),
        *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__before_{n}") for n in sums], *[F.sum(f"__{n}").over(Window.partitionBy(*keys)).alias(f"all_{n}") for n in sums],
    )
    on = F.col("__part") == F.col("__of")
    for k in keys:
        on = on & _same(k, f"__key_{k}")
    inside = Window.partitionBy(*keys, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.select("*", *[F.sum(f"tied_{n}").over(inside).alias(f"__in_{n}") for n in sums]).join(offsets, on)
    return own.select(*keys, value, *[f"tied_{n}" for n in sums], *[(F.col(f"__in_{n}") + F.col(f"__before_{n}")).alias(f"upto_{n}") for n in sums], *[f"all_{n}" for n in sums])


def running(rows: DataFrame, keys: list[str], value: str, sums: dict[str, Column], split_rows: int = SPLIT_ROWS) -> DataFrame:
    """The rows with what ``placed_values`` has for their key and value."""
    placed = placed_values(rows, keys, value, sums, split_rows)
    names = [*keys, value]
    hidden = placed.withColumnsRenamed({c: f"__p{i}" for i, c in enumerate(names)})
    on = _same(value, f"__p{len(keys)}")
    for i, k in enumerate(keys):
        on = on & _same(k, f"__p{i}")
    return rows.join(hidden, on).drop(*[f"__p{i}" for i in range(len(names))])


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, levels: tuple[float, ...], name: str = "quantiles", split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``keys, name``: an array of the quantiles of the values that are not null, linear between
    neighbours. Ranks are found in running counts over distinct values, so no task
    holds a group's values, as those of ``percentile`` do. Keys without values have no row.

    The sum of the two shares is rounded once (``Math.fma``), as DuckDB rounds it: neighbours may
    be one number with two roundings, and a bit more or less then moves rows over the quantile."""
    placed = placed_values(rows.filter(F.col(value).isNotNull()), keys, value, {"n": F.lit(1)}, split_rows)
    at = [(F.col("all_n") - 1) * float(q) for q in levels]
    reached = lambda rank: F.min(F.when(F.col("upto_n") > rank, F.col(value).cast("double")))
    found = placed.groupBy(*keys, "all_n").agg(*[reached(end(p)).alias(f"__{w}{i}") for i, p in enumerate(at) for w, end in (("lo", F.floor), ("hi", F.ceil))])

    def between(i: int, p: Column) -> Column:
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        once = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), lo, F.ceil(p) - p, hi * (p - F.floor(p))).cast("double")
        return F.when((F.floor(p) == F.ceil(p)) | (lo == hi), lo).otherwise(once)

    return found.select(*keys, F.array(*[between(i, p) for i, p in enumerate(at)]).alias(name))
