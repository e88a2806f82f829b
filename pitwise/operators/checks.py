"""Expectations, gates, audits and drift. Violations are rows, not exceptions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitwise.operators.split import exact_quantiles


class ContractError(ValueError):
    """A table does not have the columns that it promises."""


def exact_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    lacking, extra = set(names) - set(rows.columns), set(rows.columns) - set(names)
    if lacking or extra:
        raise ContractError(f"lacking {sorted(lacking)}, not expected {sorted(extra)}")
    return rows


def no_leaks(features: list[str], forbidden: tuple[str, ...]) -> list[str]:
    """The feature names, if none has a token that only the future knows."""
    bad = [f for f in features if set(f.lower().split("_")) & set(forbidden)]
    if bad:
        raise ContractError(f"features tell the future: {bad}")
    return features


def violations(rows: DataFrame, rules: dict[str, Column], unique: list[str] | None = None) -> DataFrame:
    """``rule, n`` for every rule: rows for which it is not true (null counts as not),
    and keys that repeat. One pass for the rules."""
    counts = rows.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules])
    out = counts.select(F.inline(pairs))
    if unique:
        again = rows.groupBy(*unique).count().filter("count > 1").agg(F.count("*").alias("n"))
        out = out.unionByName(again.select(F.lit("unique:" + ",".join(unique)).alias("rule"), "n"))
    return out


def rows_needed(previous: int, least: int, share: float = 0.6) -> int:
    return max(least, math.ceil(share * previous))


def retention(previous: DataFrame, now: DataFrame, counts: dict[str, Column], stamp: str, share: float = 0.8) -> DataFrame:
    """``measure, before, after, ok``: each count keeps its share of the one before, and
    the newest stamp does not go back. Both sides are one row."""
    aggs = [e.alias(n) for n, e in counts.items()]
    a = previous.agg(*aggs, F.max(stamp).alias("__stamp")).select(F.struct("*").alias("a"))
    b = now.agg(*aggs, F.max(stamp).alias("__stamp")).select(F.struct("*").alias("b"))
    rows = [F.struct(F.lit(n).alias("measure"), F.col(f"a.{n}").cast("long").alias("before"), F.col(f"b.{n}").cast("long").alias("after"), (F.col(f"b.{n}") >= F.ceil(F.col(f"a.{n}") * share)).alias("ok")) for n in counts]
    rows.append(F.struct(F.lit("stamp").alias("measure"), F.lit(None).cast("long").alias("before"), F.lit(None).cast("long").alias("after"), (F.col("b.__stamp") >= F.col("a.__stamp")).alias("ok")))
    return a.join(F.broadcast(b)).select(F.inline(F.array(*rows)))


def one_sided(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """``left_only, right_only, both`` key counts, nulls equal to nulls."""
    a, b = left.select(*on).distinct(), right.select(*on).distinct()
    names = [F.col(c).alias(f"__{c}") for c in on]
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__{c}"))
    joined = a.withColumn("__l", F.lit(1)).join(b.select(*names, F.lit(1).alias("__r")), cond, "full")
    return joined.agg(F.count_if(F.col("__r").isNull()).alias("left_only"), F.count_if(F.col("__l").isNull()).alias("right_only"), F.count_if(F.col("__l").isNotNull() & F.col("__r").isNotNull()).alias("both"))


def exclusion_counts(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """``flag, excluded``, with ``all`` for the rows that any flag excludes."""
    ok = {n: F.coalesce(f, F.lit(False)) for n, f in flags.items()}
    every = F.lit(True)
    for f in ok.values():
        every = every & f
    return violations(rows, ok | {"all": every}).withColumnRenamed("rule", "flag").withColumnRenamed("n", "excluded")


def manifest_errors(manifests: DataFrame, members: DataFrame, on: str, role: str | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """``on, errors``: manifests whose members do not add up (count, bytes, ordinals
    from 0 without gaps) or lack a ``required`` role."""
    roles = [F.count_if(F.col(role) == r).alias(f"__r{i}") for i, r in enumerate(required)]
    m = members.groupBy(on).agg(*roles, F.count("*").alias("__n"), F.sum("bytes").alias("__b"), F.min("ordinal").alias("__lo"), F.max("ordinal").alias("__hi"), F.countDistinct("ordinal").alias("__d"))
    j = manifests.join(m, on, "left")
    errors = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("__n") == F.col("member_count"), F.lit(False)), "count"),
        F.when(~F.coalesce(F.col("__b") == F.col("total_bytes"), F.lit(False)), "bytes"),
        F.when(~F.coalesce((F.col("__lo") == 0) & (F.col("__hi") == F.col("__n") - 1) & (F.col("__d") == F.col("__n")), F.lit(False)), "ordinals"),
        *[F.when(F.coalesce(f"__r{i}", F.lit(0)) == 0, f"role:{r}") for i, r in enumerate(required)],
    ))
    return j.select(on, F.array_join(errors, ",").alias("errors")).filter("errors <> ''")


def stability_index(reference: DataFrame, now: DataFrame, value: str, edges: list[float], smooth: float = 1e-6) -> DataFrame:
    """``bucket, reference, now, part``: shares by bucket (a missing value is bucket -1)
    and each bucket's part of the population stability index."""
    bucket = F.when(F.col(value).isNull(), -1).otherwise(sum(((F.col(value) > e).cast("int") for e in edges), F.lit(0)))

    def shares(rows, name):
        counts = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("__n"))
        total = rows.agg(F.count("*").alias("__t"))
        return counts.join(F.broadcast(total)).select("bucket", (F.col("__n") / F.col("__t")).alias(name))

    j = shares(reference, "reference").join(shares(now, "now"), "bucket", "full").fillna(0.0, ["reference", "now"])
    a, b = F.col("reference") + smooth, F.col("now") + smooth
    return j.withColumn("part", (b - a) * F.log(b / a))


def decile_edges(rows: DataFrame, value: str) -> list[float]:
    """Nine edges, exact."""
    found = exact_quantiles(rows, [], value, tuple(i / 10 for i in range(1, 10))).first()
    return found["quantiles"] if found else []


def unseen_share(reference: DataFrame, now: DataFrame, category: str) -> DataFrame:
    known = reference.select(category).distinct().withColumn("__known", F.lit(1))
    return now.join(known, category, "left").agg(F.avg(F.when(F.col(category).isNotNull(), F.col("__known").isNull().cast("int"))).alias("unseen"), F.avg(F.col(category).isNull().cast("int")).alias("missing"))
