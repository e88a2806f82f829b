"""Joins that check themselves, merges of sources, and identities that stay
unresolved when they are ambiguous."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class CardinalityError(ValueError):
    """A side of a join has keys more than once."""


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", kind: str = "many_to_one") -> DataFrame:
    """A join whose sides are first tested for repeated keys, as ``kind`` says."""
    sides = {"many_to_one": [right], "one_to_many": [left], "one_to_one": [left, right]}[kind]
    for side in sides:
        again = side.groupBy(*on).count().filter("count > 1").limit(5).collect()
        if again:
            raise CardinalityError(f"keys {on} repeat: {[tuple(r)[:-1] for r in again]}")
    return left.join(right, on, how)


def unique_keys(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key occurs once; ambiguous and null keys are dropped."""
    once = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")).filter("__n = 1").select(key)
    return rows.join(once, key, "left_semi")


def one_to_one(rows: DataFrame, source: str, target: str) -> DataFrame:
    """Distinct (source, target) pairs in which neither side has another partner."""
    pairs = rows.filter(F.col(source).isNotNull() & F.col(target).isNotNull()).select(source, target).distinct()
    return unique_keys(unique_keys(pairs, source), target)


def full_merge(left: DataFrame, right: DataFrame, on: list[str], shared: list[str], digits: int | None = None) -> DataFrame:
    """Full outer join; for each shared column the left value, else the right one,
    with ``<column>_conflict`` where both are there and differ."""
    a = left.select(*on, *[F.col(c).alias(f"__l_{c}") for c in shared], *[c for c in left.columns if c not in (*on, *shared)], F.lit(True).alias("in_left"))
    b = right.select(*on, *[F.col(c).alias(f"__r_{c}") for c in shared], *[c for c in right.columns if c not in (*on, *shared)], F.lit(True).alias("in_right"))
    out = a.join(b, on, "full")
    for c in shared:
        x, y = F.col(f"__l_{c}"), F.col(f"__r_{c}")
        out = out.withColumn(c, F.coalesce(x, y)).withColumn(f"{c}_conflict", x.isNotNull() & y.isNotNull() & (x != y))
    out = out.withColumn("in_left", F.coalesce("in_left", F.lit(False))).withColumn("in_right", F.coalesce("in_right", F.lit(False)))
    return out.drop(*[f"__{s}_{c}" for s in "lr" for c in shared])


def overlay(base: DataFrame, over: DataFrame, on: list[str], columns: list[str], origin: str = "origin") -> DataFrame:
    """``over`` overwrites ``columns`` where it matches and has a value, and its other
    rows are appended. ``origin`` tells base, overlaid or added."""
    b = base.select(*on, *[F.col(c).alias(f"__b_{c}") for c in columns], F.lit(1).alias("__b"))
    o = over.select(*on, *[F.col(c).alias(f"__o_{c}") for c in columns], F.lit(1).alias("__o"))
    kind = F.when(F.col("__o").isNull(), "base").when(F.col("__b").isNull(), "added").otherwise("overlaid")
    return b.join(o, on, "full").select(*on, *[F.coalesce(f"__o_{c}", f"__b_{c}").alias(c) for c in columns], kind.alias(origin))


def overlay_chain(base: DataFrame, overs: list[tuple[str, DataFrame]], on: list[str], columns: list[str]) -> DataFrame:
    """``base`` under named overlays, later ones over earlier; ``origin`` names the last source
    that gave the row anything."""
    out = base.select(*on, *columns, F.lit("base").alias("origin"))
    for name, over in overs:
        laid = overlay(out, over, on, columns, "__kind").join(out.select(*on, "origin"), on, "left")
        out = laid.select(*on, *columns, F.when(F.col("__kind") == "base", F.col("origin")).otherwise(F.lit(name)).alias("origin"))
    return out


def removed_by_merge(first: DataFrame, second: DataFrame, on: list[str]) -> DataFrame:
    """One row: the rows of ``second`` that a merge adds, and those it leaves out."""
    there = first.select(*on).distinct().withColumn("__there", F.lit(True))
    met = second.join(there, on, "left")
    return met.agg(F.count_if(F.col("__there").isNull()).alias("added"), F.count_if("__there").alias("removed"))


def merge_missing(first: DataFrame, second: DataFrame, on: list[str]) -> DataFrame:
    """All of ``first`` and the rows of ``second`` whose key it lacks."""
    return first.unionByName(second.join(first.select(*on), on, "left_anti"))


def fallback_lookup(rows: DataFrame, tables: list[tuple[DataFrame, list[str]]], value: str, name: str, level: str | None = None) -> DataFrame:
    """The value of the most specific table that has the row's key, in the given
    order; an empty key list is a table of one row for all."""
    found = []
    for i, (table, keys) in enumerate(tables):
        t = table.select(*keys, F.col(value).alias(f"__v{i}"))
        rows = rows.join(t, keys, "left") if keys else rows.join(F.broadcast(t))
        found.append(f"__v{i}")
    out = rows.withColumn(name, F.coalesce(*found))
    if level:
        out = out.withColumn(level, F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(i)) for i, c in enumerate(found)]))
    return out.drop(*found)


def priority_match(rows: DataFrame, registers: list[tuple[str, DataFrame]], target: str, status: str = "match_status") -> DataFrame:
    """Match by several keys in order of trust. Each register is (key column, table
    with that key and ``target``); only its unique keys count. Rows whose keys lead to
    different targets are collisions and get none."""
    found = []
    for key, table in registers:
        t = unique_keys(table.select(key, F.col(target).alias(f"__t_{key}")).distinct(), key)
        rows = rows.join(t, key, "left")
        found.append(f"__t_{key}")
    distinct = F.size(F.array_distinct(F.array_compact(F.array(*found))))
    best = F.when(distinct == 1, F.coalesce(*found))
    by = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c[4:])) for c in found])
    said = F.when(distinct > 1, "id_collision").when(distinct == 1, by).otherwise("unmatched")
    return rows.withColumn(target, best).withColumn(status, said).drop(*found)


def resolve_identities(current: DataFrame, historical: DataFrame, source: str, target: str) -> DataFrame:
    """One row for each source id with the target it surely has, or none, and why.

    Tuples are counted on both sides; the first condition that holds names the status:
    a source with several targets in one side conflicts there, two sides that disagree
    conflict with each other, a target that several sources claim over both sides
    conflicts in the census; else the current or the historical tuple is exact."""

    def counted(rows, side):
        pairs = rows.filter(F.col(source).isNotNull()).select(source, target)
        return pairs.groupBy(source).agg(F.countDistinct(target).alias(f"{side}_targets"), F.min(target).alias(f"{side}_target"))

    both = counted(current, "current").join(counted(historical, "historical"), source, "full")
    both = both.fillna(0, ["current_targets", "historical_targets"])
    claims = current.select(source, target).unionByName(historical.select(source, target)).filter(F.col(target).isNotNull() & F.col(source).isNotNull())
    claims = claims.groupBy(target).agg(F.countDistinct(source).alias("claimants"))
    named = both.withColumn("candidate", F.coalesce("current_target", "historical_target"))
    named = named.join(claims.withColumnRenamed(target, "candidate"), "candidate", "left")
    status = (
        # fixed values: the names of the seven statuses
        F.when(F.col("current_targets") > 1, "current_tuple_conflict")
        .when(F.col("historical_targets") > 1, "historical_tuple_conflict")
        .when(F.col("current_target") != F.col("historical_target"), "current_history_conflict")
        .when(F.col("claimants") > 1, "historical_census_conflict")
        .when(F.col("current_targets") == 1, "current_exact")
        .when(F.col("historical_targets") == 1, "historical_exact")
        .otherwise("unresolved")
    )
    out = named.withColumn("status", status)
    return out.select(source, F.when(F.col("status").isin("current_exact", "historical_exact"), F.col("candidate")).alias(target), "status")


def agree(left: Column, right: Column) -> Column:
    """Both equal, one alone, or a disagreement to be set aside."""
    return F.when(left == right, "agree").when(left.isNotNull() & right.isNotNull(), "quarantine").when(left.isNotNull(), "left_only").when(right.isNotNull(), "right_only").otherwise("none")
