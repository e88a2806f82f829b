"""Crosswalks between identifier systems, and labels joined to predictions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitwise.functions.text import person_name
from pitwise.operators.graph import connected
from pitwise.operators.temporal import first_by, valid_at
from pitwise.sources.scratch import cut, forget

#: Groups of up to so many rows are decided in order in one task, once rounds settle little.
FOLD_ROWS = 500_000
#: A round settles enough if it leaves less than this share of the rows.
SLOW = 0.9


def _in_order(order: str, keys: list[str]):
    """A function of one group's rows: those that are accepted, going through them in order."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        seen: list[set] = [set() for _ in keys]
        kept = []
        for values in pdf[keys].itertuples(index=False):
            own = [None if v is None or v != v else v for v in values]
            ok = not any(v is not None and v in s for v, s in zip(own, seen))
            kept.append(ok)
            if ok:
                for v, s in zip(own, seen):
                    s.add(v)
        return pdf.loc[kept, [order, *keys]]

    return fold


def first_accepted(rows: DataFrame, order: str, keys: list[str], fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Rows in ``order`` (unique) of which one is accepted if no accepted one before it has
    any of its keys; ``duplicate_of`` names the first key of ``keys`` that an accepted
    earlier row has, null for the accepted. A null key is shared with nobody.

    Each round accepts the rows that come first in all of their keys and drops those which
    share a key with them: that settles most rows at once, but only two of a chain. When a
    round leaves nearly all, what is left is parted into groups that hang together
    through keys, and each group of up to ``fold_rows`` is gone through in order, in a task
    of its own; larger ones, if there are any, go on in rounds, each of which settles rows of every group."""
    left, accepted, folded = cut(rows.select(order, *keys), "undecided"), [], False
    count = left.count()

    def without(t: DataFrame, now: DataFrame) -> DataFrame:
        t = t.join(now.select(order), order, "left_anti")
        for k in keys:
            t = t.join(now.select(k).filter(F.col(k).isNotNull()), k, "left_anti")
        return t.select(order, *keys)

    while count:
        first = left
        for k in keys:
            least = left.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"__{k}"))
            first = first.join(least, k, "left")
        now = cut(first.filter(" and ".join(f"coalesce(`__{k}`, `{order}`) = `{order}`" for k in keys)).select(order, *keys), "accepted")
        accepted.append(now)
        before, left = left, cut(without(left, now), "undecided")
        forget(before)
        count, last = left.count(), count
        if count and not folded and count > SLOW * last:
            folded = True
            edges = None
            for k in keys:
                some = left.filter(F.col(k).isNotNull())
                least = some.groupBy(k).agg(F.min(order).alias("v"))
                met = some.join(least, k).select(F.col(order).alias("u"), "v")
                edges = met if edges is None else edges.unionByName(met)
            group = connected(edges).withColumnRenamed("node", order)
            placed = cut(left.join(group, order, "left").withColumn("group", F.coalesce("group", F.col(order))), "grouped")
            small = placed.groupBy("group").count().filter(F.col("count") <= fold_rows).select("group")
            kinds = T.StructType([rows.schema[c] for c in (order, *keys)])
            now = cut(placed.join(small, "group").groupBy("group").applyInPandas(_in_order(order, keys), kinds), "accepted")
            accepted.append(now)
            before, left = left, cut(placed.join(small, "group", "left_anti").select(order, *keys), "undecided")
            forget(before, placed)
            count = left.count()
    if not accepted:
        return rows.withColumn("duplicate_of", F.lit(None).cast("string"))
    whole = accepted[0]
    for t in accepted[1:]:
        whole = whole.unionByName(t)
    out = rows
    for k in keys:
        out = out.join(whole.filter(F.col(k).isNotNull()).select(k, F.col(order).alias(f"__{k}")), k, "left")
    found = F.coalesce(*[F.when(F.col(f"__{k}") < F.col(order), k) for k in keys])
    return out.select(*rows.columns, found.alias("duplicate_of"))


def compose_crosswalk(overlay: DataFrame, static: DataFrame, authority: DataFrame, order: str, a: str, b: str, c: str, season: str, valid: Column) -> DataFrame:
    """Each overlay row with its ``reason`` of refusal, of which the first that holds
    counts, or null and the season that the crosswalk then has for it.

    ``a`` names the id that is overlaid, ``b`` the authority's and ``c`` the target's. The
    authority has ``b`` once with its ``c``; the static crosswalk has ``c``, ``a`` and
    ``season``, ids once each. Refused are rows that are not ``valid``, whose ``b`` the
    authority does not know or knows for another ``c``, whose ``a`` or ``c`` the static
    crosswalk gives to another, and which repeat an id of one accepted before."""
    known = authority.select(b, F.col(c).alias("__c"))
    by_a = static.filter(F.col(a).isNotNull()).select(a, F.col(c).alias("__a_c"), F.col(season).alias("__a_season"), F.lit(True).alias("__a_there"))
    by_c = static.select(c, F.col(a).alias("__c_a"), F.col(season).alias("__c_season"))
    met = overlay.withColumn("__valid", F.coalesce(valid, F.lit(False))).join(known, b, "left").join(by_a, a, "left").join(by_c, c, "left")
    fixed = (
        F.when(~F.col("__valid"), "invalid_overlay_row").when(F.col("__c").isNull(), f"unknown_{b}").when(F.col("__c") != F.col(c), f"{b}_{c}_conflict")
        .when(F.col("__a_c") != F.col(c), f"static_{a}_conflict").when(F.col("__c_a") != F.col(a), f"static_{c}_conflict")
    )
    met = met.withColumn("__fixed", fixed)
    judged = first_accepted(met.filter("__fixed is null").select(order, a, b, c), order, [a, b, c]).select(order, "duplicate_of")
    out = met.join(judged, order, "left").withColumn("reason", F.coalesce("__fixed", F.concat(F.lit("duplicate_"), "duplicate_of")))
    kept = F.when(F.coalesce("__a_there", F.lit(False)), F.coalesce("__a_season", season)).otherwise(F.coalesce("__c_season", season))
    return out.withColumn("crosswalk_season", F.when(F.col("reason").isNull(), kept)).select(*overlay.columns, "reason", "crosswalk_season")


def build_crosswalk(register: DataFrame, links: DataFrame, seasons: DataFrame, person: str, target: str, native: str, first: str, last: str, season: str) -> DataFrame:
    """The register's exact ids with the span of their seasons and its evidence, and what
    contradicts: each row has ``violations``, empty if none.

    ``links`` gives a ``native`` id for a ``person`` where the register may have none;
    ``seasons`` (``native``, ``season``) is the better evidence of the span, which must
    begin where the register's does and not end before it. Rows without a target, and
    those with neither a native id nor a span, are no crosswalk and left out."""
    linked = register.join(links.select(person, F.col(native).alias("__linked")), person, "left")
    both = linked.withColumn("__native", F.coalesce(native, "__linked"))
    span = seasons.groupBy(F.col(native).alias("__native")).agg(F.min(season).alias("__first"), F.max(season).alias("__last"))
    rows = both.filter(F.col(target).isNotNull() & (F.col("__native").isNotNull() | F.col(first).isNotNull())).join(span, "__native", "left")
    again = lambda c: F.col(c).isNotNull() & (F.count("*").over(Window.partitionBy(c)) > 1)
    found = [
        (F.col(native) != F.col("__linked"), "link_conflict"), (F.col(first).isNull() != F.col(last).isNull(), "incomplete_span"), (F.col(first) > F.col(last), "reversed_span"),
        (again(target), f"duplicate_{target}"), (again("__native"), f"duplicate_{native}"), (F.col(first) != F.col("__first"), "debut_conflict"), (F.col("__last") < F.col(last), "span_ends_before_register"),
    ]
    violations = F.array_join(F.array_compact(F.array(*[F.when(when, name) for when, name in found])), ",")
    evidence = F.when(F.col("__first").isNotNull(), "seasons").when(F.col(first).isNotNull(), "register")
    return rows.select(target, F.col("__native").alias(native), F.coalesce("__first", first).alias("first_season"), F.coalesce("__last", last).alias("last_season"), evidence.alias("evidence"), violations.alias("violations"))


def latest_permission(rows: DataFrame, permissions: DataFrame, on: list[str], at: str, begin: str, end: str, version: str, keys: list[str]) -> DataFrame:
    """For each row the permission of the highest version that holds at its time."""
    return first_by(valid_at(rows, permissions, on, at, begin, end), keys, [F.col(version).desc_nulls_last(), F.col(begin).desc_nulls_last()])


def exact_name_join(left: DataFrame, right: DataFrame, name: str, born: str, columns: list[str]) -> DataFrame:
    """Joined on normalised name and birth date, where the right side has the pair once."""
    r = right.select(person_name(F.col(name)).alias("__name"), F.col(born).alias("__born"), *columns).filter("__born is not null and __name <> ''")
    once = r.withColumn("__n", F.count("*").over(Window.partitionBy("__name", "__born"))).filter("__n = 1").drop("__n")
    keyed = left.withColumn("__own", person_name(F.col(name)))
    return keyed.join(once, (F.col("__own") == F.col("__name")) & (F.col(born) == F.col("__born")), "left").drop("__own", "__name", "__born")


def attach_outcomes(predictions: DataFrame, labels: DataFrame, keys: list[str], horizon: str, scored: str, horizons: tuple[int, ...]) -> DataFrame:
    """Predictions with ``outcome`` and ``outcome_observed``: the label of their horizon where
    the outcome is to be scored, null and 0 elsewhere; ``violation`` names rows whose
    label is missing, not unique, not observed or not binary though it is to be scored."""
    once = labels.groupBy(*keys).agg(F.count("*").alias("__rows"), *[F.max(f"{c}_{h}m").alias(f"{c}_{h}m") for h in horizons for c in ("observed", "event")])
    met = predictions.join(once, keys, "left")
    pick = lambda c: F.coalesce(*[F.when(F.col(horizon) == h, F.col(f"{c}_{h}m")) for h in horizons])
    wanted = F.coalesce(F.col(scored), F.lit(False))
    bad = F.when(F.col("__rows").isNull(), "no_label").when(F.col("__rows") > 1, "label_not_unique").when(wanted & ~F.coalesce(pick("observed"), F.lit(False)), "not_mature").when(wanted & pick("event").isNull(), "not_binary")
    ready = wanted & bad.isNull()
    return met.select(*predictions.columns, F.when(ready, pick("event").cast("int")).alias("outcome"), ready.cast("int").alias("outcome_observed"), bad.alias("violation"))
