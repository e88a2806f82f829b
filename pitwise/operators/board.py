"""The served board: one row an entity, facets, search and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitwise.functions.numbers import two_way


def canonical_entities(rows: DataFrame, identity: str, role: str, order: list[Column], columns: list[str]) -> DataFrame:
    """The best row of each identity, all its roles, and whether it has several."""
    best = F.max_by(F.struct(*columns), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    out = rows.groupBy(identity).agg(best.alias("__best"), F.array_sort(F.collect_set(role)).alias("roles"))
    return out.select(identity, *[F.col(f"__best.{c}").alias(c) for c in columns], F.array_join("roles", "|").alias("roles"), (F.size("roles") > 1).alias("several_roles"))


def canonical_two_way(rows: DataFrame, identity: str, role: str, batting: str, pitching: str, order: list[Column], columns: list[str]) -> DataFrame:
    """The best row of each identity with its role: ``Two-way`` if its rows have more than one
    and its greatest workloads pass the rule of two, else the best row's."""
    best = F.max_by(F.struct(role, *columns), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    out = rows.groupBy(identity).agg(best.alias("__best"), F.countDistinct(role).alias("__roles"), F.max(batting).alias(batting), F.max(pitching).alias(pitching))
    both = (F.col("__roles") > 1) & F.coalesce(two_way(F.col(batting), F.col(pitching)), F.lit(False))
    return out.select(identity, F.when(both, "Two-way").otherwise(F.col(f"__best.{role}")).alias(role), *[F.col(f"__best.{c}").alias(c) for c in columns], batting, pitching)


def labelled_facets(rows: DataFrame, facet: str, label: str, order: Column) -> DataFrame:
    """``facet, label, n``: the label is the first in ``order`` that is there."""
    first = F.min_by(label, F.when(F.coalesce(F.col(label), F.lit("")) != "", order))
    return rows.groupBy(facet).agg(F.coalesce(first, F.col(facet).cast("string")).alias("label"), F.count("*").alias("n"))


def facets(rows: DataFrame, chosen: dict[str, str | None]) -> DataFrame:
    """``facet, value, n``: the counts of each facet's values under the filters of all
    other facets, in one scan of the rows."""
    hit = {c: F.lit(True) if v is None else F.coalesce(F.col(c) == v, F.lit(False)) for c, v in chosen.items()}
    made = []
    for c in chosen:
        others = F.lit(True)
        for o, h in hit.items():
            if o != c:
                others = others & h
        made.append(F.when(others & F.col(c).isNotNull(), F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value"))))
    return rows.select(F.explode(F.array_compact(F.array(*made))).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def completeness(rows: DataFrame, by: list[str], rules: dict[str, Column]) -> DataFrame:
    """For each group a status and the reasons: the rules that do not hold."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(*by, F.when(F.size(failed) == 0, "ok").otherwise("degraded").alias("status"), F.array_join(failed, ",").alias("reasons"))


def document(by: list[str], rows: DataFrame, order: str, columns: list[str], name: str = "document") -> DataFrame:
    """The rows of each group, in order, as one JSON array."""
    items = F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order])))
    return rows.groupBy(*by).agg(F.to_json(items).alias(name))
