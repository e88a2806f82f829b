"""Boards and censuses that are published from captures: gates, queues, coverage, orders."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwise.operators.ranking import ordering, ranked

#: The order in which memberships of these statuses come first.
STATUS_ORDER = ("rehab", "active", "development", "injured", "restricted", "inactive")
#: Statuses that count as inactive, and the levels from the highest.
INACTIVE = ("Administrative Leave", "Military Leave", "Not Yet Reported", "Reserve List (Minors)", "Suspended # days", "Temporary Inactive List")
LEVELS = ("AAA", "AA", "A+", "A", "Rk")


def status_group(description: Column) -> Column:
    """The group of a status text; patterns take any case."""
    return (
        F.when(description == "Active", "active").when(description == "Rehab Assignment", "rehab").when(description.ilike("injured%"), "injured")
        .when(description == "Development List", "development").when(description.ilike("%restricted%"), "restricted").when(description.isin(*INACTIVE), "inactive").otherwise("other")
    )


def level_ordinal(level: Column) -> Column:
    """The place of a level from the lowest, 1; 0 for one that is not known."""
    out = F.lit(0)
    for i, name in enumerate(reversed(LEVELS)):
        out = F.when(level == name, i + 1).otherwise(out)
    return F.coalesce(out, F.lit(0))


def census(members: DataFrame, entity: str, known_at: str, kind: str, status: str, level: str, team: str, organization: str, role: str, columns: list[str]) -> DataFrame:
    """One row for each entity: its representative membership (the latest known, affiliates
    before the parents' own lists, then by status, level and team), how many
    memberships, roles and organizations it has, and all of them as JSON in that order."""
    by_kind = F.when(F.col(kind) == "affiliate", 1).otherwise(2)
    by_status = F.lit(len(STATUS_ORDER) + 1)
    for i, name in enumerate(STATUS_ORDER):
        by_status = F.when(F.col(status) == name, i + 1).otherwise(by_status)
    place = [by_kind.alias("__a"), by_status.alias("__b"), (-level_ordinal(F.col(level))).alias("__c")]
    shown = [team, organization, level, status, kind]
    carried = [*shown, *(c for c in dict.fromkeys([role, *columns]) if c not in shown)]
    latest = (-F.unix_micros(F.col(known_at).cast("timestamp"))).alias("__at")
    # memberships are dealt out once, as they are, and all that is told of them is read from the one list
    dealt = members.select(entity, F.struct(*place, *carried, latest).alias("__m")).repartition(entity)
    listed = dealt.groupBy(entity).agg(F.array_sort(F.collect_list("__m")).alias("__list"))
    first = F.array_min(F.transform("__list", lambda m: F.struct(m["__at"].alias("at"), *[m[x].alias(x) for x in ("__a", "__b", "__c", team)], F.struct(*[m[x].alias(x) for x in columns]).alias("own"))))
    distinct = lambda c: F.size(F.array_distinct(F.array_compact(F.transform("__list", lambda m: m[c])))).cast("long")
    return listed.withColumn("__first", first["own"]).select(
        entity, *[F.col("__first")[c].alias(c) for c in columns],
        F.size("__list").cast("long").alias("memberships"), F.size(F.filter("__list", lambda m: m[kind] == "affiliate")).cast("long").alias("affiliate_memberships"), distinct(role).alias("roles"), distinct(organization).alias("organizations"),
        F.to_json(F.transform("__list", lambda m: F.struct(*[m[x].alias(x) for x in shown]))).alias("memberships_json"),
    )


def complete_captures(runs: DataFrame, capture: str, endpoint: str, at: str, updated: str, endpoints: tuple[str, ...], main: str) -> DataFrame:
    """The captures that have every endpoint, with their first and last time and when the
    main endpoint's source was updated."""
    some = runs.filter(F.col(endpoint).isin(*endpoints)).groupBy(capture)
    out = some.agg(F.min(at).alias("started_at"), F.max(at).alias("captured_at"), F.max(F.when(F.col(endpoint) == main, F.col(updated))).alias("source_updated_at"), F.countDistinct(endpoint).alias("endpoints"))
    return out.filter(F.col("endpoints") == len(endpoints))


def latest_capture(captures: DataFrame, capture: str) -> DataFrame:
    """The last complete capture by source, capture time and id: one row."""
    return captures.orderBy(F.col("source_updated_at").desc_nulls_last(), F.col("captured_at").desc(), F.col(capture).desc()).limit(1)


def attention_ranks(views: DataFrame, keys: list[str], count: str, ordinal: str, entity: str) -> DataFrame:
    """Ranks by views within each capture and endpoint; the order of the source decides ties."""
    return ranked(views, [F.col(count).desc(), F.col(ordinal), F.col(entity)], "attention_rank", keys)


def work_queue(snapshot: DataFrame, resolved: DataFrame, attempts: DataFrame, key: str, now: Column, order: list[Column]) -> DataFrame:
    """What is neither resolved nor put off: never tried, or retryable and due; with
    ``queue_place`` in the given order, those never tried first."""
    open_ = snapshot.join(resolved.select(key), key, "left_anti").join(attempts, key, "left")
    due = F.col("status").isNull() | ((F.col("status") == "retryable") & (F.col("next_attempt_at") <= now))
    return open_.filter(F.coalesce(due, F.lit(False))).orderBy(F.col("last_attempted_at").asc_nulls_first(), *order)


def coverage_summary(rows: DataFrame, entity: str, parts: dict[str, Column]) -> DataFrame:
    """One row: distinct entities, those of each part, and the part's rate to four decimals
    (null over nothing)."""
    n = F.countDistinct(entity)
    some = {name: F.countDistinct(F.when(F.coalesce(ok, F.lit(False)), F.col(entity))) for name, ok in parts.items()}
    return rows.agg(n.alias("entities"), *[c.alias(name) for name, c in some.items()], *[F.round(c / F.nullif(n, F.lit(0)), 4).alias(f"{name}_rate") for name, c in some.items()])


def outside_filter(universe: DataFrame, visible: DataFrame, key: str, matches: Column, order: list[Column], most: int = 5) -> DataFrame:
    """The first few matches of a search that the filters hide."""
    return universe.filter(matches).join(visible.select(key), key, "left_anti").orderBy(*order).limit(most)


def rank_universe(rows: DataFrame, cohort: str, rank: str) -> DataFrame:
    """``universe``, the greatest rank of the cohort, and the percentile of each rank in it."""
    size = F.max(rank).over(Window.partitionBy(cohort))
    place = F.when(size > 1, 100.0 * (size - F.col(rank)) / (size - 1)).otherwise(100.0)
    return rows.withColumn("universe", size).withColumn("percentile", place)


#: The names of the board's orders. Columns and ways, before the id that ends every order.
BOARD_ORDERS = {
    "prospectScore": (("prospect_rank", "asc"), ("career_index", "desc")),
    "careerIndex": (("career_index", "desc"), ("outcome_rank", "asc")),
    "stageStanding": (("stage_percentile", "desc"), ("career_index", "desc")),
    "alphaOpportunity": (("alpha_rank", "asc"), ("stage_percentile", "desc")),
    "hofProbability": (("hof_probability", "desc"),),
    "nearTermImpact": (("near_term", "desc"), ("hof_probability", "desc")),
    "finalWar": (("final_war", "desc"),),
    "arrival36": (("alpha_rank", "asc"), ("arrival36", "desc")),
    "dynastyScore": (("dynasty_value", "desc"), ("dynasty_percentile", "desc")),
    "dynastyRiser": (("dynasty_momentum", "desc"), ("dynasty_percentile", "desc")),
    "oracleAhead": (("gap", "desc"),),
    "crowdAhead": (("gap", "asc"),),
    "age": (("age", "asc"),),
    "name": (("name", "asc"),),
}
#: Newest year first, what can be acted on, the surest, then by name.
MARKET_ORDER = (("release_year", "desc"), ("actionable", "desc"), ("confidence", "desc"), ("release", "asc"))


def board_order(name: str, key: str, route: str | None = None, orders: dict = BOARD_ORDERS) -> list[Column]:
    """The sort of a named order: nulls last either way, the id and route end it."""
    if name not in orders:
        raise ValueError(f"no order {name}")
    return ordering(*orders[name], (key, "asc"), *([(route, "asc")] if route else []))


def page_of(rows: DataFrame, order: list[Column], number: int, size: int) -> tuple[DataFrame, int]:
    """One page, and the number of pages (one at least)."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size), max(1, ceil(rows.count() / size))


@dataclass(frozen=True)
class BoardQuery:
    """The parameters of a board request, refused if they are not as they must be."""

    q: str = ""
    ids: tuple[str, ...] = ()
    sort: str = "prospectScore"
    page: int = 1
    limit: int = 50
    level: str = "All"

    MAX_IDS = 50

    @classmethod
    def parse(cls, parameters: list[tuple[str, str]]) -> BoardQuery:
        names = [n for n, _ in parameters]
        unknown, again = set(names) - set(cls.__dataclass_fields__), {n for n in names if names.count(n) > 1}
        if unknown or again:
            raise ValueError(f"not known {sorted(unknown)}, repeated {sorted(again)}")
        given = dict(parameters)
        for name, text in given.items():
            if any(ord(c) < 32 or ord(c) == 127 for c in text):
                raise ValueError(f"{name} has control characters")
        ids = tuple(x for x in given.get("ids", "").split(",") if x)
        if len(ids) > cls.MAX_IDS or len(set(ids)) < len(ids):
            raise ValueError("too many ids, or one twice")
        if given.get("sort", cls.sort) not in BOARD_ORDERS or given.get("level", cls.level) not in ("All", *LEVELS):
            raise ValueError("sort or level is not one of those there are")
        whole = {}
        for name, low, high in (("page", 1, 10_000), ("limit", 1, 200)):
            text = given.get(name, str(getattr(cls, name)))
            if not text.isascii() or not text.isdigit() or not low <= int(text) <= high:
                raise ValueError(f"{name} is no integer from {low} to {high}")
            whole[name] = int(text)
        return cls(given.get("q", "").strip(), ids, given.get("sort", cls.sort), whole["page"], whole["limit"], given.get("level", cls.level))

