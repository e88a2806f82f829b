"""Memberships, risk sets, outcomes and landmarks of entities over seasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwise.functions.numbers import age_years, safe_ratio
from pitwise.operators.aggregates import latest_non_null
from pitwise.operators.identity import unique_keys
from pitwise.operators.ordered import prefix_features
from pitwise.operators.sizes import broadcast_if_small
from pitwise.operators.temporal import as_of_join

SEPARATOR = " | "


def collapse_memberships(rows: DataFrame, keys: list[str], first: str, last: str, tie: str, sets: dict[str, str], latest: list[str] = (), known: list[str] = (), pooled: list[str] = (), stint: list[str] = ()) -> DataFrame:
    """One row for each key of all its stints.

    ``latest`` columns are those of the last stint in (``last``, ``first``, ``tie``), ``known``
    ones the last that is not null. ``sets`` names columns of sorted distinct values;
    a ``pooled`` column is the only value of its column or ``Pooled multi-`` and its name.
    ``first`` and ``last`` are the ends of all stints, ``stints`` counts them and
    ``stints_json`` lists the ``stint`` columns in order."""
    order = [F.col(last), F.col(first), F.col(tie)]
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    staged = rows.withColumn("__place", place)
    one = {c: F.size(F.collect_set(c)) == 1 for c in pooled}
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("__place", F.struct(*stint).alias("stint")))), lambda s: s["stint"]) if stint else None
    return staged.groupBy(*keys).agg(
        *[F.max_by(c, "__place").alias(c) for c in latest],
        *[latest_non_null(c, "__place").alias(c) for c in known],
        *[F.array_join(F.array_sort(F.collect_set(c)), SEPARATOR).alias(name) for name, c in sets.items()],
        *[F.when(one[c], F.min(c)).otherwise(F.lit(f"Pooled multi-{c}")).alias(f"{c}_pooled") for c in pooled],
        F.min(first).alias(first), F.max(last).alias(last), F.count("*").alias("stints"),
        *([F.to_json(ordered).alias("stints_json")] if stint else []),
    )


def membership_quality(rows: DataFrame, keys: list[str], **several: str) -> DataFrame:
    """One row: stints, keys, what the collapse takes away, and for each named column the
    keys that have more than one value of it."""
    each = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.countDistinct(c).alias(name) for name, c in several.items()])
    total = F.coalesce(F.sum("n"), F.lit(0))
    return each.agg(total.alias("stints"), F.count("*").alias("keys"), (total - F.count("*")).alias("collapsed"), *[F.count_if(F.col(name) > 1).alias(name) for name in several])


def risk_set(census: DataFrame, members: DataFrame, register: DataFrame, stats: DataFrame, census_key: str, as_of: str, source_id: str, entity_id: str, born: str, season: str, through: str, features: list[str]) -> DataFrame:
    """The members of each census with what was known of them at its date: the identity,
    if the register has the source's id once, the age, and the last season's statistics
    that end on the date or before it (by season, then by their end)."""
    known = unique_keys(register.filter(F.col(source_id).isNotNull()), source_id).select(source_id, entity_id)
    joined = members.join(broadcast_if_small(census), census_key).join(known, source_id, "left")
    aged = joined.withColumn("age", F.when(F.col(born) <= F.col(as_of), age_years(F.col(born), F.col(as_of)))).withColumn("identity_resolved", F.col(entity_id).isNotNull())
    last = stats.select(source_id, season, through, *features)
    out = as_of_join(aged, last, [source_id], as_of, through, [season, through, *features], [census_key, source_id], tie=season)
    return out.withColumn("has_prior_stats", F.col(through).isNotNull())


def risk_set_coverage(rows: DataFrame, census_key: str) -> DataFrame:
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    return rows.groupBy(census_key).agg(F.count("*").alias("players"), F.count_if("identity_resolved").alias("resolved"), rate("identity_resolved").alias("identity_rate"), rate("has_prior_stats").alias("prior_stats_rate"))


def boundary_dates(rows: DataFrame, columns: list[str], boundary: Column, sentinels: tuple[str, ...]) -> DataFrame:
    """Missing, blank or sentinel texts of dates as the boundary, with ``<column>_imputed``;
    other texts as the date they are, or null."""
    for c in columns:
        gone = F.col(c).isNull() | (F.trim(c) == "") | F.col(c).isin(*sentinels)
        rows = rows.withColumn(f"{c}_imputed", gone).withColumn(c, F.when(gone, boundary).otherwise(F.col(c).try_cast("date")))
    return rows


def career_outcomes(people: DataFrame, parts: dict[str, tuple[DataFrame, list[str]]], honours: DataFrame, key: str, season: str, final: str, debut: str, honour_year: str, cutoff_year: int) -> DataFrame:
    """Sums of each part (``name_column``), the last season, whether the career is over, and
    the state of the honour: given, or censored.

    A career is ``three_year_inactivity_proxy`` without seasons in the last three years,
    ``unobserved`` without any, else ``right_censored``; its final date counts if it is
    over and does not precede the last season."""
    out, lasts = people, []
    for name, (rows, columns) in parts.items():
        out = out.join(rows.groupBy(key).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(f"{name}_{c}") for c in columns], F.max(season).alias(f"__{name}")), key, "left")
        lasts.append(F.col(f"__{name}"))
    last = F.greatest(*lasts) if len(lasts) > 1 else lasts[0]
    out = out.withColumn("last_season", last).drop(*[f"__{n}" for n in parts]).join(honours.groupBy(key).agg(F.min(honour_year).alias("honour_year")), key, "left")
    given = F.coalesce(F.col("honour_year") <= cutoff_year, F.lit(False))
    inactive = F.coalesce(F.col("last_season") <= cutoff_year - 5, F.lit(False))
    over = F.coalesce(F.col("last_season") <= cutoff_year - 3, F.lit(False))
    state = F.when(given, "inducted").when(inactive, "inactive_not_inducted_censored").otherwise("active_or_recent_not_inducted_censored")
    resolution = F.when(F.col("last_season").isNull(), "unobserved").when(over, "three_year_inactivity_proxy").otherwise("right_censored")
    ended = F.when(over & (F.year(final) >= F.col("last_season")), F.col(final))
    out = out.withColumn("outcome_state", state).withColumn("inducted", F.when(given, True)).withColumn("resolution", resolution).withColumn("final_game", ended)
    return out.withColumn("career_days", F.datediff("final_game", debut))


def ages_from_seasons(rows: DataFrame, entity: str, season: str, age: str) -> DataFrame:
    """Missing ages as season plus the entity's median of age minus season."""
    offset = F.median(F.col(age) - F.col(season)).over(Window.partitionBy(entity))
    return rows.withColumn(age, F.coalesce(F.col(age).cast("double"), F.col(season) + offset))


def pooled_rates(rows: DataFrame, keys: list[str], counters: list[str], rates: dict[str, tuple[list[str], list[str]]], levels: str) -> DataFrame:
    """Counters summed over all levels (null counts as 0), rates of sums over sums (null over
    nothing), and whether more than one level was pooled."""
    summed = rows.groupBy(*keys).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in counters], (F.countDistinct(levels) > 1).alias("pooled"))
    add = lambda cs: sum((F.col(c) for c in cs[1:]), F.col(cs[0]))
    return summed.select("*", *[safe_ratio(add(top), add(bottom)).alias(name) for name, (top, bottom) in rates.items()])


def appearance_role(batting: Column, pitching_outs: Column, position_role: Column, least_batting: int = 25, least_outs: int = 30) -> Column:
    """Role of what was done: both workloads, one of them, else that of the position."""
    bats, pitches = F.coalesce(batting >= least_batting, F.lit(False)), F.coalesce(pitching_outs >= least_outs, F.lit(False))
    return F.when(bats & pitches, "two_way").when(pitches, "pitcher").when(bats, "hitter").otherwise(position_role)


#: Games, appearances and outs that are material, and tokens that are no fielding of a hitter.
MATERIAL_GAMES, MATERIAL_BATTING, MATERIAL_OUTS = 20, 60, 60
NO_FIELDING = ("P", "UNK")


def aggregate_roles(rows: DataFrame, keys: list[str], games: str, batting: str, outs: str, position: str, role: str) -> DataFrame:
    """``keys, role, basis`` of all of an entity's rows together: ``two_way`` needs both workloads
    and fielding at another position than the mound; fielding there makes a ``hitter``;
    outs or the position a ``pitcher``; mere batting a ``hitter``; else the sources' role, if they agree.
    Both are null without any of these."""
    tokens = F.filter(F.transform(F.split(F.coalesce(F.col(position), F.lit("")), "/"), lambda t: F.upper(F.trim(t))), lambda t: t != "")
    told = F.lower(F.trim(F.col(role)))
    total = lambda c: F.sum(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)))
    met = rows.groupBy(*keys).agg(
        total(games).alias("__g"), total(batting).alias("__b"), total(outs).alias("__o"), F.max(F.exists(tokens, lambda t: ~t.isin(*NO_FIELDING))).alias("__fields"), F.max(F.array_contains(tokens, "P")).alias("__pitches"),
        F.min(F.when(told != "", told)).alias("__low"), F.max(F.when(told != "", told)).alias("__high"),
    )
    material = (F.col("__g") >= MATERIAL_GAMES) & (F.col("__b") >= MATERIAL_BATTING) & (F.col("__o") >= MATERIAL_OUTS)
    agreed = F.when((F.col("__low") == F.col("__high")) & F.col("__low").isin("hitter", "pitcher"), F.col("__low"))
    cases = [
        (material & F.col("__fields"), F.lit("two_way"), F.lit("material_batting_and_pitching_with_position_evidence")), (F.col("__fields"), F.lit("hitter"), F.lit("position_player_with_incidental_or_no_pitching")),
        ((F.col("__o") > 0) | F.col("__pitches"), F.lit("pitcher"), F.lit("pitcher_with_incidental_or_no_batting")), (F.col("__b") > 0, F.lit("hitter"), F.lit("batting_opportunity_without_position_evidence")),
        (agreed.isNotNull(), agreed, F.concat(F.lit("unanimous_source_"), agreed, F.lit("_without_pa_ip_or_known_position"))),
    ]
    picked = F.coalesce(*[F.when(when, F.struct(r.alias("role"), basis.alias("basis"))) for when, r, basis in cases])
    return met.select(*keys, picked["role"].alias("role"), picked["basis"].alias("basis"))


#: Appearances and innings of a team's season that are material.
TEAM_BATTING, TEAM_INNINGS = 25, 10


def team_seasons(roster: DataFrame, batting: DataFrame, pitching: DataFrame, fielding: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key that any of four tables has: the best row of each (the first by
    ``order`` of equals), what they say together, and the batting, pitching and fielding columns under
    prefixes. Tables have ``keys``, ``order``, ``name`` and: the roster ``born, bats, throws, first, last``; batting ``PA``; pitching ``IP``; fielding
    ``innings`` and ``position``; and more columns each.

    The tables are laid under each other and grouped once, so it is one exchange instead
    of three full joins, and a key's rows are combined before it."""
    parts = {"roster": (roster, "last"), "batting": (batting, "PA"), "pitching": (pitching, "IP"), "fielding": (fielding, "innings")}
    stacked = None
    for kind, (rows, _) in parts.items():
        own = rows.filter(" and ".join(f"`{k}` is not null" for k in keys)).select(*keys, F.struct(*rows.columns).alias(kind))
        stacked = own if stacked is None else stacked.unionByName(own, allowMissingColumns=True)
    best = {k: F.max_by(k, F.when(F.col(k).isNotNull(), F.struct(F.coalesce(F.col(f"{k}.{largest}").try_cast("double"), F.lit(0.0)).alias("v"), (-F.col(f"{k}.{order}")).alias("o")))) for k, (_, largest) in parts.items()}
    seen = F.nullif(F.col("roster.first"), F.lit("")), F.nullif(F.col("roster.last"), F.lit(""))
    t = stacked.groupBy(*keys).agg(*[c.alias(k) for k, c in best.items()], F.min(seen[0]).alias("first_observed"), F.max(seen[1]).alias("last_observed"))
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    pa, ip = number("batting.PA"), number("pitching.IP")
    position = F.coalesce(F.col("fielding.position"), F.when(ip > 0, "P").otherwise("UNK"))
    role = F.when((pa >= TEAM_BATTING) & (ip >= TEAM_INNINGS), F.struct(F.lit("two_way").alias("role"), F.lit("material_batting_and_pitching_opportunity").alias("basis")))
    role = role.when((ip > 0) | (position == "P"), F.struct(F.lit("pitcher").alias("role"), F.lit("pitching_or_primary_position_evidence").alias("basis")))
    role = role.when(F.col("batting").isNull() & F.col("fielding").isNull(), F.struct(F.lit("hitter").alias("role"), F.lit("default_hitter_no_stat_evidence").alias("basis")))
    role = role.otherwise(F.struct(F.lit("hitter").alias("role"), F.lit("batting_or_non_pitcher_evidence").alias("basis")))
    t = t.withColumn("__role", role)
    name = F.coalesce(*[F.when(F.col(k).isNotNull(), F.coalesce(F.col(f"{k}.name"), F.lit(""))) for k in parts])
    more = [F.col(f"{k}.`{c}`").alias(f"{k}_{c}") for k in ("batting", "pitching", "fielding") for c in parts[k][0].columns if c not in (*keys, order, "name")]
    return t.select(*keys, F.nullif(name, F.lit("")).alias("name"), F.col("__role.role").alias("role"), F.col("__role.basis").alias("role_inference"), position.alias("position"), "roster.born", "roster.bats", "roster.throws", "first_observed", "last_observed", *more)


def landmark_panel(seasons: DataFrame, entity: str, season: str, value: str, side_a: str, side_b: str, standards: DataFrame, role: str, standard: str, peak: int = 7) -> DataFrame:
    """Every season as a landmark with what was known then: the prefix features, the role
    by the greater workload so far (``side_a`` wins ties), the career-and-peak mean
    against the role's standard, else the general one (null role)."""
    upto = Window.partitionBy(entity).orderBy(season).rowsBetween(Window.unboundedPreceding, 0)
    p = prefix_features(seasons, entity, season, value, peak=peak)
    a, b = (F.sum(F.coalesce(c, F.lit(0.0))).over(upto) for c in (side_a, side_b))
    p = p.withColumn(role, F.when(a >= b, "a").otherwise("b")).withColumn("blend", (F.col("total_so_far") + F.col("peak_so_far")) / 2)
    own, general = standards.filter(F.col(role).isNotNull()), standards.filter(F.col(role).isNull()).select(F.col(standard).alias("__general"))
    p = p.join(broadcast_if_small(own), role, "left").join(F.broadcast(general)).withColumn("fallback", F.col(standard).isNull()).withColumn(standard, F.coalesce(standard, "__general")).drop("__general")
    return p.withColumn("margin", F.col("blend") - F.col(standard))


def arc_points(seasons: DataFrame, entity: str, season: str, age: str, value: str, projections: DataFrame, quantiles: list[str], terminal_age: float = 37.0) -> DataFrame:
    """Cumulative points, every quantile being what was reached, and one terminal row for
    each entity with projected quantiles: at ``terminal_age``, or two to ten years on."""
    upto = Window.partitionBy(entity).orderBy(season).rowsBetween(Window.unboundedPreceding, 0)
    actual = F.round(F.sum(F.coalesce(value, F.lit(0.0))).over(upto), 3)
    points = seasons.withColumn("actual", actual).filter(F.col(age).isNotNull()).select(entity, F.round(F.col(age).cast("double"), 2).alias("age"), F.col(season).cast("int").alias("season"), *[F.col("actual").alias(q) for q in quantiles], "actual")
    now = seasons.groupBy(entity).agg(F.max(age).cast("double").alias("__age"))
    end = F.least(F.col("__age") + 10, F.greatest(F.col("__age") + 2, F.lit(terminal_age)))
    last = projections.join(now.filter("__age is not null"), entity).select(entity, F.round(end, 2).alias("age"), F.lit(None).cast("int").alias("season"), *[F.round(q, 3).alias(q) for q in quantiles], F.lit(None).cast("double").alias("actual"))
    return points.unionByName(last)


def expected_event_age(age: Column, probabilities: Column, months: tuple[int, ...] = (6, 18, 30, 42, 54), none: float = 60.0) -> Column:
    """The age at which the event is to be expected, from cumulative probabilities: they
    are made to rise, their differences weigh the middles of the intervals."""
    rising = F.transform(F.sequence(F.lit(1), F.size(probabilities)), lambda i: F.array_max(F.slice(probabilities, F.lit(1), i)))
    mass = F.transform(rising, lambda p, i: p - F.coalesce(F.get(rising, i - 1), F.lit(0.0)))
    middle = F.array(*[F.lit(float(m)) for m in months])
    dot = F.aggregate(F.zip_with(mass, middle, lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
    last = F.element_at(rising, -1)
    expected = F.when(last <= 1e-9, F.lit(none)).otherwise(dot / last)
    return F.greatest(F.ceil(age), F.bround(age + expected / 12).cast("long"))
