"""Point-in-time panels: every season of an entity as a landmark, with the role, position,
standard and value that were to be known then, and targets that are masked until the
career is over.

All of a landmark is windows over one partitioning, the entity, in season order; the
only other exchange is that of the input's seasons to it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwise.functions.roster import HITTER_POSITIONS, position_code
from pitwise.functions.safe import first_present
from pitwise.operators.careers import ages_from_seasons
from pitwise.operators.sizes import broadcast_if_small

#: Full workloads of a season, the least of both sides for a balanced season,
#: the share of the greater workload that the lesser must reach, the share of starts that
#: makes a starter, and the seasons of a peak.
FULL_BATTING, FULL_OUTS = 600.0, 540.0
LEAST_BATTING, LEAST_OUTS, BALANCE = 60.0, 60.0, 0.25
STARTER_SHARE = 0.4
PEAK = 7


@dataclass(frozen=True)
class Seasons:
    """Names of the input's columns: one row an entity and season."""

    entity: str = "entity"
    season: str = "season"
    state: str = "season_state"
    age: str = "age"
    position: str = "position"
    batting: str = "b_pa"
    outs: str = "p_ip_outs"
    games: str = "p_games"
    starts: str = "p_games_started"
    batting_value: str = "b_war"
    pitching_value: str = "p_war"
    total_value: str = "total_war"


def balanced_season(batting: Column, outs: Column) -> Column:
    """Whether both workloads of a season are real ones and near enough to each other."""
    a, b = batting / FULL_BATTING, outs / FULL_OUTS
    return (batting >= LEAST_BATTING) & (outs >= LEAST_OUTS) & (F.least(a, b) >= BALANCE * F.greatest(a, b))


def season_role(batting: Column, outs: Column, reported: Column) -> Column:
    """The role that a season's workloads show, else the reported one, else ``hitter``."""
    b, o = F.coalesce(batting, F.lit(0.0)), F.coalesce(outs, F.lit(0.0))
    shown = F.when(balanced_season(b, o), "two_way").when(o / FULL_OUTS > b / FULL_BATTING, "pitcher").otherwise("hitter")
    told = F.lower(F.trim(reported))
    return F.when((b > 0) | (o > 0), shown).otherwise(F.when(told.isin("hitter", "pitcher", "two_way"), told).otherwise(shown))


#: Names under which sources have the columns, the first that is there counting.
ALIASES = {
    "entity": ("bbref_id", "player_id", "bbrefId", "source_player_id", "playerID"), "season": ("season", "year", "year_id", "yearID"), "season_state": ("season_state", "seasonState"), "age": ("age", "age_midseason", "ageMidseason"),
    "position": ("position", "pos", "primary_position"), "role": ("role", "player_type", "playerType", "source_role"), "b_pa": ("b_pa", "pa", "batting_pa"), "p_ip_outs": ("p_ip_outs", "pitching_outs", "ipouts"), "p_games": ("p_games", "p_g", "pitching_g"),
    "p_games_started": ("p_games_started", "p_gs", "pitching_gs"), "b_war": ("b_war", "batting_war", "war_bat"), "p_war": ("p_war", "pitching_war", "war_pitch"), "total_war": ("total_war", "war", "WAR"),
}
_TEXTS = {"entity": None, "season_state": "complete", "position": "", "role": ""}


def season_rows(rows: DataFrame) -> DataFrame:
    """A source's seasons under the names of ``Seasons``: columns by ``ALIASES``, numbers that cannot
    be read as null, a missing state as complete, and ``role`` by what the season's workloads show."""
    found = {name: first_present(rows.columns, *aliases) for name, aliases in ALIASES.items()}
    missing = [name for name in ("entity", "season") if found[name] is None]
    if missing:
        raise ValueError(f"no column for {missing}")

    def read(name: str) -> Column:
        if name == "entity":
            return F.col(found[name])
        if name in _TEXTS:
            return F.coalesce(F.trim(F.col(found[name]).cast("string")), F.lit(_TEXTS[name])) if found[name] else F.lit(_TEXTS[name])
        value = F.col(found[name]).try_cast("double") if found[name] else F.lit(None).cast("double")
        return value.cast("int") if name == "season" else value

    out = rows.select(*[read(name).alias(name) for name in ALIASES])
    return out.withColumn("season_state", F.lower("season_state")).withColumn("role", season_role(F.col("b_pa"), F.col("p_ip_outs"), F.col("role")))


def with_fallbacks(standards: DataFrame, position: str, value: str) -> DataFrame:
    """``standard_key, standard, standard_fallback``: the standards of positions, and medians
    of the hitters' and of the pitchers' under ``HITTER_FALLBACK`` and ``PITCHER_FALLBACK``."""
    exact = standards.select(F.col(position).alias("standard_key"), F.col(value).cast("double").alias("standard")).filter(F.col("standard_key").isin(*HITTER_POSITIONS, "P", "RP"))
    side = F.when(F.col("standard_key").isin("P", "RP"), "PITCHER_FALLBACK").otherwise("HITTER_FALLBACK")
    medians = exact.groupBy(side.alias("standard_key")).agg(F.median("standard").alias("standard"))
    return exact.withColumn("standard_fallback", F.lit(False)).unionByName(medians.withColumn("standard_fallback", F.lit(True)))


def prefix_mode(category: Column, weight: Column, at: Column, entity: str, season: str) -> Column:
    """The category of the greatest weight so far; of equal ones the latest, then the greatest
    name. Weights are positive, so a category's sum is greatest at its last row, and the
    mode is the greatest of (running sum of the row's category, place, category) so far."""
    own = Window.partitionBy(entity, category).orderBy(season).rowsBetween(Window.unboundedPreceding, 0)
    upto = Window.partitionBy(entity).orderBy(season).rowsBetween(Window.unboundedPreceding, 0)
    return F.max(F.struct(F.sum(weight).over(own).alias("w"), at.alias("at"), category.alias("category"))).over(upto)["category"]


def career_panel(seasons: DataFrame, standards: DataFrame, as_of: int, quiet: int = 3, active: DataFrame | None = None, names: Seasons = Seasons(), over: bool = False) -> DataFrame:
    """A row for each complete season, with what was known at its end.

    ``role`` is ``two_way`` once any season so far was balanced, else that of the greater
    workload so far; ``position`` is ``TWO_WAY``, ``P`` or ``RP`` by the share of starts so
    far, or the mode of positions weighted by batting. ``standard`` is that of the position,
    else the side's median (``standard_fallback``, ``standard_warning``). Sums, peaks and means are
    of the value that follows the role: batting, pitching or total. A career is ``resolved`` when its last
    complete season lies ``quiet`` seasons before ``as_of``, no partial season follows and the
    entity is not in ``active`` (a table of entities); targets of others are null. ``standards`` is what ``with_fallbacks`` gives.
    With ``over`` only resolved careers are gone through and returned."""
    if quiet < 2:
        raise ValueError("a career needs two quiet seasons at least to be over")
    n, c = names, F.col
    key, order = n.entity, n.season
    whole = Window.partitionBy(key)
    upto = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbers = (n.batting, n.outs, n.games, n.starts, n.batting_value, n.pitching_value)
    t = seasons.withColumns({x: F.coalesce(c(x).cast("double"), F.lit(0.0)) for x in numbers})
    t = t.withColumn(n.total_value, F.coalesce(c(n.total_value).cast("double"), c(n.batting_value) + c(n.pitching_value)))
    t = ages_from_seasons(t, key, order, n.age).withColumn("__position", position_code(c(n.position)))
    complete = c(n.state) == "complete"
    end = F.max(F.when(complete, c(order))).over(whole)
    later = F.coalesce(F.max(F.when(c(n.state) == "in_season", c(order))).over(whole) >= end, F.lit(False))
    t = t.withColumn("career_end", end).withColumn("__later", later).filter(complete)
    if active is not None:
        now = active.select(c(key).alias("__active")).distinct()
        t = t.join(broadcast_if_small(now), c(key) == c("__active"), "left")
    resolved = (c("career_end") <= as_of - quiet) & ~c("__later")
    t = t.withColumn("resolved", resolved & c("__active").isNull() if active is not None else resolved)
    if over:  # as all windows are of one career, the others' need not be worked out
        t = t.filter("resolved")

    sums = {"career_batting": n.batting, "career_outs": n.outs, "career_games": n.games, "career_starts": n.starts, "career_batting_value": n.batting_value, "career_pitching_value": n.pitching_value}
    t = t.withColumns({name: F.sum(x).over(upto) for name, x in sums.items()}).withColumn("season_number", F.count("*").over(upto).cast("int"))
    t = t.withColumn("__two_way", F.max(balanced_season(c(n.batting), c(n.outs))).over(upto))
    t = t.withColumn("__mode", prefix_mode(c("__position"), F.greatest(c(n.batting), F.lit(1.0)), c("season_number"), key, order))
    pitches = (c("career_outs") > 0) & (c("career_outs") / FULL_OUTS >= c("career_batting") / FULL_BATTING)
    role = F.when(c("__two_way"), "two_way").when(pitches, "pitcher").otherwise("hitter")
    starter = (c("career_games") <= 0) | (c("career_starts") / c("career_games") >= STARTER_SHARE)
    t = t.withColumn("role", role)
    position = F.when(c("role") == "two_way", "TWO_WAY").when(c("role") == "pitcher", F.when(starter, "P").otherwise("RP")).otherwise(c("__mode"))
    t = t.withColumn("position", position)

    exact = F.when((c("role") == "pitcher") | ((c("role") == "hitter") & (c("position") != "P") & (c("position") != "RP")), c("position"))
    side = F.when(c("role") == "hitter", "HITTER_FALLBACK").otherwise("PITCHER_FALLBACK")
    known = standards.select("standard_key", "standard")
    small = broadcast_if_small(known)
    t = t.withColumn("__exact", exact).join(small.select(c("standard_key").alias("__exact"), c("standard").alias("__own")), "__exact", "left")
    t = t.withColumn("standard_fallback", c("__own").isNull()).withColumn("standard_key", F.when(c("standard_fallback"), side).otherwise(c("__exact")))
    t = t.join(small.select("standard_key", c("standard").alias("__side")), "standard_key", "left").withColumn("standard", F.coalesce("__own", "__side"))
    told = F.when(c("role") == "two_way", "two_way").otherwise(F.lower("position"))
    t = t.withColumn("standard_warning", F.when(c("standard_fallback"), F.concat(F.lit("standard_fallback:"), told)))

    def by_role(batting: Column, pitching: Column, total: Column) -> Column:
        return F.when(c("role") == "hitter", batting).when(c("role") == "pitcher", pitching).otherwise(total)

    past = F.collect_list(F.struct(c(n.batting_value).alias("b"), c(n.pitching_value).alias("p"), c(n.total_value).alias("t"))).over(upto)  # a career's seasons
    t = t.withColumn("__past", past).withColumn("__values", F.transform("__past", lambda x: by_role(x["b"], x["p"], x["t"])))
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    last = F.slice("__values", F.greatest(F.size("__values") - 2, F.lit(1)), F.lit(3))
    t = t.withColumns({
        "season_value": F.element_at("__values", -1),
        "value_to_date": add(c("__values")),
        "peak_to_date": add(F.slice(F.sort_array("__values", asc=False), 1, PEAK)),
        "last_three": add(last) / F.size(last),
        "best_to_date": F.array_max("__values"),
        "positive_seasons": F.size(F.filter("__values", lambda x: x > 0)),
    })
    t = t.withColumn("blend_to_date", (c("value_to_date") + c("peak_to_date")) / 2).withColumn("per_season", c("value_to_date") / c("season_number"))
    t = t.withColumn("starter_share", c("career_starts") / F.greatest(c("career_games"), F.lit(1.0)))
    t = t.withColumn("debut", F.min(order).over(whole)).withColumn("years_since_debut", c(order) - c("debut"))
    had = lambda r: F.max(c("role") == r).over(upto)
    t = t.withColumn("broad_role_switch", had("hitter") & had("pitcher"))

    final = F.max_by(F.struct("role", "position", "standard_key", "standard", "standard_fallback", "value_to_date", "peak_to_date", "blend_to_date", "broad_role_switch"), order).over(whole)
    t = t.withColumn("__final", final).withColumn("__ever_two_way", F.max(c("role") == "two_way").over(whole))
    f = c("__final")
    reason = F.when(c("__ever_two_way"), "two_way_role_path").when(f["broad_role_switch"], "broad_role_switch").when(f["standard_fallback"], "synthetic_standard_fallback").otherwise("eligible")
    targets = {
        "final_value": f["value_to_date"], "final_peak": f["peak_to_date"], "final_blend": f["blend_to_date"], "reaches_standard": f["blend_to_date"] >= c("standard"), "reaches_final_standard": f["blend_to_date"] >= f["standard"],
        "target_role": f["role"], "target_position": f["position"], "target_standard_key": f["standard_key"], "target_standard": f["standard"], "target_fallback": f["standard_fallback"],
        "target_eligible": reason == "eligible", "target_reason": reason,
    }
    t = t.withColumns({name: F.when(c("resolved"), what) for name, what in targets.items()})
    return t.select(
        key, order, n.age, "season_number", "years_since_debut", "role", "position", "standard_key", "standard", "standard_fallback", "standard_warning", "broad_role_switch", "season_value", "value_to_date", "peak_to_date", "blend_to_date",
        "last_three", "best_to_date", "positive_seasons", "per_season", *sums, "starter_share", "debut", "career_end", "resolved", *targets,
    )


def scoring_rows(seasons: DataFrame, standards: DataFrame, as_of: int, current: DataFrame | None = None, names: Seasons = Seasons()) -> DataFrame:
    """The row by which each current entity is scored: its last landmark of complete seasons, or,
    with none, that of its partial ones taken as complete (``feature_partial``). ``current`` is a table of entities;
    without it they are those of the last partial season, or of the last season where none is partial.

    Two-way entities are scored by their batting on the hitters' track (``two_way_policy``): the
    sums, peak and means are of batting alone and the standard is the hitters' median, which is the policy and so no fallback."""
    n, c = names, F.col
    key, order = n.entity, n.season
    if current is None:
        partial = c(n.state) == "in_season"
        last = seasons.agg(F.max(F.when(partial, c(order))).alias("__p"), F.max(order).alias("__s"))  # one row
        met = seasons.join(F.broadcast(last)).filter((c(order) == F.coalesce("__p", "__s")) & (partial | c("__p").isNull()))
        current = met.select(key).distinct()
    mine = seasons.join(current.select(key).distinct(), key, "left_semi")
    latest = lambda p: p.join(p.groupBy(key).agg(F.max(order).alias(order)), [key, order], "left_semi")
    whole = latest(career_panel(mine, standards, as_of, names=names)).withColumn("feature_partial", F.lit(False))
    done = mine.filter(c(n.state) == "complete").select(key).distinct()
    fresh = mine.join(done, key, "left_anti").withColumn(n.state, F.lit("complete"))
    rows = whole.unionByName(latest(career_panel(fresh, standards, as_of, names=names)).withColumn("feature_partial", F.lit(True)))
    side = standards.filter("standard_key = 'HITTER_FALLBACK'").select(c("standard").alias("__hitters"))  # one row
    # what a two-way entity's batting came to, up to the landmark, partial seasons before it included
    past = mine.select(key, c(order).alias("__s"), F.coalesce(c(n.batting_value).cast("double"), F.lit(0.0)).alias("__v"))
    two = rows.filter("role = 'two_way'").select(key, order).join(past, key).filter(c("__s") <= c(order)).groupBy(key, order).agg(F.transform(F.array_sort(F.collect_list(F.struct("__s", "__v"))), lambda x: x["__v"]).alias("__b"))  # a career's seasons
    t = rows.join(two, [key, order], "left").join(broadcast_if_small(side))
    both = c("__b").isNotNull()
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    tail = F.slice("__b", F.greatest(F.size("__b") - 2, F.lit(1)), F.lit(3))
    total, peak = add(c("__b")), add(F.slice(F.sort_array("__b", asc=False), 1, PEAK))
    policy = {
        "role": F.lit("hitter"), "position": F.lit("DH"), "standard_key": F.lit("HITTER_FALLBACK"), "standard": c("__hitters"), "standard_fallback": F.lit(False), "standard_warning": F.lit(None).cast("string"), "broad_role_switch": F.lit(False),
        "season_value": F.element_at("__b", -1), "value_to_date": total, "peak_to_date": peak, "blend_to_date": (total + peak) / 2, "last_three": add(tail) / F.size(tail), "best_to_date": F.array_max("__b"),
        "positive_seasons": F.size(F.filter("__b", lambda x: x > 0)), "per_season": total / F.size("__b"),
    }
    t = t.withColumn("two_way_policy", both).withColumns({name: F.when(c("two_way_policy"), what).otherwise(c(name)) for name, what in policy.items()})
    kept = [key, order, n.age, "season_number", *policy, "feature_partial", "two_way_policy"]
    return t.select(*kept)


def exclusions(panel: DataFrame, entity: str) -> DataFrame:
    """``reason, entities, landmarks, supported_entities, supported_landmarks`` of resolved careers that are no targets: supported
    are landmarks of which it could not be known then (one role so far, with a standard of its own)."""
    could = (F.col("role") != "two_way") & ~F.col("broad_role_switch") & ~F.col("standard_fallback")
    out = panel.filter(F.col("resolved") & ~F.col("target_eligible"))
    return out.groupBy(F.col("target_reason").alias("reason")).agg(
        F.countDistinct(entity).alias("entities"), F.count("*").alias("landmarks"), F.countDistinct(F.when(could, F.col(entity))).alias("supported_entities"), F.count_if(could).alias("supported_landmarks")
    )
