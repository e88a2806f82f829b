"""Priors, neighbours, backtests, splits by origin, and scenarios with calibrated tails."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwise.operators.aggregates import weighted_quantiles
from pitwise.operators.ranking import ranked
from pitwise.operators.sizes import broadcast_if_small
from pitwise.operators.split import SPLIT_ROWS, exact_quantiles, placed_values, running


def smoothed_priors(rows: DataFrame, levels: list[list[str]], event: str, weight: str | None = None, strength: float = 20.0) -> list[DataFrame]:
    """For each level its keys and ``rate``, all pulled towards the rate of all rows (and
    not to that of the level above); the last table is the rate of all."""
    w = F.col(weight) if weight else F.lit(1.0)
    whole = rows.agg((F.sum(w * F.col(event)) / F.sum(w)).alias("__all"))
    made = [rows.groupBy(*keys).agg(F.sum(w * F.col(event)).alias("__e"), F.sum(w).alias("__w")).join(F.broadcast(whole)).select(*keys, ((F.col("__e") + strength * F.col("__all")) / (F.col("__w") + strength)).alias("rate")) for keys in levels]
    return [*made, whole.select(F.col("__all").alias("rate"))]


def with_prior(rows: DataFrame, levels: list[list[str]], priors: list[DataFrame], name: str, clip: float = 1e-6) -> DataFrame:
    """The rate of the first level that has the row's keys, clipped."""
    out = rows
    for i, (keys, table) in enumerate(zip(levels, priors)):
        out = out.join(table.withColumnRenamed("rate", f"__{i}"), keys, "left")
    out = out.join(F.broadcast(priors[-1].withColumnRenamed("rate", "__all")))
    rate = F.coalesce(*[F.col(f"__{i}") for i in range(len(levels))], F.col("__all"))
    return out.withColumn(name, F.least(F.greatest(rate, F.lit(clip)), F.lit(1 - clip))).drop("__all", *[f"__{i}" for i in range(len(levels))])


def nearest_or_local(points: DataFrame, rows: DataFrame, on: list[str], at: str, value: str, order: str, width: float = 1.0, least: int = 20, most: int = 100, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``on, point`` and the rows that speak for it: those within ``width``, or where they
    are fewer than ``least`` the ``most`` nearest (the first by ``order`` of equally far).

    Both sides are brought into one order. What is within ``width`` meets by buckets of that
    width. A point with too little there takes its place among the rows (a running count),
    and meets only ``most`` rows above it and ``most`` below, by their numbers: two
    numberings, as of equal values the first by ``order`` lie nearest on either side. So a
    point meets a fixed number of rows whatever the size of its group."""
    asked = points.select(*on, F.col(at).alias("point"), F.col(at).cast("double").alias("__p")).distinct()
    bucket = lambda c: F.floor(F.col(c) / width)
    spread = asked.withColumn("__b", F.explode(F.sequence(bucket("__p") - 2, bucket("__p") + 2)))
    within = F.abs(F.col("__v") - F.col("__p")) <= width
    values = rows.filter(F.col(value).isNotNull()).groupBy(*on, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    counted = spread.join(values.withColumn("__b", bucket("__v")), [*on, "__b"]).filter(within).groupBy(*on, "point").agg(F.sum("__n").alias("__local"))
    placed = asked.join(counted, [*on, "point"], "left").withColumn("__enough", F.coalesce(F.col("__local"), F.lit(0)) >= least).drop("__local")
    keyed = rows.filter(F.col(value).isNotNull()).withColumn("__v", F.col(value).cast("double"))
    near = placed.filter("__enough").select(*on, "point", "__p", F.explode(F.sequence(bucket("__p") - 2, bucket("__p") + 2)).alias("__b"))
    local = near.join(keyed.withColumn("__b", bucket("__v")), [*on, "__b"]).filter(within).drop("__b", "__v", "__p")

    far = placed.filter("not __enough").select(*on, "point", "__p")
    both = values.select(*on, "__v", "__n").unionByName(far.select(*on, F.col("__p").alias("__v"), F.lit(0).cast("long").alias("__n")))
    before = placed_values(both, on, "__v", {"n": F.col("__n")}, split_rows).select(*on, F.col("__v").alias("__p"), (F.col("upto_n") - F.col("tied_n")).alias("__before"))
    far = far.join(before, [*on, "__p"]).withColumn("__g", F.explode(F.sequence(F.expr(f"(__before - {most}) div {most} - 1"), F.expr(f"(__before + {most}) div {most} + 1"))))

    def numbered(first: Column) -> DataFrame:
        return ranked(keyed, [F.col("__v").asc(), first], "__r", on).withColumn("__g", F.expr(f"__r div {most}"))

    above = far.join(numbered(F.col(order).asc_nulls_first()), [*on, "__g"]).filter((F.col("__v") >= F.col("__p")) & F.col("__r").between(F.col("__before") + 1, F.col("__before") + most))
    below = far.join(numbered(F.col(order).desc_nulls_last()), [*on, "__g"]).filter((F.col("__v") < F.col("__p")) & F.col("__r").between(F.col("__before") - most + 1, F.col("__before")))
    place = F.row_number().over(Window.partitionBy(*on, "point").orderBy(F.abs(F.col("__v") - F.col("__p")), order))  # of 2 most rows
    taken = above.unionByName(below).withColumn("__place", place).filter(F.col("__place") <= most).drop("__v", "__p", "__r", "__g", "__before", "__place")
    return local.unionByName(taken)


def bridge(points: DataFrame, rows: DataFrame, on: str, at: str, start: str, order: str, event: str, values: list[str], levels: tuple[float, ...], strength: float = 25.0) -> DataFrame:
    """For each group and starting age: the event rate of its neighbourhood, pulled to the
    group's, exact quantiles of the values, and how many speak for it."""
    parent = rows.groupBy(on).agg(F.avg(F.col(event).cast("double")).alias("__parent"))
    near = nearest_or_local(points, rows, [on], at, start, order)
    out = near.groupBy(on, "point").agg(F.sum(F.col(event).cast("double")).alias("__e"), F.count("*").alias("rows")).join(parent, on)
    for v in values:
        out = out.join(exact_quantiles(near, [on, "point"], v, levels, v), [on, "point"], "left")
    rate = (F.col("__e") + strength * F.col("__parent")) / (F.col("rows") + strength)
    return out.select(on, "point", rate.alias("rate"), "rows", *[F.get(v, F.lit(i)).alias(f"{v}_q{round(level * 100):02d}") for v in values for i, level in enumerate(levels)])


def reliability_by_weight(rows: DataFrame, keys: list[str], p: str, y: str, weight: str, tie: str, bins: int = 10, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``bin, n, weight, mean_p, mean_y`` in bins of equal weight along the score."""
    t = running(rows.withColumn("__o", F.struct(p, tie)), keys, "__o", {"w": F.col(weight)}, split_rows)
    bin_ = F.least(F.floor(F.col("upto_w") * bins / F.col("all_w") + 1e-12), F.lit(bins - 1)).cast("int")
    mean = lambda c: F.sum(F.col(weight) * F.col(c)) / F.sum(weight)
    return t.withColumn("bin", bin_).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.sum(weight).alias("weight"), mean(p).alias("mean_p"), mean(y).alias("mean_y"))


def reliability_by_quantile(rows: DataFrame, keys: list[str], p: str, y: str, bins: int = 10, few: int = 10, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``bin, n, mean_p, mean_y`` between the score's quantiles (right-closed), or a bin for
    each score where there are no more than ``few`` distinct ones."""
    edges = exact_quantiles(rows, keys, p, tuple(i / bins for i in range(bins + 1)), "__edges", split_rows).withColumn("__edges", F.array_distinct("__edges"))
    scores = rows.filter(F.col(p).isNotNull()).select(*keys, p).distinct()
    counts = scores.groupBy(*keys).agg(F.count("*").alias("__distinct"))
    listed = scores.join(counts.filter(F.col("__distinct") <= few), keys).groupBy(*keys).agg(F.array_sort(F.collect_set(F.round(p, 12))).alias("__scores"))  # few a key
    inner = F.slice("__edges", F.lit(2), F.greatest(F.size("__edges") - 2, F.lit(0)))
    met = rows.join(edges, keys).join(counts, keys).join(listed, keys, "left")
    bin_ = F.when(F.col("__distinct") <= few, F.size(F.filter("__scores", lambda e: e < F.round(p, 12)))).otherwise(F.size(F.filter(inner, lambda e: e < F.col(p))))
    return met.withColumn("bin", bin_).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))


def top_by_weight(rows: DataFrame, keys: list[str], p: str, y: str, weight: str, tie: str, share: float, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``rows, rate, lift`` of the highest scores that make up ``share`` of the weight, the
    row which reaches it among them."""
    t = running(rows.withColumn("__o", F.struct((-F.col(p)).alias("p"), tie)), keys, "__o", {"w": F.col(weight)}, split_rows)
    before = F.col("upto_w") - F.col("tied_w")
    t = t.withColumn("__in", (before <= share * F.col("all_w") - 1e-12) | (F.abs(before) < 1e-12))
    rate = lambda when: F.sum(F.when(when, F.col(weight) * F.col(y))) / F.sum(F.when(when, F.col(weight)))
    return t.groupBy(*keys).agg(F.count_if("__in").alias("rows"), rate(F.col("__in")).alias("rate"), (rate(F.col("__in")) / F.nullif(rate(F.lit(True)), F.lit(0.0))).alias("lift"))


def top_by_count(rows: DataFrame, keys: list[str], p: str, y: str, tie: str, share: float) -> DataFrame:
    """``rows, rate, lift`` of exactly the ``ceil(share * n)`` highest scores."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    t = ranked(rows, [F.col(p).desc(), F.col(tie)], "__place", keys).join(n, keys)
    t = t.withColumn("__in", F.col("__place") <= F.greatest(F.lit(1), F.ceil(F.col("__n") * share)))
    return t.groupBy(*keys).agg(F.count_if("__in").alias("rows"), F.avg(F.when(F.col("__in"), F.col(y))).alias("rate"), (F.avg(F.when(F.col("__in"), F.col(y))) / F.nullif(F.avg(y), F.lit(0.0))).alias("lift"))


def origin_split(rows: DataFrame, season: str) -> DataFrame:
    """One row with the years of training, calibration and test: of 15 seasons or more the
    last five test and the six before them calibrate, of fewer the last fifth and the one
    before it. Null with fewer than nine."""
    years = rows.select(season).distinct().agg(F.array_sort(F.collect_list(season)).alias("y"))  # a value a season
    n = F.size("y")
    long = n >= 15
    calibrate = F.when(long, F.greatest(F.lit(1), n - 11)).otherwise(F.greatest(F.lit(1), F.floor(n * 0.6))).cast("int")
    t = years.withColumn("n", n).withColumn("c", calibrate)
    t = t.withColumn("t", F.when(F.col("n") >= 15, F.col("n") - 5).otherwise(F.greatest(F.col("c") + 1, F.floor(F.col("n") * 0.8))).cast("int"))
    at = lambda i: F.when(F.col("n") >= 9, F.get("y", i))
    return t.select((at(F.col("c")) - 1).alias("train_end"), at(F.col("c")).alias("calibration_start"), (at(F.col("t")) - 1).alias("calibration_end"), at(F.col("t")).alias("test_start"), at(F.col("n") - 1).alias("test_end"))


def rolling_origins(rows: DataFrame, season: str, entity: str, seasons: list[int]) -> DataFrame:
    """Every row once for each fold it takes part in: ``fold`` is a season, its own rows are
    ``test`` and earlier ones ``train``. ``cold`` marks test rows of entities that have
    no earlier row. The first season is no fold."""
    first = F.min(season).over(Window.partitionBy(entity))
    folds = F.array(*[F.lit(int(s)) for s in sorted(seasons)[1:]])
    out = rows.withColumn("__first", first).withColumn("fold", F.explode(F.filter(folds, lambda f: f >= F.col(season))))
    test = F.col("fold") == F.col(season)
    return out.withColumn("part", F.when(test, "test").otherwise("train")).withColumn("cold", F.when(test, F.col("__first") == F.col(season))).drop("__first")


def rolling_backtest(rows: DataFrame, season: str, entity: str, event: str, levels: list[list[str]], seasons: list[int], strength: float = 20.0, least: int = 100) -> DataFrame:
    """``fold, train_rows, test_rows, cold, base_rate, brier, base_brier, skill``: smoothed
    priors fitted before each season and judged on it. All folds are one plan."""
    folds = rolling_origins(rows, season, entity, seasons)
    train, test = folds.filter("part = 'train'"), folds.filter("part = 'test'")
    base = train.groupBy("fold").agg(F.avg(F.col(event)).alias("__all"), F.count("*").alias("train_rows"))
    scored = test
    for i, keys in enumerate(levels):
        level = train.groupBy("fold", *keys).agg(F.sum(event).alias("__e"), F.count("*").alias("__n")).join(F.broadcast(base), "fold")
        scored = scored.join(level.select("fold", *keys, ((F.col("__e") + strength * F.col("__all")) / (F.col("__n") + strength)).alias(f"__{i}")), ["fold", *keys], "left")
    scored = scored.join(F.broadcast(base), "fold")
    p = F.coalesce(*[F.col(f"__{i}") for i in range(len(levels))], F.col("__all"))
    y = F.col(event)
    out = scored.groupBy("fold", "train_rows", F.col("__all").alias("base_rate")).agg(F.count("*").alias("test_rows"), F.count_if("cold").alias("cold"), F.avg((p - y) * (p - y)).alias("brier"), F.avg((F.col("__all") - y) * (F.col("__all") - y)).alias("base_brier"))
    return out.filter(F.col("test_rows") >= least).withColumn("skill", 1 - F.col("brier") / F.nullif(F.col("base_brier"), F.lit(0.0)))


def champion(fits: dict[str, Callable[[DataFrame], Callable[[DataFrame], DataFrame]]], parts: dict[str, DataFrame], y: str, calibrate: Callable[[DataFrame, str], Callable[[DataFrame], DataFrame]]) -> tuple[str, DataFrame]:
    """Families are fitted on ``train``, calibrated on ``calibrate``, chosen by the Brier score
    on ``select`` (name on ties), and the chosen one is judged on ``test``. A fit gives a
    function that adds ``probability``; ``calibrate`` one that adds ``calibrated``."""
    made, scores = {}, {}
    for name, fit in fits.items():
        predict = fit(parts["train"])
        adjust = calibrate(predict(parts["calibrate"]), "probability")
        made[name] = lambda rows, predict=predict, adjust=adjust: adjust(predict(rows))
        scores[name] = made[name](parts["select"]).agg(F.avg((F.col("calibrated") - F.col(y)) ** 2)).first()[0]
    best = min(scores, key=lambda n: (scores[n], n))
    return best, made[best](parts["test"])


def decline_boundaries(curve: DataFrame, age: str, change: str, going_on: str, start: Column) -> DataFrame:
    """One row: the ages at which the prime, the decline and the late stage begin, and the
    thresholds of the last two. ``start`` is the prime's, a column of one value; the
    curve is a row an age. A stage begins no sooner than two years after the one before."""
    c = curve.withColumn("__start", start).filter(F.col(age) >= F.col("__start"))
    below = c.filter(F.col(change) < 0).agg(F.median(change).alias("a"))
    whole = c.agg(F.median(change).alias("b"), F.max("__start").alias("prime_start"), F.max(age).alias("__last"))
    t = whole.join(F.broadcast(below)).select("prime_start", "__last", F.coalesce("a", "b").alias("decline_change"))
    falls = c.join(F.broadcast(t)).filter((F.col(change) <= F.col("decline_change")) & (F.col(age) >= F.col("prime_start") + 2)).agg(F.min(age).alias("f"))
    t = t.join(F.broadcast(falls)).withColumn("__d", F.coalesce("f", F.least(F.col("__last"), F.col("prime_start") + 3))).drop("f")
    after = c.join(F.broadcast(t.select("__d"))).filter(F.col(age) >= F.col("__d"))
    rate = after.agg(F.median(going_on).alias("late_rate"))
    late = after.join(F.broadcast(rate)).filter((F.col(going_on) <= F.col("late_rate")) & (F.col(age) >= F.col("__d") + 2)).agg(F.min(age).alias("l"))
    t = t.join(F.broadcast(rate)).join(F.broadcast(late)).withColumn("decline_start", F.greatest("__d", F.col("prime_start") + 2))
    began = F.coalesce("l", F.least(F.col("__last"), F.col("__d") + 3))
    return t.withColumn("late_start", F.greatest(began, F.col("decline_start") + 2)).select("prime_start", "decline_start", "late_start", "decline_change", "late_rate")


def residual_bank(rows: DataFrame, first: str, second: str, weight: str | None, levels: list[tuple[list[str], int]], entity: str, draws: int, names: tuple[str, ...] | None = None) -> DataFrame:
    """``bank, draw, first, second``: for each group of each level with entities enough, pairs of
    residuals at ``draws`` even steps of their weight, ordered by the first, then the
    second. ``bank`` names level and keys (``0``, ``1/hitter``), or the level by ``names``. Without
    ``weight`` each entity of a bank weighs the same."""
    out = None
    for i, (keys, least) in enumerate(levels):
        name = F.concat_ws("/", F.lit(names[i] if names else str(i)), *[F.col(k).cast("string") for k in keys])
        named = rows.withColumn("bank", name)
        enough = named.groupBy("bank").agg(F.countDistinct(entity).alias("__n")).filter(F.col("__n") >= least).select("bank")
        part = named.join(enough, "bank")
        if weight is None:
            part = part.join(named.groupBy("bank", entity).agg((1.0 / F.count("*")).alias("__w")), ["bank", entity])
        else:
            part = part.withColumn("__w", F.col(weight))
        part = part.select("bank", F.col(first).alias("first"), F.col(second).alias("second"), "__w")
        out = part if out is None else out.unionByName(part)
    placed = placed_values(out.withColumn("__o", F.struct("first", "second")), ["bank"], "__o", {"w": F.col("__w")})
    share = lambda c: c / F.col("all_w")
    placed = placed.select("bank", "__o.first", "__o.second", share(F.col("upto_w")).alias("__upto"), share(F.col("upto_w") - F.col("tied_w")).alias("__from"))
    # the steps (d + 1/2) / draws that fall to the pair: above the share before it, up to its own
    lo = F.greatest(F.floor(F.col("__from") * draws - 0.5 + 1e-9) + 1, F.lit(0))
    hi = F.least(F.floor(F.col("__upto") * draws - 0.5 + 1e-9), F.lit(draws - 1))
    return placed.withColumn("draw", F.explode(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>")))).select("bank", "draw", "first", "second")


def chosen_bank(rows: DataFrame, bank: DataFrame, levels: list[list[str]], name: str = "bank") -> DataFrame:
    """The most detailed bank that exists for the row's keys (the last level first)."""
    there = bank.select("bank").distinct()
    out = rows
    for i, keys in enumerate(levels):
        key = F.concat_ws("/", F.lit(str(i)), *[F.col(k).cast("string") for k in keys])
        out = out.withColumn(f"__k{i}", key).join(broadcast_if_small(there.select(F.col("bank").alias(f"__b{i}"))), F.col(f"__k{i}") == F.col(f"__b{i}"), "left")
    picked = F.coalesce(*[F.col(f"__b{i}") for i in reversed(range(len(levels)))])
    return out.withColumn(name, picked).drop(*[f"__{c}{i}" for i in range(len(levels)) for c in "kb"])


def tilted_scenarios(scenarios: DataFrame, key: str, value: str, standard: str, probability: str, clip: float = 1e-6) -> DataFrame:
    """Scenarios with ``weight`` so that those at or above the standard have the given
    probability together. If all lie on one side, the nearest is moved across it by
    ``shift`` (kept in a column), so that both sides have one at least."""
    by = Window.partitionBy(key)
    margin = F.col(value) - F.col(standard)
    t = scenarios.withColumn("__m", margin).withColumn("__hit", F.count_if(margin >= 0).over(by)).withColumn("__n", F.count("*").over(by))
    none, all_ = F.col("__hit") == 0, F.col("__hit") == F.col("__n")
    nearest = F.row_number().over(by.orderBy(F.when(none, -F.col("__m")).otherwise(F.col("__m")), "draw")) == 1
    shift = F.when(nearest & none, -F.col("__m") + clip).when(nearest & all_, -F.col("__m") - clip).otherwise(F.lit(0.0))
    t = t.withColumn("shift", shift).withColumn(value, F.col(value) + F.col("shift")).withColumn("__elite", F.col(value) >= F.col(standard))
    p = F.least(F.greatest(F.col(probability), F.lit(clip)), F.lit(1 - clip))
    elite = F.count_if("__elite").over(by)
    weight = F.when(F.col("__elite"), p / elite).otherwise((1 - p) / (F.col("__n") - elite))
    return t.withColumn("weight", weight).drop("__m", "__hit", "__n", "__elite")


def scenario_quantiles(scenarios: DataFrame, key: str, value: str, levels: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    return weighted_quantiles(scenarios, [key], value, "weight", levels)


#: The support that a signal needs, the greatest age percentile, the least
#: workloads, probability and edge, and what makes it one of priority.
SIGNAL_PLAYERS, SIGNAL_ROWS, SIGNAL_EVENTS = 400, 100, 5
SIGNAL_AGE, SIGNAL_PROBABILITY, SIGNAL_EDGE = 33.0, 0.20, 0.10
SIGNAL_BATTING, SIGNAL_INNINGS = 75.0, 20.0
PRIORITY_EDGE, PRIORITY_AGE = 0.25, 25.0


def signal_gates(role: Column, age_percentile: Column, age_players: Column, workload: Column, support: list[tuple[Column, Column]], primary: tuple[Column, Column], long: tuple[Column, Column], players: int = SIGNAL_PLAYERS, rows: int = SIGNAL_ROWS, events: int = SIGNAL_EVENTS) -> tuple[Column, Column, Column]:
    """``eligibility`` by six gates. ``support`` has rows and events of the baseline at each horizon, ``primary`` and
    ``long`` the candidate's and the baseline's probability."""
    edge = F.round(primary[0] - primary[1], 8)
    held = age_players >= players
    for n, e in support:
        held = held & (n >= rows) & (e >= events)
    gates = {
        "supported_context": held, "young_for_role_and_level": age_percentile <= SIGNAL_AGE, "minimum_workload": workload >= F.when(role == "hitter", SIGNAL_BATTING).otherwise(SIGNAL_INNINGS), "minimum_probability": primary[0] >= SIGNAL_PROBABILITY,
        "primary_edge": edge >= SIGNAL_EDGE, "long_edge": F.round(long[0] - long[1], 8) > 0,
    }
    return eligibility(gates, (edge >= PRIORITY_EDGE) & (age_percentile <= PRIORITY_AGE))


def eligibility(gates: dict[str, Column], priority: Column) -> tuple[Column, Column, Column]:
    """Whether all gates hold (null does not), the tier, and the gates that fail."""
    held = {name: F.coalesce(ok, F.lit(False)) for name, ok in gates.items()}
    whole = F.lit(True)
    for ok in held.values():
        whole = whole & ok
    tier = F.when(whole & F.coalesce(priority, F.lit(False)), "priority").when(whole, "watch").otherwise("none")
    return whole, tier, F.array_join(F.array_compact(F.array(*[F.when(~ok, name) for name, ok in held.items()])), ",")

