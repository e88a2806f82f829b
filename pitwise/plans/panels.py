"""Queries over point-in-time panels, scenarios and neighbours, with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitwise.functions import numbers
from pitwise.operators import careers, cohorts, metrics, panel, scenarios
from pitwise.operators.aggregates import entity_weight
from pitwise.operators.aggregates import mean_one_weights as scaled_weights
from pitwise.operators.evaluation import signal_gates
from pitwise.operators.ordered import next_calendar_sum
from pitwise.operators.sizes import broadcast_if_small
from pitwise.plans import ensembles, models
from pitwise.plans.catalog import SEASONS, query, seasons, table
from pitwise.sources.scratch import cut

#: A customer's years: orders that are filled are its batting, open ones its pitching.
_SEASONS = """s0 AS (SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS season, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN floor(o_totalprice / 1000) END), 0) AS b_pa, coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN floor(o_totalprice / 1000) END), 0) AS p_ip_outs,
 count(*) AS p_games, count(CASE WHEN o_orderpriority < '3' THEN 1 END) AS p_games_started, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) / 100000, 2) AS b_war, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END) / 100000, 2) AS p_war,
 min(o_orderkey) AS k FROM orders GROUP BY 1, 2),
s1 AS (SELECT *, CASE WHEN (entity + season) % 3 <> 0 THEN season - 1960.0 - entity % 20 + season % 2 END AS age0, CASE WHEN season = max(season) OVER () AND k % 4 = 0 THEN 'in_season' ELSE 'complete' END AS season_state, '*' || (k % 10) || '/H' AS code,
 CASE WHEN k % 10 > 1 THEN ['C', '1B', '2B', '3B', 'SS', 'LF', 'CF', 'RF'][CAST(k % 10 - 1 AS INTEGER)] WHEN k % 10 = 1 THEN 'P' ELSE 'DH' END AS pos FROM s0),
s2 AS (SELECT *, coalesce(age0, season + median(age0 - season) OVER (PARTITION BY entity)) AS age, max(CASE WHEN season_state = 'complete' THEN season END) OVER (PARTITION BY entity) AS career_end, max(CASE WHEN season_state <> 'complete' THEN season END) OVER (PARTITION BY entity) AS part FROM s1),
s AS (SELECT s2.*, career_end <= 2004 - 3 AND NOT coalesce(part >= career_end, false) AND c_mktsegment <> 'BUILDING' AS resolved FROM s2 JOIN customer ON c_custkey = entity WHERE season_state = 'complete')"""

#: Standards of the positions as shares of what a customer may come to.
_STANDARDS = "st AS (SELECT position, CAST(standard AS DOUBLE) AS standard FROM (VALUES ('C', 9.5), ('1B', 11.0), ('2B', 12.25), ('3B', 13.0), ('SS', 11.5), ('LF', 14.0), ('CF', 10.0), ('RF', 12.0), ('P', 10.5), ('RP', 8.0)) AS v(position, standard))"

_PANEL = f"""{_SEASONS}, {_STANDARDS}, fb AS (SELECT CASE WHEN position IN ('P', 'RP') THEN 'PITCHER_FALLBACK' ELSE 'HITTER_FALLBACK' END AS side, median(standard) AS standard FROM st GROUP BY 1),
q AS (SELECT *, sum(b_pa) OVER w AS bat, sum(p_ip_outs) OVER w AS outs, sum(p_games) OVER w AS games, sum(p_games_started) OVER w AS starts, row_number() OVER w AS season_number,
 bool_or(b_pa >= 60 AND p_ip_outs >= 60 AND least(b_pa / 600, p_ip_outs / 540) >= 0.25 * greatest(b_pa / 600, p_ip_outs / 540)) OVER w AS balanced FROM s WINDOW w AS (PARTITION BY entity ORDER BY season)),
m0 AS (SELECT a.entity, a.season, b.pos, sum(greatest(b.b_pa, 1)) AS w, max(b.season) AS l FROM s a JOIN s b ON b.entity = a.entity AND b.season <= a.season GROUP BY 1, 2, 3), m AS (SELECT entity, season, arg_max(pos, (w, l, pos)) AS mode FROM m0 GROUP BY 1, 2),
r AS (SELECT q.*, CASE WHEN balanced THEN 'two_way' WHEN outs > 0 AND outs / 540 >= bat / 600 THEN 'pitcher' ELSE 'hitter' END AS role, mode FROM q JOIN m USING (entity, season)),
p AS (SELECT r.*, CASE role WHEN 'two_way' THEN 'TWO_WAY' WHEN 'pitcher' THEN CASE WHEN games <= 0 OR starts / games >= 0.4 THEN 'P' ELSE 'RP' END ELSE mode END AS position FROM r),
f AS (SELECT p.*, st.standard IS NULL OR (role = 'hitter' AND p.position IN ('P', 'RP')) AS standard_fallback, CASE WHEN role = 'hitter' THEN 'HITTER_FALLBACK' ELSE 'PITCHER_FALLBACK' END AS side, st.standard AS own FROM p LEFT JOIN st ON st.position = p.position),
g AS (SELECT f.*, CASE WHEN standard_fallback THEN side ELSE position END AS standard_key, CASE WHEN standard_fallback THEN fb.standard ELSE own END AS standard FROM f JOIN fb USING (side)),
v AS (SELECT a.entity, a.season, list(CASE a.role WHEN 'hitter' THEN b.b_war WHEN 'pitcher' THEN b.p_war ELSE b.b_war + b.p_war END ORDER BY b.season) AS vals FROM g a JOIN s b ON b.entity = a.entity AND b.season <= a.season GROUP BY 1, 2),
x AS (SELECT g.*, vals, list_sum(vals) AS total, list_sum(list_slice(list_sort(vals, 'DESC'), 1, 7)) AS peak, bool_or(role = 'hitter') OVER w AND bool_or(role = 'pitcher') OVER w AS broad_role_switch, bool_or(role = 'two_way') OVER (PARTITION BY entity) AS ever FROM g JOIN v USING (entity, season) WINDOW w AS (PARTITION BY entity ORDER BY season)),
e AS (SELECT entity, arg_max(role, season) AS er, arg_max(position, season) AS ep, arg_max(standard_key, season) AS ek, arg_max(standard, season) AS es, arg_max(standard_fallback, season) AS ef, arg_max(broad_role_switch, season) AS eb, arg_max(total, season) AS et, arg_max(peak, season) AS epk, min(season) AS debut FROM x GROUP BY 1),
z AS (SELECT x.*, e.*, (et + epk) / 2 AS blend, CASE WHEN ever THEN 'two_way_role_path' WHEN eb THEN 'broad_role_switch' WHEN ef THEN 'synthetic_standard_fallback' ELSE 'eligible' END AS reason FROM x JOIN e USING (entity))"""


def _source(spark, sf):
    """Seasons, and standards with fallbacks."""
    o, c = table(spark, sf, "orders"), F.col
    state, price = c("o_orderstatus"), c("o_totalprice")
    thousands = lambda s: F.coalesce(F.sum(F.when(state == s, F.floor(price / 1000))), F.lit(0)).cast("double")
    value = lambda s: F.round(F.sum(F.when(state == s, price).otherwise(0.0)) / 100_000, 2)
    t = o.groupBy(c("o_custkey").alias("entity"), F.year("o_orderdate").alias("season")).agg(
        thousands("F").alias("b_pa"), thousands("O").alias("p_ip_outs"), F.count("*").alias("p_games"), F.count_if(c("o_orderpriority") < "3").alias("p_games_started"), value("F").alias("b_war"), value("O").alias("p_war"), F.min("o_orderkey").alias("k")
    )
    names = {"entity": "player_id", "season": "year", "b_pa": "pa", "p_ip_outs": "ipouts", "p_games": "p_g", "p_games_started": "pitching_gs", "b_war": "batting_war", "p_war": "war_pitch", "position": "pos"}  # as a source has them
    last = o.agg(F.year(F.max("o_orderdate")).alias("last"))  # one row
    age = F.when((c("entity") + c("season")) % 3 != 0, c("season") - 1960.0 - c("entity") % 20 + c("season") % 2)
    t = t.join(F.broadcast(last)).select(
        "*", age.alias("age"), F.when((c("season") == c("last")) & (c("k") % 4 == 0), "in_season").otherwise("complete").alias("season_state"), F.concat(F.lit("*"), (c("k") % 10).cast("string"), F.lit("/H")).alias("position"), F.lit(None).cast("double").alias("total_war")
    )
    t = panel.season_rows(t.drop("k", "last", "total_war").withColumnsRenamed(names))
    standards = spark.sql(f"WITH {_STANDARDS} SELECT * FROM st")
    return t, panel.with_fallbacks(standards, "position", "standard")


def _panel(spark, sf, over=False):
    t, standards = _source(spark, sf)
    c = F.col
    active = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(c("c_custkey").alias("entity"))
    return panel.career_panel(t, standards, as_of=2004, quiet=3, active=active, over=over)


_ROUNDED = ("season_value", "value_to_date", "peak_to_date", "last_three", "best_to_date", "per_season", "starter_share", "final_value", "final_peak", "target_standard", "standard")


@query(f"""WITH {_PANEL} SELECT entity, season, age, CAST(season_number AS INTEGER) AS season_number, season - debut AS years_since_debut, role, position, standard_key, round(standard, 4) AS standard, standard_fallback, CASE WHEN standard_fallback THEN 'standard_fallback:' || CASE role WHEN 'two_way' THEN role ELSE lower(position) END END AS standard_warning, broad_role_switch,
 round(vals[-1], 4) AS season_value, round(total, 4) AS value_to_date, round(peak, 4) AS peak_to_date, round(list_avg(vals[-3:]), 4) AS last_three, round(list_max(vals), 4) AS best_to_date, CAST(len(list_filter(vals, lambda q: q > 0)) AS INTEGER) AS positive_seasons, round(total / season_number, 4) AS per_season, bat AS career_batting, CAST(outs AS DOUBLE) AS career_outs,
 CAST(games AS DOUBLE) AS career_games, CAST(starts AS DOUBLE) AS career_starts, round(starts / greatest(games, 1), 4) AS starter_share, debut, career_end, resolved,
 CASE WHEN resolved THEN round(et, 4) END AS final_value, CASE WHEN resolved THEN round(epk, 4) END AS final_peak, CASE WHEN resolved THEN blend >= standard END AS reaches_standard, CASE WHEN resolved THEN blend >= es END AS reaches_final_standard, CASE WHEN resolved THEN er END AS target_role, CASE WHEN resolved THEN ep END AS target_position,
 CASE WHEN resolved THEN ek END AS target_standard_key, CASE WHEN resolved THEN round(es, 4) END AS target_standard, CASE WHEN resolved THEN ef END AS target_fallback, CASE WHEN resolved THEN reason = 'eligible' END AS target_eligible, CASE WHEN resolved THEN reason END AS target_reason FROM z""")
def career_panel(spark, sf):
    out = _panel(spark, sf).drop("blend_to_date", "final_blend", "career_batting_value", "career_pitching_value")
    return out.withColumns({c: F.round(c, 4) for c in _ROUNDED})


@query(f"""WITH {_PANEL} SELECT reason, count(DISTINCT entity) AS entities, count(*) AS landmarks, count(DISTINCT CASE WHEN role <> 'two_way' AND NOT broad_role_switch AND NOT standard_fallback THEN entity END) AS supported_entities, count(*) FILTER (WHERE role <> 'two_way' AND NOT broad_role_switch AND NOT standard_fallback) AS supported_landmarks
 FROM z WHERE resolved AND reason <> 'eligible' GROUP BY 1""")
def career_exclusions(spark, sf):
    return panel.exclusions(_panel(spark, sf), "entity")


# --- models over the panel ------------------------------------------------------------------

_NUMBERS = ["age", "season_number", "value_to_date", "peak_to_date", "last_three", "best_to_date", "career_batting", "career_outs", "starter_share", "standard"]


def _landmarks(spark, sf):
    """Resolved careers, entities dealt to parts by their number; each entity weighs the same."""
    t = _panel(spark, sf, over=True)
    bucket = F.crc32(F.col("entity").cast("string").cast("binary")) % 10
    part = F.when(bucket < 4, "train").when(bucket < 6, "stack").when(bucket < 8, "select").otherwise("test")
    t = t.withColumn("part", part).withColumn("y", F.col("reaches_final_standard").cast("double"))
    n = F.count("*").over(Window.partitionBy("entity"))
    return cut(t.withColumn("weight", 1.0 / n).withColumns({c: F.col(c).cast("double") for c in _NUMBERS}), "landmarks")


def _families(y: str = "y"):
    return {
        "age_position_prior": ensembles.prior_family([["age_band", "position"], ["position"]], y, "weight"),
        **ensembles.model_families({"regularized_logistic": ("logistic", {}), "boosted_trees": ("trees", {"iterations": 12, "least": 20})}, _NUMBERS, ["role", "position"], y, "weight"),
    }


def _tournament(spark, sf):
    rows = _landmarks(spark, sf).withColumn("age_band", F.floor(F.col("age") / 4))
    return rows, ensembles.tournament(rows, "part", _families(), "y", "weight", ["entity", "season"])


@query()
def model_tournament(spark, sf):
    """Champion among the prior, logistic regression, trees and their stack; a learned model has no SQL."""
    t = _tournament(spark, sf)[1].scores
    return t.select("part", "family", "rows", *[F.round(c, 6).alias(c) for c in ("weight", "brier", "log_loss", "base_brier")], "champion")


@query()
def era_sensitivity(spark, sf):
    rows, t = _tournament(spark, sf)
    out = ensembles.era_sensitivity(rows, "part", _families(), t.champion, "y", "weight", ["entity", "season"], "entity", "debut", (1996, 1997, 2000), least_entities=20, least_events=5)
    return out.withColumns({c: F.round(c, 6) for c in ("brier", "log_loss")})


@query(f"WITH {_PANEL}, fs AS (SELECT entity, CAST(et + epk >= 2 * es AS INT) AS y, row_number() OVER (ORDER BY total / standard DESC, entity) AS place, count(*) OVER () AS n, avg(CAST(et + epk >= 2 * es AS INT)) OVER () AS base FROM z WHERE season_number = 1 AND resolved), sh(share) AS (VALUES (0.01), (0.05), (0.1)) SELECT share::DOUBLE AS share, CAST(greatest(1, ceil(n * share)) AS BIGINT) AS rows, round(avg(y), 6) AS precision, round(avg(y) / any_value(base), 6) AS lift FROM fs JOIN sh ON place <= greatest(1, ceil(n * share)) GROUP BY 1, 2")
def first_season_precision(spark, sf):
    t = _panel(spark, sf).filter("season_number = 1 and resolved").select("entity", (F.col("value_to_date") / F.col("standard")).alias("p"), F.col("reaches_final_standard").cast("int").alias("y"))
    return ensembles.top_precision(t, "p", "y", "entity").withColumns({c: F.round(c, 6) for c in ("precision", "lift")})


# --- out of fold ------------------------------------------------------------------------------

_ORIGINS = [1993, 1994, 1995, 1996, 1997, 1998, 1999, 2000]
_FOLDS = f"""{SEASONS}, h0 AS (SELECT entity, season, CAST(h AS INTEGER) AS horizon, season + CAST(h AS INTEGER) AS known, c_mktsegment AS segment, value, (SELECT coalesce(sum(b.value), 0) FROM seasons b WHERE b.entity = a.entity AND b.season BETWEEN a.season + 1 AND a.season + h) > 250000 * h AS y
 FROM seasons a JOIN customer ON c_custkey = entity CROSS JOIN (VALUES (1), (2)) v(h)), h AS (SELECT * FROM h0 WHERE known <= 2001), o AS (SELECT CAST(unnest(range(1993, 2001)) AS INTEGER) AS fold),
tr AS (SELECT fold, h.* FROM o JOIN h ON greatest(known, season + 1) <= fold), su AS (SELECT fold, count(*) AS train_rows, count(*) FILTER (WHERE y) AS events FROM tr GROUP BY 1), te AS (SELECT season AS fold, count(*) AS test_rows FROM h GROUP BY 1),
mg AS (SELECT h.season AS fold, count(DISTINCT horizon) FILTER (WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.fold = h.season AND tr.horizon = h.horizon)) AS missing_groups FROM h GROUP BY 1),
fo AS (SELECT o.fold, coalesce(train_rows, 0) AS train_rows, coalesce(events, 0) AS events, coalesce(test_rows, 0) AS test_rows, coalesce(missing_groups, 0) AS missing_groups FROM o LEFT JOIN su USING (fold) LEFT JOIN te USING (fold) LEFT JOIN mg USING (fold)),
st AS (SELECT *, CASE WHEN train_rows < 100 THEN 'few_rows' WHEN least(events, train_rows - events) < 10 THEN 'few_outcomes' WHEN test_rows = 0 THEN 'no_test_rows' WHEN missing_groups > 0 THEN 'unsupported_groups' ELSE 'fitted' END AS status FROM fo)"""


def _folds(spark, sf):
    s = seasons(spark, sf)
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("segment"))
    t = next_calendar_sum(next_calendar_sum(s, "entity", "season", "value", 1, "v1"), "entity", "season", "value", 2, "v2").join(c, "entity")
    h = F.explode(F.array(*[F.struct(F.lit(i).alias("horizon"), (F.col(f"v{i}") > 250_000 * i).alias("y")) for i in (1, 2)])).alias("h")
    t = t.select("entity", "season", "segment", "value", h).select("*", "h.*").drop("h").withColumn("known", F.col("season") + F.col("horizon")).filter("known <= 2001")
    return cut(t.withColumn("y", F.col("y").cast("double")).withColumn("snapshot", F.concat_ws("/", "entity", "season")), "folded")


@query(f"""WITH {_FOLDS}, al AS (SELECT fold, avg(CAST(y AS INT)) AS r FROM tr GROUP BY 1), lv AS (SELECT fold, horizon, segment, sum(CAST(y AS INT)) AS e, count(*) AS n FROM tr GROUP BY 1, 2, 3), kn AS (SELECT entity, min(greatest(known, season + 1)) AS k FROM h GROUP BY 1),
p AS (SELECT h.*, (e + 20 * r) / (n + 20) AS p, k > season AS cold FROM h JOIN st ON st.fold = season AND status = 'fitted' JOIN al ON al.fold = season JOIN lv ON lv.fold = season AND lv.horizon = h.horizon AND lv.segment = h.segment JOIN kn USING (entity))
SELECT entity, season, horizon, cold, CAST(y AS INTEGER) AS y, round(least(greatest(p, 1e-6), 1 - 1e-6), 6) AS probability, round(1.0 / (SELECT count(DISTINCT q.season) FROM p q WHERE q.entity = p.entity) / count(*) OVER (PARTITION BY entity, season), 6) AS weight FROM p""")
def out_of_fold_priors(spark, sf):
    fit = ensembles.prior_family([["horizon", "segment"], ["horizon"]], "y")
    made, _ = ensembles.out_of_fold(_folds(spark, sf), "season", "known", "entity", "snapshot", "y", fit, _ORIGINS, groups="horizon")
    return made.select("entity", "season", "horizon", "cold", F.col("y").cast("int").alias("y"), F.round("probability", 6).alias("probability"), F.round("weight", 6).alias("weight"))


@query(f"WITH {_FOLDS} SELECT CAST(fold AS INTEGER) AS fold, train_rows, events, test_rows, missing_groups, status FROM st")
def out_of_fold_support(spark, sf):
    fit = ensembles.prior_family([["horizon"]], "y")
    return ensembles.out_of_fold(_folds(spark, sf), "season", "known", "entity", "snapshot", "y", fit, _ORIGINS, groups="horizon")[1]


@query()
def out_of_fold_calibrated(spark, sf):
    """Logistic models, one an origin, then a bounded calibration by horizon of what they said of rows they never saw."""
    rows = _folds(spark, sf).withColumn("value", F.col("value").cast("double"))
    fit = ensembles.model_family("logistic", ["value"], ["segment", "horizon_name"], "y")
    made, _ = ensembles.out_of_fold(rows.withColumn("horizon_name", F.col("horizon").cast("string")), "season", "known", "entity", "snapshot", "y", fit, _ORIGINS[-3:], groups="horizon_name")
    made = cut(made.withColumn("cold_start", F.col("cold").cast("double")), "out-of-fold")
    out = models.calibrated(made, models.calibrations(made, "horizon", "probability", "y", "weight", "cold_start"), "horizon", "probability", "calibrated", "cold_start")
    return out.select("entity", "season", "horizon", "cold", F.col("y").cast("int").alias("y"), F.round("probability", 6).alias("probability"), F.round("calibrated", 6).alias("calibrated"))


# --- paired scenarios ---------------------------------------------------------------------------

_LEAST = {"all": 0, "role": 20, "stage": 20, "role_stage": 20, "tier": 8}


def _scenario_rows(spark, sf):
    """Resolved landmarks with what was still to come and centres by role and season number (means of all)."""
    needed = ("entity", "season", "role", "season_number", "value_to_date", "peak_to_date", "standard", "reaches_standard", "final_value", "final_peak")
    t = cut(_panel(spark, sf).filter("resolved").select(*needed), "resolved")  # used for the centres and beside them
    t = t.withColumn("more", F.col("final_value") - F.col("value_to_date")).withColumn("more_peak", F.col("final_peak") - F.col("peak_to_date"))
    centre = t.groupBy("role", "season_number").agg(F.round(F.avg("more"), 7).alias("c1"), F.round(F.avg("more_peak"), 7).alias("c2"))
    t = t.join(broadcast_if_small(centre), ["role", "season_number"])
    return cut(t.select("entity", "season", "role", "season_number", "value_to_date", "peak_to_date", "standard", "reaches_standard", F.round(F.col("more") - F.col("c1"), 7).alias("r1"), F.round(F.col("more_peak") - F.col("c2"), 7).alias("r2"), (F.col("value_to_date") + F.col("c1")).alias("final"), (F.col("peak_to_date") + F.col("c2")).alias("second")), "scenario-rows")


_BANKS = f"""{_PANEL}, b0 AS (SELECT entity, season, role, season_number, total AS value, et - total AS more, epk - peak AS more_peak FROM z WHERE resolved), b1 AS (SELECT *, round(avg(more) OVER w, 7) AS c1, round(avg(more_peak) OVER w, 7) AS c2 FROM b0 WINDOW w AS (PARTITION BY role, season_number)),
b2 AS (SELECT entity, season, role, value, round(more - c1, 7) AS r1, round(more_peak - c2, 7) AS r2, CASE WHEN season_number = 1 THEN 'first' WHEN season_number <= 3 THEN 'seasons_2_3' WHEN season_number <= 6 THEN 'seasons_4_6' WHEN season_number <= 10 THEN 'seasons_7_10' ELSE 'season_11_plus' END AS stage FROM b1),
b3 AS (SELECT role, stage, quantile_cont(value, 0.7) AS e70, quantile_cont(value, 0.9) AS e90 FROM b2 GROUP BY 1, 2 HAVING count(DISTINCT entity) >= 20),
b4 AS (SELECT b2.*, CASE WHEN value >= e90 THEN 'top_10' WHEN value >= e70 THEN 'upper_30' WHEN e70 IS NOT NULL THEN 'base_70' END AS tier FROM b2 LEFT JOIN b3 USING (role, stage)),
n0 AS (SELECT '0' AS bank, 0 AS least, * FROM b4 UNION ALL SELECT '1/' || role, 20, * FROM b4 UNION ALL SELECT '2/' || stage, 20, * FROM b4 UNION ALL SELECT '3/' || role || '/' || stage, 20, * FROM b4 UNION ALL SELECT '4/' || role || '/' || stage || '/' || tier, 8, * FROM b4 WHERE tier IS NOT NULL),
n1 AS (SELECT n0.*, 1.0 / count(*) OVER (PARTITION BY bank, entity) AS w FROM n0 WHERE bank IN (SELECT bank FROM n0 GROUP BY bank, least HAVING count(DISTINCT entity) >= least)),
n2 AS (SELECT bank, r1, r2, sum(sum(w)) OVER (PARTITION BY bank ORDER BY r1, r2) / sum(sum(w)) OVER (PARTITION BY bank) AS hi FROM n1 GROUP BY 1, 2, 3),
dr AS (SELECT bank, draw, min((r1, r2)) AS x FROM n2 JOIN (SELECT unnest(range(0, 60)) AS draw) ON hi >= (draw + 0.5) / 60 - 1e-9 GROUP BY 1, 2), bk AS (SELECT bank, draw, struct_extract(x, 1) AS first, struct_extract(x, 2) AS second FROM dr)"""


def _bank(rows):
    return scenarios.paired_bank(rows, "role", "season_number", "value_to_date", "r1", "r2", "entity", draws=60, least=_LEAST)


@query(f"WITH {_BANKS} SELECT bank, draw, round(first, 6) AS first, round(second, 6) AS second FROM bk")
def paired_scenario_bank(spark, sf):
    return _bank(_scenario_rows(spark, sf))[1].select("bank", "draw", F.round("first", 6).alias("first"), F.round("second", 6).alias("second"))


@query(f"""WITH {_BANKS}, kk AS (SELECT DISTINCT bank FROM bk) SELECT entity, season, coalesce((SELECT bank FROM kk WHERE bank = '4/' || role || '/' || stage || '/' || tier), (SELECT bank FROM kk WHERE bank = '3/' || role || '/' || stage), (SELECT bank FROM kk WHERE bank = '2/' || stage), (SELECT bank FROM kk WHERE bank = '1/' || role), '0') AS bank FROM b4""")
def chosen_scenario_bank(spark, sf):
    rows = _scenario_rows(spark, sf)
    return scenarios.with_bank(rows, *_bank(rows), "role", "season_number", "value_to_date").select("entity", "season", "bank")


@query()
def tilted_distributions(spark, sf):
    """Quantiles of four outputs of pairs tilted to a rate; held against plain numpy in a test."""
    rows = _scenario_rows(spark, sf)
    edges, bank = _bank(rows)
    t = scenarios.with_bank(rows, edges, cut(bank, "bank"), "role", "season_number", "value_to_date").withColumn("p", F.least(F.lit(0.95), F.greatest(F.lit(0.02), F.col("final") / F.col("standard") / 4)))
    out = scenarios.scenario_distributions(t, bank, ["entity", "season"], "final", "second", "peak_to_date", "standard", "p")
    return out.withColumns({c: F.transform(c, lambda x: F.round(x, 6)) for c in ("final", "second", "blend", "margin")}).withColumns({c: F.round(c, 6) for c in ("probability", "shift")})


@query()
def bootstrap_gates(spark, sf):
    """The model's Brier score against a flat one and a near one, cells of priority and segment, customers drawn with replacement."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    t = o.join(c, F.col("c_custkey") == F.col("o_custkey")).select(
        "o_custkey", "o_orderpriority", "c_mktsegment", (F.col("o_totalprice") * (0.7 + F.col("o_orderkey") % 7 / 10) > 200_000).cast("double").alias("y"), F.least(F.lit(0.95), F.col("o_totalprice") / 500_000).alias("model"), F.lit(0.5).alias("half"), F.least(F.lit(0.9), F.col("o_totalprice") / 420_000).alias("near")
    )
    cells = ("o_orderpriority", "c_mktsegment")
    points, drawn = metrics.paired_improvements(t, "o_custkey", cells, "y", "model", ["half", "near"], replicates=400)
    out = metrics.macro_comparison(points, drawn, cells)
    return out.withColumns({x: F.round(x, 8) for x in ("macro", "macro_low", "macro_high")})


# --- roles, signals, weights ---------------------------------------------------------------------

@query("""WITH r AS (SELECT l_suppkey AS id, l_partkey % 30 AS g, l_quantity AS b, CASE WHEN l_suppkey % 3 = 0 THEN l_linenumber * 9 ELSE 0 END AS o, CASE l_suppkey % 4 WHEN 0 THEN 'P' WHEN 1 THEN ' 2b/UNK ' WHEN 2 THEN 'unk' END AS p, CASE WHEN l_suppkey % 5 = 0 THEN 'Pitcher' WHEN l_suppkey % 7 = 0 THEN l_returnflag END AS role, l_suppkey % 4 = 2 AND l_suppkey % 3 > 0 AS idle FROM lineitem),
s AS (SELECT id, sum(g) AS g, sum(CASE WHEN idle THEN 0 ELSE b END) AS b, sum(o) AS o, bool_or(coalesce(contains(p, '2b'), false)) AS f, bool_or(coalesce(p = 'P', false)) AS p, count(DISTINCT lower(role)) = 1 AND min(lower(role)) IN ('hitter', 'pitcher') AS agreed, min(lower(role)) AS told FROM r GROUP BY 1)
SELECT id, CASE WHEN g >= 20 AND b >= 60 AND o >= 60 AND f THEN 'two_way' WHEN f THEN 'hitter' WHEN o > 0 OR p THEN 'pitcher' WHEN b > 0 THEN 'hitter' WHEN agreed THEN told END AS role, CASE WHEN g >= 20 AND b >= 60 AND o >= 60 AND f THEN 'material_batting_and_pitching_with_position_evidence' WHEN f THEN 'position_player_with_incidental_or_no_pitching'
 WHEN o > 0 OR p THEN 'pitcher_with_incidental_or_no_batting' WHEN b > 0 THEN 'batting_opportunity_without_position_evidence' WHEN agreed THEN 'unanimous_source_' || told || '_without_pa_ip_or_known_position' END AS basis FROM s""")
def appearance_roles(spark, sf):
    c, k = F.col, F.col("l_suppkey")
    position = F.when(k % 4 == 0, "P").when(k % 4 == 1, " 2b/UNK ").when(k % 4 == 2, "unk")
    told = F.when(k % 5 == 0, "Pitcher").when(k % 7 == 0, c("l_returnflag"))
    batting = F.when((k % 4 == 2) & (k % 3 > 0), 0.0).otherwise(c("l_quantity"))
    rows = table(spark, sf, "lineitem").select(k.alias("id"), (c("l_partkey") % 30).alias("g"), batting.alias("b"), F.when(k % 3 == 0, c("l_linenumber") * 9).otherwise(0).alias("o"), position.alias("p"), told.alias("role"))
    return careers.aggregate_roles(rows, ["id"], "g", "b", "o", "p", "role")


_SIGNAL = """b AS (SELECT o_orderkey AS id, o_custkey AS entity, CASE WHEN c_custkey % 3 = 0 THEN 'pitcher' ELSE 'hitter' END AS role, c_mktsegment AS level, 17.0 + (o_orderkey % 97) / 10.0 AS age, CASE WHEN o_orderkey % 23 <> 0 THEN (o_orderkey % 131) * 1.0 END AS workload, o_orderpriority AS band, o_orderstatus = 'F' AS e36, o_orderstatus <> 'O' AS e60, (o_orderkey % 83) / 100.0 AS p36, (o_orderkey % 83) / 100.0 + (o_orderkey % 13) / 100.0 AS p60 FROM orders JOIN customer ON c_custkey = o_custkey),
w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY role, level, entity) AS wt FROM b), pc AS (SELECT *, 100 * (coalesce(sum(wt) OVER (PARTITION BY role, level ORDER BY age RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - sum(wt) OVER (PARTITION BY role, level, age) / 2) / sum(wt) OVER (PARTITION BY role, level) AS pct FROM w),
ag AS (SELECT role, level, count(DISTINCT entity) AS players FROM b GROUP BY 1, 2), bl AS (SELECT role, level, band, count(*) AS n, sum(e36::INT) AS n36, sum(e60::INT) AS n60, avg(e36::INT) AS r36, avg(e60::INT) AS r60 FROM b GROUP BY 1, 2, 3)"""


@query(f"""WITH {_SIGNAL}, j AS (SELECT pc.*, players, n, n36, n60, r36 * 0.5 AS b36, r60 * 0.6 AS b60 FROM pc JOIN ag USING (role, level) JOIN bl USING (role, level, band)),
g AS (SELECT id, players >= 40 AND n >= 100 AND n36 >= 5 AND n60 >= 5 AS g1, round(pct, 9) <= 33 AS g2, coalesce(workload >= CASE WHEN role = 'hitter' THEN 75 ELSE 20 END, false) AS g3, p36 >= 0.2 AS g4, round(p36 - b36, 8) >= 0.1 AS g5, round(p60 - b60, 8) > 0 AS g6, round(p36 - b36, 8) >= 0.25 AND round(pct, 9) <= 25 AS pr FROM j)
SELECT id, g1 AND g2 AND g3 AND g4 AND g5 AND g6 AS eligible, CASE WHEN g1 AND g2 AND g3 AND g4 AND g5 AND g6 THEN CASE WHEN pr THEN 'priority' ELSE 'watch' END ELSE 'none' END AS tier,
 concat_ws(',', CASE WHEN NOT g1 THEN 'supported_context' END, CASE WHEN NOT g2 THEN 'young_for_role_and_level' END, CASE WHEN NOT g3 THEN 'minimum_workload' END, CASE WHEN NOT g4 THEN 'minimum_probability' END, CASE WHEN NOT g5 THEN 'primary_edge' END, CASE WHEN NOT g6 THEN 'long_edge' END) AS failed FROM g""")
def signal_eligibility(spark, sf):
    o, k, c = table(spark, sf, "orders"), F.col("o_orderkey"), F.col
    b = o.join(table(spark, sf, "customer"), c("c_custkey") == c("o_custkey")).select(
        k.alias("id"), c("o_custkey").alias("entity"), F.when(c("c_custkey") % 3 == 0, "pitcher").otherwise("hitter").alias("role"), c("c_mktsegment").alias("level"), (17.0 + (k % 97) / 10.0).alias("age"), F.when(k % 23 != 0, (k % 131) * 1.0).alias("workload"), c("o_orderpriority").alias("band"),
        (c("o_orderstatus") == "F").cast("int").alias("e36"), (c("o_orderstatus") != "O").cast("int").alias("e60"), ((k % 83) / 100.0).alias("p36"), ((k % 83) / 100.0 + (k % 13) / 100.0).alias("p60"),
    )
    b = b.withColumn("w", entity_weight("role", "level", "entity"))
    t = cohorts.mid_rank_percentile(b, ["role", "level"], "age", c("w"), "percentile")
    players = b.groupBy("role", "level").agg(F.countDistinct("entity").alias("players"))
    rates = b.groupBy("role", "level", "band").agg(F.count("*").alias("n"), F.sum("e36").alias("n36"), F.sum("e60").alias("n60"), (F.avg("e36") * 0.5).alias("b36"), (F.avg("e60") * 0.6).alias("b60"))
    t = t.join(broadcast_if_small(players), ["role", "level"]).join(broadcast_if_small(rates), ["role", "level", "band"])
    ok, tier, failed = signal_gates(c("role"), F.round("percentile", 9), c("players"), c("workload"), [(c("n"), c("n36")), (c("n"), c("n60"))], (c("p36"), c("b36")), (c("p60"), c("b60")), players=40)
    return t.select("id", ok.alias("eligible"), tier.alias("tier"), failed.alias("failed"))


@query(f"WITH {SEASONS} SELECT entity, season, round(1.0 / count(*) OVER (PARTITION BY entity) * (SELECT count(*) FROM seasons) / (SELECT count(DISTINCT entity) FROM seasons), 6) AS w FROM seasons")
def mean_one_weights(spark, sf):
    return scaled_weights(seasons(spark, sf), ["entity"], "w").select("entity", "season", F.round("w", 6).alias("w"))


@query("WITH t AS (SELECT c_custkey AS id, c_acctbal AS x FROM customer) SELECT id, round(CASE WHEN x <= -500 THEN 1 WHEN x <= 0 THEN 1 + (x + 500) / 500 * 3 WHEN x <= 4000 THEN 4 - x / 4000 * 2 WHEN x < 9000 THEN 2 + (x - 4000) / 5000 * 8 ELSE 10 END, 6) AS y FROM t")
def interpolated(spark, sf):
    points = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.round(numbers.interpolated(F.col("c_acctbal"), points(-500, 0, 4000, 9000), points(1, 4, 2, 10)), 6).alias("y"))


#: Entities without a complete season are scored by their partial ones.
_PARTIAL_TOO = _PANEL.replace("WHERE season_state = 'complete')", "WHERE season_state = 'complete' OR career_end IS NULL)")


@query(f"""WITH {_PARTIAL_TOO}, cu AS (SELECT DISTINCT entity FROM s2 WHERE season_state = 'in_season'), l AS (SELECT x.* FROM x JOIN (SELECT entity, max(season) AS season FROM x GROUP BY 1) USING (entity, season) WHERE entity IN (SELECT entity FROM cu)),
bt AS (SELECT l.entity, list(s2.b_war ORDER BY s2.season) AS b FROM l JOIN s2 ON s2.entity = l.entity AND s2.season <= l.season GROUP BY 1), hf AS (SELECT standard AS h FROM fb WHERE side = 'HITTER_FALLBACK')
SELECT entity, season, career_end IS NULL AS feature_partial, role = 'two_way' AS two_way_policy, CASE WHEN role = 'two_way' THEN 'hitter' ELSE role END AS role, CASE WHEN role = 'two_way' THEN 'DH' ELSE position END AS position, CASE WHEN role = 'two_way' THEN 'HITTER_FALLBACK' ELSE standard_key END AS standard_key, round(CASE WHEN role = 'two_way' THEN h ELSE standard END, 4) AS standard,
 role <> 'two_way' AND standard_fallback AS standard_fallback, role <> 'two_way' AND broad_role_switch AS broad_role_switch, round(CASE WHEN role = 'two_way' THEN list_sum(b) ELSE total END, 4) AS value_to_date, round(CASE WHEN role = 'two_way' THEN list_sum(list_slice(list_sort(b, 'DESC'), 1, 7)) ELSE peak END, 4) AS peak_to_date,
 round(CASE WHEN role = 'two_way' THEN list_avg(b[-3:]) ELSE list_avg(vals[-3:]) END, 4) AS last_three, CAST(CASE WHEN role = 'two_way' THEN len(list_filter(b, lambda q: q > 0)) ELSE len(list_filter(vals, lambda q: q > 0)) END AS INTEGER) AS positive_seasons FROM l JOIN bt USING (entity) CROSS JOIN hf""")
def scoring_rows(spark, sf):
    """Entities with a season under way."""
    t, standards = _source(spark, sf)
    out = panel.scoring_rows(t, standards, as_of=2004)
    names = ("entity", "season", "feature_partial", "two_way_policy", "role", "position", "standard_key", "standard", "standard_fallback", "broad_role_switch", "value_to_date", "peak_to_date", "last_three", "positive_seasons")
    return out.select(*names).withColumns({c: F.round(c, 4) for c in ("standard", "value_to_date", "peak_to_date", "last_three")})


@query("""WITH r AS (SELECT l_suppkey AS id, l_partkey % 20 AS team, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey * 10 + l_suppkey % 10 AS o, l_linenumber AS k, l_quantity AS q, strftime(l_shipdate, '%Y-%m-%d') AS d, l_returnflag AS f, l_linestatus AS st FROM lineitem),
ro AS (SELECT id, team, arg_min(f, o) AS bats, arg_min(CASE WHEN o % 2 = 0 THEN 'n' || id END, o) AS name, min(d) AS a, max(d) AS z FROM r WHERE k % 4 = 0 GROUP BY 1, 2), ba AS (SELECT id, team, arg_max(q, (q, -o)) AS pa, arg_max('b' || id, (q, -o)) AS name FROM r WHERE k % 4 = 1 GROUP BY 1, 2),
pi AS (SELECT id, team, arg_max(q / 2, (q, -o)) AS ip, arg_max(st, (q, -o)) AS st FROM r WHERE k % 4 = 2 AND f = 'R' GROUP BY 1, 2), fi AS (SELECT id, team, arg_max(CASE WHEN q > 25 THEN 'P' ELSE 'C' END, (q, -o)) AS position FROM r WHERE k % 4 = 3 GROUP BY 1, 2),
j AS (SELECT coalesce(ro.id, ba.id, pi.id, fi.id) AS id, coalesce(ro.team, ba.team, pi.team, fi.team) AS team, CASE WHEN ro.id IS NOT NULL THEN ro.name WHEN ba.id IS NOT NULL THEN ba.name END AS name, coalesce(pa, 0) AS pa, coalesce(ip, 0) AS ip, coalesce(position, CASE WHEN coalesce(ip, 0) > 0 THEN 'P' ELSE 'UNK' END) AS position, bats, a, z, ba.id IS NULL AND fi.id IS NULL AS bare, pa AS batting_pa, st
 FROM ro FULL JOIN ba ON ba.id = ro.id AND ba.team = ro.team FULL JOIN pi ON pi.id = coalesce(ro.id, ba.id) AND pi.team = coalesce(ro.team, ba.team) FULL JOIN fi ON fi.id = coalesce(ro.id, ba.id, pi.id) AND fi.team = coalesce(ro.team, ba.team, pi.team))
SELECT id, team, name, position, bats, a AS first_observed, z AS last_observed, batting_pa, st AS pitching_st, CASE WHEN pa >= 25 AND ip >= 10 THEN 'two_way' WHEN ip > 0 OR position = 'P' THEN 'pitcher' ELSE 'hitter' END AS role,
 CASE WHEN pa >= 25 AND ip >= 10 THEN 'material_batting_and_pitching_opportunity' WHEN ip > 0 OR position = 'P' THEN 'pitching_or_primary_position_evidence' WHEN bare THEN 'default_hitter_no_stat_evidence' ELSE 'batting_or_non_pitcher_evidence' END AS role_inference FROM j""")
def team_seasons(spark, sf):
    c, k = F.col, F.col("l_linenumber")
    o = (c("l_orderkey") * 10 + k) * 1_000_000 + c("l_partkey") * 10 + c("l_suppkey") % 10
    r = table(spark, sf, "lineitem").select(c("l_suppkey").alias("id"), (c("l_partkey") % 20).alias("team"), o.alias("o"), k.alias("k"), c("l_quantity").alias("q"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("d"), c("l_returnflag").alias("f"), c("l_linestatus").alias("st"))
    key = ("id", "team", "o")
    name = lambda s: F.concat(F.lit(s), c("id").cast("string"))
    roster = r.filter("k % 4 = 0").select(*key, F.when(c("o") % 2 == 0, name("n")).alias("name"), F.lit(None).cast("date").alias("born"), c("f").alias("bats"), c("st").alias("throws"), c("d").alias("first"), c("d").alias("last"))
    batting = r.filter("k % 4 = 1").select(*key, name("b").alias("name"), c("q").alias("PA"))
    pitching = r.filter("k % 4 = 2 and f = 'R'").select(*key, F.lit(None).cast("string").alias("name"), (c("q") / 2).alias("IP"), "st")
    fielding = r.filter("k % 4 = 3").select(*key, F.lit(None).cast("string").alias("name"), c("q").alias("innings"), F.when(c("q") > 25, "P").otherwise("C").alias("position"))
    out = careers.team_seasons(roster, batting, pitching, fielding, ["id", "team"], "o")
    return out.select("id", "team", "name", "position", "bats", "first_observed", "last_observed", c("batting_PA").alias("batting_pa"), "pitching_st", "role", "role_inference")
