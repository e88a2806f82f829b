"""Queries over aggregates, ordered prefixes, survival, ranks, boards and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitwise.functions import numbers as N
from pitwise.operators import aggregates as A
from pitwise.operators import board, checks, metrics, ordered, ranking, survival, temporal
from pitwise.operators.split import exact_quantiles
from pitwise.plans.catalog import SEASONS, query, r6, seasons, table

_S = f"WITH {SEASONS}"


def _segments(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"))


# --- aggregates -------------------------------------------------------------------


@query(f"{_S} SELECT season, round(sum(value * n) / sum(n), 4) AS mean FROM seasons GROUP BY 1")
def weighted_mean(spark, sf):
    return seasons(spark, sf).groupBy("season").agg(F.round(A.weighted_mean(F.col("value"), F.col("n")), 4).alias("mean"))


@query(f"{_S} SELECT entity, season, round(1.0 / count(*) OVER (PARTITION BY entity), 6) AS w FROM seasons")
def entity_weights(spark, sf):
    return seasons(spark, sf).select("entity", "season", r6(A.entity_weight("entity")).alias("w"))


@query("SELECT event_id, round(1.0 / (SELECT count(DISTINCT event_type) FROM events x WHERE x.user_id = e.user_id) / count(*) OVER (PARTITION BY user_id, event_type), 6) AS w FROM events e")
def two_level_weights(spark, sf):
    return A.two_level_weights(table(spark, sf, "events"), "user_id", "event_type", "w").select("event_id", r6("w").alias("w"))


@query(f"{_S}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY value DESC) AS rn FROM seasons) SELECT entity, round(sum(value), 2) AS peak FROM r WHERE rn <= 3 GROUP BY 1")
def top_k_sum(spark, sf):
    return seasons(spark, sf).groupBy("entity").agg(F.round(A.top_k_sum(F.col("value"), 3), 2).alias("peak"))


@query("WITH p AS (SELECT o_custkey AS entity, o_orderpriority AS c, count(*) AS w, max(o_orderkey) AS last FROM orders GROUP BY 1, 2) SELECT entity, arg_max(c, (w, last, c)) AS mode FROM p GROUP BY 1")
def weighted_mode(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("c"), F.lit(1).alias("w"), F.col("o_orderkey").alias("t"))
    return A.weighted_mode(o, ["entity"], "c", "w", "t", "mode")


@query("SELECT o_custkey, arg_max(o_orderkey, o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS last_finished FROM orders GROUP BY 1")
def latest_non_null(spark, sf):
    o = table(spark, sf, "orders").withColumn("finished", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")))
    return o.groupBy("o_custkey").agg(A.latest_non_null("finished", "o_orderkey").alias("last_finished"))


@query(f"""{_S}, g AS (SELECT season, value AS v, sum(n) AS w FROM seasons GROUP BY 1, 2), p AS (SELECT *, (sum(w) OVER (PARTITION BY season ORDER BY v) - w / 2.0) / sum(w) OVER (PARTITION BY season) AS pos FROM g),
b AS (SELECT *, lead(pos) OVER o AS nat, lead(v) OVER o AS nv, row_number() OVER o AS rn FROM p WINDOW o AS (PARTITION BY season ORDER BY v))
SELECT season, """ + ", ".join(f"round(max(CASE WHEN pos <= {q} AND nat > {q} THEN v + (nv - v) * ({q} - pos) / (nat - pos) WHEN (rn = 1 AND pos > {q}) OR (nat IS NULL AND pos <= {q}) THEN v END), 4) AS q{round(q * 100):02d}" for q in (0.1, 0.5, 0.9)) + " FROM b GROUP BY 1")
def weighted_quantiles(spark, sf):
    out = A.weighted_quantiles(seasons(spark, sf), ["season"], "value", "n", (0.1, 0.5, 0.9))
    return out.select("season", *[F.round(c, 4).alias(c) for c in ("q10", "q50", "q90")])


@query(f"{_S} SELECT season, round(quantile_cont(value, 0.25), 4) AS q25, round(median(value), 4) AS q50 FROM seasons GROUP BY 1")
def linear_quantiles(spark, sf):
    q = exact_quantiles(seasons(spark, sf), ["season"], "value", (0.25, 0.5))
    return q.select("season", F.round(F.get("quantiles", F.lit(0)), 4).alias("q25"), F.round(F.get("quantiles", F.lit(1)), 4).alias("q50"))


_RATES = """WITH r AS (SELECT c_mktsegment AS s, c_nationkey AS n, CAST(o_orderpriority = '1-URGENT' AS INT) AS e FROM orders JOIN customer ON o_custkey = c_custkey), g AS (SELECT avg(e) AS rate FROM r),
m AS (SELECT s, (sum(e) + 50 * (SELECT rate FROM g)) / (count(*) + 50) AS rate FROM r GROUP BY 1)
SELECT r.s AS segment, r.n AS nation, round((sum(e) + 50 * any_value(m.rate)) / (count(*) + 50), 6) AS rate FROM r JOIN m ON r.s = m.s GROUP BY 1, 2"""


@query(_RATES)
def shrunken_rates(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("event")).join(_segments(spark, sf), "entity")
    return A.shrunken_rates(o, [[], ["segment"], ["segment", "nation"]], "event")[2].select("segment", "nation", r6("rate").alias("rate"))


@query(f"""{_S}, p AS (SELECT s.*, season + d AS point, 1 - abs(d) / 3.0 AS w FROM seasons s CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) t(d))
SELECT CAST(point AS INTEGER) AS point, round(sum(value * w) / sum(w), 4) AS mean, count(DISTINCT entity) AS entities FROM p GROUP BY 1 HAVING count(DISTINCT entity) >= 1195""")
def kernel_curve(spark, sf):
    return A.kernel_curve(seasons(spark, sf), [], "season", "value", "entity", least=1195).select("point", F.round("mean", 4).alias("mean"), "entities")


@query("SELECT l_partkey, median(l_linenumber) AS median_rank, median(l_quantity) AS median_percentile, count(DISTINCT l_suppkey) AS sources, CAST(max(l_shipdate) AS DATE) AS as_of FROM lineitem GROUP BY 1")
def consensus(spark, sf):
    out = A.consensus(table(spark, sf, "lineitem"), ["l_partkey"], "l_linenumber", "l_quantity", "l_suppkey", "l_shipdate")
    return out.withColumn("as_of", F.to_date("as_of"))


@query(f"{_S}, m AS (SELECT max(n) + 1 AS m FROM seasons) SELECT entity, season, round(1 - exp(sum(ln(1 - n / m)) OVER (PARTITION BY entity ORDER BY season)), 6) AS cumulative FROM seasons, m")
def survival_product(spark, sf):
    s = seasons(spark, sf)
    m = s.agg((F.max("n") + 1).alias("m"))
    return s.join(F.broadcast(m)).select("entity", "season", r6(A.survival(F.col("n") / F.col("m"), ["entity"], "season")).alias("cumulative"))


@query("PIVOT (SELECT o_custkey, o_orderstatus, o_totalprice FROM orders) ON o_orderstatus IN ('F', 'O', 'P') USING round(sum(o_totalprice), 2) GROUP BY o_custkey")
def pivoted(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.sum("o_totalprice"), 2))


@query(f"{_S} SELECT entity, season, unnest(['a', 'b']) AS side, unnest([a, b]) AS amount FROM seasons")
def stacked(spark, sf):
    return seasons(spark, sf).select("entity", "season", F.expr("stack(2, 'a', a, 'b', b) as (side, amount)"))


# --- ordered prefixes ---------------------------------------------------------------

_PREFIX = f"""{_S}, p AS (SELECT *, row_number() OVER w AS seasons_so_far, round(sum(value) OVER w, 2) AS total_so_far, round(avg(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS trailing3,
 round(avg(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 4) AS prior3, max(value) OVER w AS best_so_far, CAST(count(*) FILTER (WHERE value > 0) OVER w AS BIGINT) AS positive_so_far FROM seasons WINDOW w AS (PARTITION BY entity ORDER BY season)),
k AS (SELECT p.entity, p.season, s.value, row_number() OVER (PARTITION BY p.entity, p.season ORDER BY s.value DESC) AS rn FROM p JOIN seasons s ON s.entity = p.entity AND s.season <= p.season)
SELECT p.entity, p.season, CAST(seasons_so_far AS INTEGER) AS seasons_so_far, total_so_far, trailing3, prior3, best_so_far, positive_so_far, (SELECT round(sum(value), 2) FROM k WHERE k.entity = p.entity AND k.season = p.season AND rn <= 3) AS peak_so_far FROM p"""


@query(_PREFIX)
def prefix_features(spark, sf):
    out = ordered.prefix_features(seasons(spark, sf), "entity", "season", "value", peak=3)
    return out.select("entity", "season", "seasons_so_far", F.round("total_so_far", 2).alias("total_so_far"), F.round("trailing3", 4).alias("trailing3"), F.round("prior3", 4).alias("prior3"), "best_so_far", "positive_so_far", F.round("peak_so_far", 2).alias("peak_so_far"))


@query(f"""{_S}, l AS (SELECT *, max(season) OVER (PARTITION BY entity) AS last_season, sum(value) OVER (PARTITION BY entity) AS total, sum(value) OVER (PARTITION BY entity ORDER BY season) AS so_far FROM seasons)
SELECT entity, season, last_season, last_season <= 1998 AS resolved, CASE WHEN last_season <= 1998 THEN round(total - so_far, 2) END AS remaining FROM l""")
def remaining(spark, sf):
    out = ordered.remaining(seasons(spark, sf), "entity", "season", "value", 2001)
    return out.select("entity", "season", "last_season", "resolved", F.round("remaining", 2).alias("remaining"))


@query(f"{_S} SELECT entity, season, round(coalesce(sum(value) OVER (PARTITION BY entity ORDER BY season RANGE BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0), 2) AS ahead FROM seasons")
def next_calendar_sum(spark, sf):
    return ordered.next_calendar_sum(seasons(spark, sf), "entity", "season", "value", 3, "ahead").select("entity", "season", F.round("ahead", 2).alias("ahead"))


@query(f"""{_S}, d AS (SELECT entity, season, round(value - 500000, 2) AS v FROM seasons), l AS (SELECT *, v <= 0 AND lead(v) OVER (PARTITION BY entity ORDER BY season) <= 0 AS both FROM d)
SELECT entity, coalesce(min(season) FILTER (WHERE both), arg_min(season, (abs(v), season))) AS at FROM l GROUP BY 1""".replace(" AS at FROM l", ' AS "at" FROM l').replace("AS both", 'AS "both"').replace("WHERE both", 'WHERE "both"'))
def first_sustained(spark, sf):
    d = seasons(spark, sf).select("entity", "season", F.round(F.col("value") - 500000, 2).alias("v"))
    return ordered.first_sustained(d, "entity", "season", "v", "at")


@query(f"{_S} SELECT entity, season, max(value) OVER (PARTITION BY entity ORDER BY season) AS upper FROM seasons")
def running_maximum(spark, sf):
    return ordered.monotone(seasons(spark, sf), ["entity"], "season", "value", "upper").select("entity", "season", "upper")


@query(f"{_S}, l AS (SELECT *, lag(value) OVER (PARTITION BY entity ORDER BY season) AS before FROM seasons) SELECT entity, season, before FROM l WHERE value < before")
def monotone_violations(spark, sf):
    return ordered.monotone_violations(seasons(spark, sf), ["entity"], "season", "value").select("entity", "season", "before")


@query(f"""{_S}, c AS (SELECT a.entity, a.season AS i, b.season AS j, sum(s.value * s.n) / sum(s.n) AS m FROM seasons a JOIN seasons b ON a.entity = b.entity AND a.season <= b.season JOIN seasons s ON s.entity = a.entity AND s.season BETWEEN a.season AND b.season GROUP BY 1, 2, 3),
t AS (SELECT c.entity, c.i, x.season AS k, min(c.m) AS lo FROM c JOIN seasons x ON x.entity = c.entity AND c.i <= x.season AND c.j >= x.season GROUP BY 1, 2, 3)
SELECT entity, k AS season, round(max(lo), 0) AS fitted FROM t GROUP BY 1, 2""")
def isotonic(spark, sf):
    out = ordered.isotonic(seasons(spark, sf).select("entity", "season", "value", "n"), ["entity"], "season", "value", "n", "fitted")
    return out.select("entity", "season", F.round("fitted", 0).alias("fitted"))


@query(f"""{_S}, e AS (SELECT DISTINCT entity, season AS edition FROM seasons), t AS (SELECT e.*, edition + 3 <= 2000 AS mature, CASE WHEN edition + 3 <= 2000 THEN round(coalesce((SELECT sum(value) FROM seasons s WHERE s.entity = e.entity AND s.season BETWEEN e.edition + 1 AND e.edition + 3), 0), 2) END AS target FROM e)
SELECT *, target >= 500000 AS "at_least_500000" FROM t""".replace("at_least_500000", "at_least_500000"))
def forward_target(spark, sf):
    s = seasons(spark, sf)
    out = ordered.forward_target(s.select("entity", F.col("season").alias("edition")), s, "entity", "edition", "season", "value", 3, 2000, (500000,))
    return out.withColumn("target", F.round("target", 2))


# --- survival ---------------------------------------------------------------------------

_SNAP = """snap AS (SELECT c_custkey AS entity, CAST(make_date(y, 12, 31) AS DATE) AS as_of, (SELECT CAST(min(o_orderdate) AS DATE) FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderdate > make_timestamp(y, 12, 31, 0, 0, 0.0)) AS event
 FROM customer CROSS JOIN (VALUES (1995), (1997), (1999)) t(y))"""


def _snapshots(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("entity"), F.col("o_orderdate").alias("at"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.explode(F.array(*[F.make_date(F.lit(y), F.lit(12), F.lit(31)) for y in (1995, 1997, 1999)])).alias("as_of"))
    first = c.join(o, "entity").filter(F.col("at") > F.col("as_of").cast("timestamp_ntz")).groupBy("entity", "as_of").agg(F.to_date(F.min("at")).alias("event"))
    return c.join(first, ["entity", "as_of"], "left")


def _label_sql(h):
    within = f"coalesce(CASE WHEN event <= DATE '2000-06-30' THEN event END <= CAST(as_of + INTERVAL {h} MONTH AS DATE), false)"
    seen = f"({within} OR CAST(as_of + INTERVAL {h} MONTH AS DATE) <= DATE '2000-06-30')"
    return f"{seen} AS observed_{h}m, CASE WHEN {seen} THEN {within} END AS event_{h}m"


@query(f"WITH {_SNAP} SELECT entity, as_of, " + ", ".join(_label_sql(h) for h in survival.HORIZONS) + " FROM snap")
def censored_labels(spark, sf):
    out = survival.censored_labels(_snapshots(spark, sf), "as_of", "event", F.lit("2000-06-30").cast("date"))
    return out.drop("event", "quarantine")


@query(f"""WITH {_SNAP}, k AS (SELECT entity, as_of, CASE WHEN event <= DATE '2000-06-30' THEN event END AS e, i AS interval_no, CAST(as_of + to_months(12 * (i - 1)) AS DATE) AS b, CAST(as_of + to_months(12 * i) AS DATE) AS f FROM snap CROSS JOIN (VALUES (1), (2), (3), (4), (5)) t(i))
SELECT entity, as_of, CAST(interval_no AS INTEGER) AS interval, CAST(coalesce(e <= f, false) AS INTEGER) AS event FROM k WHERE (e IS NULL OR e > b) AND (coalesce(e <= f, false) OR f <= DATE '2000-06-30')""")
def person_periods(spark, sf):
    return survival.person_periods(_snapshots(spark, sf), ["entity"], "as_of", "event", F.lit("2000-06-30").cast("date"))


@query(f"""{_S}, r AS (SELECT entity, season, value > 300000 AS y FROM seasons), f AS (SELECT * FROM (VALUES (1998), (1999), (2000)) t(fold)),
p AS (SELECT r.*, fold, CASE WHEN season = fold THEN 'test' WHEN season + 2 < fold THEN 'train' END AS part FROM r CROSS JOIN f), q AS (SELECT * FROM p WHERE part IS NOT NULL AND NOT (part = 'train' AND (entity, fold) IN (SELECT (entity, fold) FROM p WHERE part = 'test'))),
g AS (SELECT fold FROM (SELECT fold, part, count(*) AS n, count(*) FILTER (WHERE y) AS e FROM q GROUP BY 1, 2) WHERE n >= 100 AND e >= 20 AND e < n GROUP BY 1 HAVING count(*) = 2)
SELECT CAST(fold AS INTEGER) AS fold, part, entity, season FROM q WHERE fold IN (SELECT fold FROM g)""")
def expanding_folds(spark, sf):
    r = seasons(spark, sf).select("entity", "season", (F.col("value") > 300000).alias("y"))
    return survival.expanding_folds(r, "entity", "season", 2, "y", [1998, 1999, 2000], least_rows=100, least_events=20).select("fold", "part", "entity", "season")


@query(f"""{_S}, e AS (SELECT entity, max(season) AS "end" FROM seasons GROUP BY 1), g AS (SELECT "end", count(*) AS n FROM e GROUP BY 1), h AS (SELECT "end", (sum(n) OVER (ORDER BY "end") - n) / sum(n) OVER () AS before FROM g)
SELECT entity, e."end", CASE WHEN before < 0.6 THEN 'train' WHEN before < 0.8 THEN 'validate' ELSE 'test' END AS split FROM e JOIN h ON e."end" = h."end" """)
def chronological_split(spark, sf):
    return survival.chronological_split(seasons(spark, sf), "entity", "season")


@query(f"""{_S}, e AS (SELECT entity, min(season) AS y, max(value) > 600000 AS ev FROM seasons GROUP BY 1), g AS (SELECT y AS year, count(*) AS n, count(*) FILTER (WHERE ev) AS e FROM e GROUP BY 1),
h AS (SELECT year, coalesce(sum(n) OVER b, 0) AS before, sum(n) OVER a AS after, coalesce(sum(e) OVER b, 0) AS eb, sum(e) OVER a AS ea FROM g WINDOW b AS (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (ORDER BY year ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT year, CAST(before AS BIGINT) AS before, CAST(after AS BIGINT) AS after FROM h WHERE before >= 5 AND after >= 5 AND eb >= 1 AND ea >= 1 ORDER BY abs(before - after), year LIMIT 1""")
def balanced_cut(spark, sf):
    e = seasons(spark, sf).groupBy("entity").agg(F.min("season").alias("y"), (F.max("value") > 600000).alias("ev"))
    return survival.balanced_cut(e, "y", "ev")


# --- ranks ----------------------------------------------------------------------------------

_NAMED = {"balance": (("c_acctbal", "desc"), ("c_custkey", "asc")), "segment": (("c_mktsegment", "asc"), ("c_acctbal", "desc"), ("c_custkey", "asc"))}


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS rank FROM customer")
def ordinal_rank(spark, sf):
    return ranking.ranked(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ranking.ordering(*_NAMED["balance"])).select("c_custkey", "rank")


@query("SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment NULLS LAST, c_acctbal DESC NULLS LAST, c_custkey LIMIT 50 OFFSET 100")
def third_page(spark, sf):
    return ranking.page(table(spark, sf, "customer"), ranking.ordering(*_NAMED["segment"]), 3, 50).select("c_custkey", "c_mktsegment")


@query("SELECT c_mktsegment, c_custkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 3")
def top_three(spark, sf):
    return ranking.top_k(table(spark, sf, "customer"), ["c_mktsegment"], ranking.ordering(*_NAMED["balance"]), 3).select("c_mktsegment", "c_custkey", "rank")


@query("SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) WHERE rank <= ceil(n * 0.2)")
def top_fifth(spark, sf):
    return ranking.top_share(table(spark, sf, "customer"), ["c_mktsegment"], ranking.ordering(*_NAMED["balance"]), 0.2).select("c_mktsegment", "c_custkey")


@query("SELECT l.c_mktsegment, l.c_custkey, l.c_acctbal, 1 + count(r.c_custkey) AS rank FROM (SELECT * FROM customer WHERE c_acctbal < 0) l LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 20) r ON r.c_mktsegment = l.c_mktsegment AND r.c_acctbal >= l.c_acctbal GROUP BY 1, 2, 3")
def rank_among_reference(spark, sf):
    c = table(spark, sf, "customer")
    return ranking.rank_among(c.filter("c_acctbal < 0"), c.filter("c_nationkey < 20"), "c_acctbal", "c_custkey", ["c_mktsegment"])


@query("""WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER w AS rank, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey)), p AS (SELECT *, CASE WHEN n > 1 THEN 100.0 * (n - rank) / (n - 1) ELSE 100 END AS p FROM r)
SELECT c_custkey, round(p, 6) AS percentile, CASE WHEN p >= 99.9 THEN 'top 0.1%' WHEN p >= 99 THEN 'top 1%' WHEN p >= 95 THEN 'top 5%' WHEN p >= 90 THEN 'top 10%' WHEN p >= 75 THEN 'top 25%' ELSE 'rest' END AS band FROM p""")
def rank_percentiles(spark, sf):
    c = table(spark, sf, "customer")
    r = ranking.ranked(c, ranking.ordering(*_NAMED["balance"]), within=["c_mktsegment"]).join(c.groupBy("c_mktsegment").agg(F.count("*").alias("n")), "c_mktsegment")
    p = N.rank_percentile(F.col("rank"), F.col("n"))
    return r.withColumn("p", p).select("c_custkey", r6("p").alias("percentile"), ranking.tail_band(F.col("p")).alias("band"))


_SCALARS = """WITH t AS (SELECT c_custkey, c_acctbal AS b, (c_custkey % 1000) / 10.0 AS p, greatest(0.0, least(100.0, (c_custkey % 1000) / 10.0 + 5)) AS p2 FROM customer)
SELECT c_custkey, round(ln(least(greatest(p / 100, 1e-6), 1 - 1e-6) / (1 - least(greatest(p / 100, 1e-6), 1 - 1e-6))), 6) AS logit, round(1 / (1 + exp(-b / 5000)), 6) AS sigmoid,
 round(CASE WHEN p <= 0 THEN 0 WHEN p <= 5 THEN p * 4 WHEN p <= 20 THEN 20 + (p - 5) * 25 / 15 WHEN p <= 40 THEN 45 + (p - 20) WHEN p <= 60 THEN 65 + (p - 40) * 0.75 WHEN p <= 80 THEN 80 + (p - 60) * 0.6 ELSE 92 + (p - 80) * 0.4 END, 6) AS idx,
 CAST(floor(b * 10 + 0.5) / 10 AS DOUBLE) AS half_up, (c_custkey % 700) >= 60 AND (c_custkey % 600) >= 60 AND least((c_custkey % 700) / 600.0, (c_custkey % 600) / 540.0) >= 0.25 * greatest((c_custkey % 700) / 600.0, (c_custkey % 600) / 540.0) AS two_way,
 CASE WHEN p <= 19 THEN '<=19' WHEN p <= 21 THEN '20-21' WHEN p <= 25 THEN '22-25' ELSE '26+' END AS band, CAST(CAST(floor((c_custkey % 50) / 3) AS INTEGER) AS VARCHAR) || '.' || CAST((c_custkey % 50) % 3 AS VARCHAR) AS innings, round(100.0 * ((c_custkey % 90) - (c_custkey % 70)) / 90, 6) AS momentum FROM t"""


@query(_SCALARS)
def scalar_scores(spark, sf):
    k = F.col("c_custkey")
    t = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("b"), ((k % 1000) / 10.0).alias("p"))
    p, b = F.col("p"), F.col("b")
    return t.select(
        "c_custkey", r6(N.logit(p / 100)).alias("logit"), r6(N.sigmoid(b / 5000)).alias("sigmoid"), r6(N.piecewise(p)).alias("idx"), N.half_up(b, 1).alias("half_up"), N.two_way(k % 700, k % 600).alias("two_way"),
        N.band(p, (19, 21, 25), ("<=19", "20-21", "22-25", "26+")).alias("band"), N.outs_to_innings(k % 50).alias("innings"), r6(N.momentum(k % 90, k % 70, F.lit(90))).alias("momentum"),
    )


@query("SELECT o_orderkey, round(date_diff('day', DATE '1970-07-01', CAST(o_orderdate AS DATE)) / 365.2425, 4) AS age, CAST(year(o_orderdate) - CAST(month(o_orderdate) < 4 AS INT) AS INTEGER) AS season, CAST(CAST(o_orderdate AS DATE) + INTERVAL 18 MONTH AS DATE) AS horizon FROM orders")
def calendar(spark, sf):
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", N.age_years(F.lit("1970-07-01").cast("date"), d).alias("age"), N.season_of(d).alias("season"), F.add_months(d, 18).alias("horizon"))


# --- boards ---------------------------------------------------------------------------------


@query("SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice, string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS roles, count(DISTINCT o_orderstatus) > 1 AS several_roles FROM orders GROUP BY 1")
def canonical_entities(spark, sf):
    return board.canonical_entities(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", [F.col("o_totalprice"), F.col("o_orderkey")], ["o_orderkey", "o_totalprice"])


@query("""SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 2
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders WHERE o_orderstatus = 'F' GROUP BY 2""")
def facets(spark, sf):
    return board.facets(table(spark, sf, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})


@query("""WITH g AS (SELECT event_type, count(*) AS n, max(ts) AS last, count(DISTINCT user_id) AS users FROM events GROUP BY 1), r AS (SELECT event_type, CASE WHEN NOT n >= 1990 THEN 'few_rows' END AS a, CASE WHEN NOT users >= 150 THEN 'few_users' END AS b, CASE WHEN NOT last >= TIMESTAMP '2024-01-30 23:55:00' THEN 'stale' END AS c FROM g)
SELECT event_type, CASE WHEN coalesce(a, b, c) IS NULL THEN 'ok' ELSE 'degraded' END AS status, concat_ws(',', a, b, c) AS reasons FROM r""")
def completeness(spark, sf):
    g = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last"), F.countDistinct("user_id").alias("users"))
    return board.completeness(g, ["event_type"], {"few_rows": F.col("n") >= 1990, "few_users": F.col("users") >= 150, "stale": F.col("last") >= F.lit("2024-01-30 23:55:00").cast("timestamp_ntz")})


@query("SELECT l_orderkey, CAST(to_json(list({'l_linenumber': l_linenumber, 'l_partkey': l_partkey} ORDER BY l_linenumber, l_partkey)) AS VARCHAR) AS document FROM lineitem GROUP BY 1")
def ordered_documents(spark, sf):
    return board.document(["l_orderkey"], table(spark, sf, "lineitem"), "l_linenumber", ["l_partkey"])


# --- checks ------------------------------------------------------------------------------------


@query("""SELECT 'positive' AS rule, count(*) FILTER (WHERE NOT l_quantity > 5) AS n FROM lineitem UNION ALL SELECT 'flag', count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) FROM lineitem
UNION ALL SELECT 'unique:l_orderkey,l_linenumber', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def violations(spark, sf):
    return checks.violations(table(spark, sf, "lineitem"), {"positive": F.col("l_quantity") > 5, "flag": F.col("l_returnflag").isin("A", "N")}, ["l_orderkey", "l_linenumber"])


@query("""WITH a AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-15'), b AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-27')
SELECT 'rows' AS measure, (SELECT count(*) FROM a) AS before, (SELECT count(*) FROM b) AS after, (SELECT count(*) FROM b) >= ceil(0.8 * (SELECT count(*) FROM a)) AS ok
UNION ALL SELECT 'users', (SELECT count(DISTINCT user_id) FROM a), (SELECT count(DISTINCT user_id) FROM b), (SELECT count(DISTINCT user_id) FROM b) >= ceil(0.8 * (SELECT count(DISTINCT user_id) FROM a)) UNION ALL SELECT 'stamp', NULL, NULL, true""")
def retention_gate(spark, sf):
    e, t = table(spark, sf, "events"), lambda d: F.lit(d).cast("timestamp_ntz")
    a, b = e.filter(F.col("ts") < t("2024-01-15")), e.filter((F.col("ts") >= t("2024-01-15")) & (F.col("ts") < t("2024-01-27")))
    return checks.retention(a, b, {"rows": F.count("*"), "users": F.countDistinct("user_id")}, "ts")


@query("WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) SELECT count(*) FILTER (WHERE b.k IS NULL) AS left_only, count(*) FILTER (WHERE a.k IS NULL) AS right_only, count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS \"both\" FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k")
def one_sided_keys(spark, sf):
    return checks.one_sided(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k")), ["k"])


@query("SELECT 'rich' AS flag, count(*) FILTER (WHERE NOT c_acctbal > 0) AS excluded FROM customer UNION ALL SELECT 'nation', count(*) FILTER (WHERE NOT c_nationkey < 20) FROM customer UNION ALL SELECT 'all', count(*) FILTER (WHERE NOT (c_acctbal > 0 AND c_nationkey < 20)) FROM customer")
def exclusion_counts(spark, sf):
    return checks.exclusion_counts(table(spark, sf, "customer"), {"rich": F.col("c_acctbal") > 0, "nation": F.col("c_nationkey") < 20})


@query("""WITH m AS (SELECT o_orderkey AS k, count(*) AS c, CAST(sum(l_quantity) AS BIGINT) AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1), d AS (SELECT k, CASE WHEN k % 2 = 0 THEN c + 1 ELSE c END AS c, CASE WHEN k % 5 = 0 THEN b + 1 ELSE b END AS b FROM m),
l AS (SELECT l_orderkey AS k, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS b, min(l_linenumber - 1) AS lo, max(l_linenumber - 1) AS hi, count(DISTINCT l_linenumber) AS dn FROM lineitem GROUP BY 1),
e AS (SELECT d.k, concat_ws(',', CASE WHEN NOT coalesce(n = d.c, false) THEN 'count' END, CASE WHEN NOT coalesce(l.b = d.b, false) THEN 'bytes' END, CASE WHEN NOT coalesce(lo = 0 AND hi = n - 1 AND dn = n, false) THEN 'ordinals' END) AS errors FROM d LEFT JOIN l ON l.k = d.k) SELECT k, errors FROM e WHERE errors <> ''""")
def manifest_errors(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").cast("long").alias("bytes"), (F.col("l_linenumber") - 1).alias("ordinal"))
    m = l.groupBy("k").agg(F.count("*").alias("c"), F.sum("bytes").alias("b"))
    m = m.select("k", F.expr("case when k % 2 = 0 then c + 1 else c end").alias("member_count"), F.expr("case when k % 5 = 0 then b + 1 else b end").alias("total_bytes"))
    return checks.manifest_errors(m, l, "k")


@query("""WITH a AS (SELECT value FROM events WHERE ts < TIMESTAMP '2024-01-15'), b AS (SELECT value FROM events WHERE ts >= TIMESTAMP '2024-01-15'), q AS (SELECT quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM a),
x AS (SELECT CASE WHEN value IS NULL THEN -1 ELSE len(list_filter(e, lambda z: z < value)) END AS bucket, 1 AS side FROM a, q UNION ALL SELECT CASE WHEN value IS NULL THEN -1 ELSE len(list_filter(e, lambda z: z < value)) END, 2 FROM b, q),
s AS (SELECT CAST(bucket AS INTEGER) AS bucket, count(*) FILTER (WHERE side = 1) / (SELECT count(*) FROM a) AS reference, count(*) FILTER (WHERE side = 2) / (SELECT count(*) FROM b) AS now FROM x GROUP BY 1)
SELECT bucket, round(reference, 6) AS reference, round(now, 6) AS now, round((now - reference) * ln((now + 1e-6) / (reference + 1e-6)), 6) AS part FROM s""")
def stability_index(spark, sf):
    e, t = table(spark, sf, "events"), F.lit("2024-01-15").cast("timestamp_ntz")
    a = e.filter(F.col("ts") < t)
    out = checks.stability_index(a, e.filter(F.col("ts") >= t), "value", checks.decile_edges(a, "value"))
    return out.select("bucket", *[r6(c).alias(c) for c in ("reference", "now", "part")])


@query("WITH k AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01') SELECT round(avg(CAST(o_custkey NOT IN (SELECT o_custkey FROM k) AS INT)), 6) AS unseen, avg(CAST(o_custkey IS NULL AS INT)) AS missing FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
def unseen_categories(spark, sf):
    o, t = table(spark, sf, "orders"), F.lit("1996-01-01").cast("timestamp_ntz")
    return checks.unseen_share(o.filter(F.col("o_orderdate") < t), o.filter(F.col("o_orderdate") >= t), "o_custkey").select(r6("unseen").alias("unseen"), "missing")


# --- metrics -------------------------------------------------------------------------------------

_SCORED = "scored AS (SELECT d.doc_id, d.lang, least(1.0, round(log10(n_chars + 1) / 5, 3)) AS p, quality AS y FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"


def _scored(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return d.select("doc_id", "lang", F.least(F.lit(1.0), F.round(F.log10(F.col("n_chars") + 1) / 5, 3)).alias("p"), F.col("quality").alias("y"))


@query(f"WITH {_SCORED} SELECT lang, round(avg((p - y) * (p - y)), 6) AS brier, round(-avg(y * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - y) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6))), 6) AS log_loss FROM scored GROUP BY 1")
def proper_scores(spark, sf):
    p, y = F.col("p"), F.col("y")
    return _scored(spark, sf).groupBy("lang").agg(r6(metrics.brier(p, y)).alias("brier"), r6(metrics.log_loss(p, y)).alias("log_loss"))


@query(f"WITH {_SCORED}, w AS (SELECT a.lang, round(avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END), 6) AS auc FROM scored a JOIN scored b ON a.lang = b.lang AND a.y = 1 AND b.y = 0 GROUP BY 1) SELECT g.lang, w.auc FROM (SELECT DISTINCT lang FROM scored) g LEFT JOIN w ON w.lang = g.lang")
def roc_auc(spark, sf):
    return metrics.auc(_scored(spark, sf), ["lang"], "p", "y").select("lang", r6("auc").alias("auc"))


@query(f"WITH {_SCORED}, g AS (SELECT lang, p, sum(y) AS pos, count(*) AS n FROM scored GROUP BY 1, 2), w AS (SELECT *, sum(pos) OVER o / sum(n) OVER o AS precision FROM g WINDOW o AS (PARTITION BY lang ORDER BY p DESC)) SELECT lang, round(sum(pos * precision) / sum(pos), 6) AS ap FROM w GROUP BY 1")
def average_precision(spark, sf):
    return metrics.average_precision(_scored(spark, sf), ["lang"], "p", "y").select("lang", r6("ap").alias("ap"))


@query(f"WITH {_SCORED} SELECT lang, CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM scored GROUP BY 1, 2")
def reliability(spark, sf):
    return metrics.reliability(_scored(spark, sf), ["lang"], "p", "y").select("lang", "bin", "n", r6("mean_p").alias("mean_p"), r6("mean_y").alias("mean_y"))


@query(f"WITH {_SCORED}, b AS (SELECT lang, (p > 0.4)::INT + (p > 0.6)::INT + (p > 0.7)::INT AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM scored GROUP BY 1, 2) SELECT lang, round(sum(n * abs(mp - my)) / sum(n), 6) AS ece FROM b GROUP BY 1")
def calibration_error(spark, sf):
    t = metrics.reliability(_scored(spark, sf), ["lang"], "p", "y", edges=(0.4, 0.6, 0.7))
    return metrics.expected_calibration_error(t, ["lang"]).select("lang", r6("ece").alias("ece"))


@query(f"WITH {_SCORED}, r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY p DESC) AS rk, count(*) OVER (PARTITION BY lang) AS n FROM scored) SELECT lang, round(avg(y) FILTER (WHERE rk <= ceil(n * 0.1)) / avg(y), 6) AS lift FROM r GROUP BY 1")
def top_lift(spark, sf):
    return metrics.top_lift(_scored(spark, sf), ["lang"], "p", "y").select("lang", r6("lift").alias("lift"))


@query(f"{_S} SELECT season, round(avg(CAST(value BETWEEN 0.5 * b0 AND 1.5 * b0 AS INT)), 6) AS coverage, round(avg(abs(b0 - value)), 4) AS mae, round(median(b0), 4) AS median_width FROM (SELECT *, coalesce(a, b) AS b0 FROM seasons) GROUP BY 1")
def interval_quality(spark, sf):
    s = seasons(spark, sf).withColumn("mid", F.coalesce("a", "b")).withColumn("low", 0.5 * F.col("mid")).withColumn("high", 1.5 * F.col("mid"))
    out = s.groupBy("season").agg(*metrics.interval_quality("low", "mid", "high", "value"))
    return out.select("season", r6("coverage").alias("coverage"), F.round("mae", 4).alias("mae"), F.round("median_width", 4).alias("median_width"))


@query(f"{_S}, f AS (SELECT season, entity, CAST(value > 300000 AS INT) AS y FROM seasons), g AS (SELECT season, count(*) AS n, count(DISTINCT entity) FILTER (WHERE y = 1) AS event_entities, count(DISTINCT entity) FILTER (WHERE y = 0) AS other_entities FROM f GROUP BY 1) SELECT *, n >= 1000 AND event_entities >= 100 AND other_entities >= 100 AS sufficient FROM g")
def sufficient_cells(spark, sf):
    f = seasons(spark, sf).withColumn("y", (F.col("value") > 300000).cast("int"))
    return metrics.sufficient_cells(f, ["season"], "entity", "y", least_rows=1000)


@query(f"WITH {_SCORED}, c AS (SELECT lang, avg((p - y) * (p - y)) AS brier, avg(p) - avg(y) AS bias FROM scored GROUP BY 1), g AS (SELECT 'brier' AS gate, brier <= 0.2 AS ok FROM c UNION ALL SELECT 'bias', abs(bias) <= 0.2 FROM c) SELECT gate, count(*) FILTER (WHERE ok) AS passed, count(*) AS cells, count(*) FILTER (WHERE ok) >= 0.75 * count(*) AS ok FROM g GROUP BY 1")
def promotion_gates(spark, sf):
    c = _scored(spark, sf).groupBy("lang").agg(metrics.brier(F.col("p"), F.col("y")).alias("brier"), (F.avg("p") - F.avg("y")).alias("bias"))
    return metrics.promotion_gates(c, {"brier": F.col("brier") <= 0.2, "bias": F.abs("bias") <= 0.2})


@query()
def cluster_bootstrap(spark, sf):
    s = _scored(spark, sf)
    err = (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))
    return metrics.cluster_bootstrap(s, "doc_id", {"brier": (err, F.lit(1.0)), "rate": (F.col("y").cast("double"), F.lit(1.0))})


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def daily_counts(spark, sf):
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def tumbling_windows(spark, sf):
    from pitwise.streaming.flows import windowed

    return windowed(table(spark, sf, "events"), "ts", "6 hours", None, ["event_type"], "value").withColumn("total", F.round("total", 4))


@query("""WITH o AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM o)
SELECT min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, sid""")
def session_windows(spark, sf):
    from pitwise.streaming.flows import sessions

    return sessions(table(spark, sf, "events"), "ts", "12 hours", ["user_id"])
