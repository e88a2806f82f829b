"""Queries over audits, evaluation, publication and loose roster values."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitwise.functions import roster, text
from pitwise.operators import audits, evaluation, publication
from pitwise.plans.analysis import _SCORED, _scored, _segments
from pitwise.plans.catalog import SEASONS, query, r6, seasons, table

_S = f"WITH {SEASONS}"

# --- audits ------------------------------------------------------------------------------

_LABELS = """t AS (SELECT o_orderkey AS k, make_date(1992 + CAST(o_custkey % 5 AS INTEGER), 1, 1) AS as_of, CAST(o_orderdate AS DATE) AS day, ['observed_event', 'observed_non_event', 'right_censored', 'lost_to_coverage'][1 + o_orderkey % 4] AS state,
 CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS censored, CASE WHEN o_orderkey % 6 <> 0 THEN 12 * (1 + o_orderkey % 3) END AS h FROM orders)"""


@query(f"""WITH {_LABELS}, e AS (SELECT *, CASE WHEN state = 'observed_event' THEN day END AS event, CAST(as_of + to_months(CAST(h AS INTEGER)) AS DATE) AS f, state IN ('right_censored', 'lost_to_coverage') AS cut FROM t)
SELECT k, CASE WHEN day < as_of THEN 'followup_before_snapshot' WHEN event < as_of THEN 'event_before_snapshot' WHEN censored < as_of THEN 'censored_before_snapshot' WHEN cut AND censored IS DISTINCT FROM day THEN 'censoring_does_not_end_followup'
 WHEN h IS NOT NULL AND state = 'observed_event' AND event > f THEN 'event_after_horizon' WHEN h IS NOT NULL AND state = 'observed_non_event' AND day < f THEN 'non_event_not_mature' WHEN h IS NOT NULL AND cut AND censored >= f THEN 'censored_at_or_after_horizon' END AS violation FROM e""")
def outcome_label_violations(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    day, states = F.to_date("o_orderdate"), F.array(*[F.lit(s) for s in ("observed_event", "observed_non_event", "right_censored", "lost_to_coverage")])
    t = o.select(k.alias("k"), F.make_date((F.lit(1992) + F.col("o_custkey") % 5).cast("int"), F.lit(1), F.lit(1)).alias("as_of"), F.get(states, k % 4).alias("state"), day.alias("day"), F.when(k % 5 != 0, day).alias("censored"), F.when(k % 6 != 0, (k % 3 + 1) * 12).cast("int").alias("h"))
    c = F.col
    return t.select("k", audits.outcome_label_violation(c("as_of"), c("state"), F.when(c("state") == "observed_event", c("day")), c("censored"), c("day"), c("h")).alias("violation"))


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS f, CAST(l_receiptdate AS DATE) AS l, CAST(l_commitdate AS DATE) AS p, CASE WHEN l_shipdate < TIMESTAMP '1995-01-01' THEN 'train' ELSE 'test' END AS part FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN f < DATE '1993-01-01' THEN 'feature_before_partition' WHEN f >= DATE '1998-01-01' THEN 'feature_after_partition' WHEN part = 'train' AND l > DATE '1998-01-01' THEN 'label_not_available' WHEN f > p THEN 'feature_after_prediction' END AS violation FROM t"""
.replace("l_receiptdate", "l_shipdate").replace("CAST(l_commitdate AS DATE)", "CAST(l_shipdate AS DATE) + CAST(l_linenumber - 3 AS INTEGER)"))
def split_violations(spark, sf):
    l, d = table(spark, sf, "lineitem"), lambda x: F.lit(x).cast("date")
    ship = F.to_date("l_shipdate")
    part = F.when(ship < d("1995-01-01"), "train").otherwise("test")
    predicted = F.date_add(ship, (F.col("l_linenumber") - 3).cast("int"))
    return l.select("l_orderkey", "l_linenumber", audits.split_violation(ship, ship, part, d("1993-01-01"), d("1998-01-01"), predicted).alias("violation"))


@query("""WITH t AS (SELECT o_orderkey % 23 AS r, make_date(1992 + CAST(o_custkey % 5 AS INTEGER), 1, 1) AS a, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS e FROM orders),
b AS (SELECT *, CASE WHEN (e IS NOT NULL) <> (r = 1) THEN 'event' ELSE 'right_censored' END AS state, coalesce(e <= CAST(a + INTERVAL 24 MONTH AS DATE), false) AS within, CAST(a + INTERVAL 24 MONTH AS DATE) <= DATE '1997-06-30' AS done FROM t),
c AS (SELECT *, (within OR done) <> (r = 2) AS seen, CASE WHEN within OR done OR r = 3 THEN within <> (r = 4) END AS event FROM b)
SELECT 'no_landmark' AS rule, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'as_of_after_cutoff', count(*) FILTER (WHERE a > DATE '1997-06-30') FROM c UNION ALL SELECT 'event_outside_window', count(*) FILTER (WHERE e IS NOT NULL AND (e <= a OR e > DATE '1997-06-30')) FROM c
UNION ALL SELECT 'censor_state', count(*) FILTER (WHERE r = 1) FROM c UNION ALL SELECT 'observed_24m', count(*) FILTER (WHERE r = 2) FROM c UNION ALL SELECT 'event_24m', count(*) FILTER (WHERE CASE WHEN within OR done THEN r = 4 ELSE r = 3 END) FROM c""")
def label_semantics(spark, sf):
    o, k, cutoff = table(spark, sf, "orders"), F.col("o_orderkey"), F.lit("1997-06-30").cast("date")
    t = o.select((k % 23).alias("r"), F.make_date((F.lit(1992) + F.col("o_custkey") % 5).cast("int"), F.lit(1), F.lit(1)).alias("as_of"), F.when(k % 3 != 0, F.to_date("o_orderdate")).alias("event"))
    end = F.add_months("as_of", 24)
    within, done, r = F.coalesce(F.col("event") <= end, F.lit(False)), end <= cutoff, F.col("r")
    t = t.withColumn("state", F.when(F.col("event").isNotNull() != (r == 1), "event").otherwise("right_censored")).withColumn("observed_24m", (within | done) != (r == 2)).withColumn("event_24m", F.when(within | done | (r == 3), within != (r == 4)))
    return audits.label_semantics(t, "as_of", "event", "state", cutoff, (24,))


@query("WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer), j AS (SELECT a.k AS x, b.k AS y FROM a FULL JOIN b ON a.k = b.k) SELECT count(*) FILTER (WHERE y IS NULL) AS left_only, count(*) FILTER (WHERE x IS NULL) AS right_only, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS shared, count(*) FILTER (WHERE x IS NULL OR y IS NULL) = 0 AS equal, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) = 0 AS disjoint FROM j")
def set_differences(spark, sf):
    return audits.set_differences(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), "k")


_DRIFT = """x AS (SELECT year(o_orderdate) AS y, o_orderstatus AS role, CASE WHEN o_orderkey % 29 <> year(o_orderdate) % 7 THEN o_totalprice END AS price, o_orderpriority || CASE WHEN year(o_orderdate) > 1997 AND o_orderkey % 40 = 0 THEN ' new' ELSE '' END AS prio FROM orders),
t AS (SELECT * FROM x WHERE y <= 1996), e AS (SELECT * FROM x WHERE y >= 1997), r AS (SELECT DISTINCT role FROM t),
q AS (SELECT role, list_distinct(list_filter(quantile_cont(price, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]), lambda z: true)) AS q, min(price) AS lo, max(price) AS hi, count(*) AS n, avg(CAST(price IS NULL AS INT)) AS tm, avg(CAST(prio IS NULL AS INT)) AS tp FROM t GROUP BY 1),
i AS (SELECT role, list_sort(list_filter(q, lambda z: z > lo AND z < hi)) AS edges, n, tm, tp FROM q),
ta AS (SELECT t.role, CASE WHEN price IS NULL THEN -1 ELSE len(list_filter(edges, lambda z: z < price)) END AS bin, count(*) AS a FROM t JOIN i USING (role) GROUP BY 1, 2), ea AS (SELECT e.y, e.role, CASE WHEN price IS NULL THEN -1 ELSE len(list_filter(edges, lambda z: z < price)) END AS bin, count(*) AS b FROM e JOIN i USING (role) GROUP BY 1, 2, 3),
c AS (SELECT y, role, count(*) AS rows, avg(CAST(price IS NULL AS INT)) AS m, avg(CAST(prio IS NULL AS INT)) AS mp FROM e JOIN r USING (role) GROUP BY 1, 2), g AS (SELECT c.y, c.role, c.rows, i.n, len(edges) + 2 AS k, unnest(range(-1, CAST(len(edges) + 1 AS BIGINT))) AS bin FROM c JOIN i USING (role)),
s AS (SELECT g.y, g.role, (coalesce(a, 0) + 1e-6) / (n + 1e-6 * k) AS x, (coalesce(b, 0) + 1e-6) / (rows + 1e-6 * k) AS z FROM g LEFT JOIN ta ON ta.role = g.role AND ta.bin = g.bin LEFT JOIN ea ON ea.y = g.y AND ea.role = g.role AND ea.bin = g.bin),
p AS (SELECT y, role, sum((z - x) * ln(z / x)) AS psi FROM s GROUP BY 1, 2), u AS (SELECT y, e.role, avg(CAST(k.prio IS NULL AS INT)) AS unseen FROM e LEFT JOIN (SELECT DISTINCT role, prio FROM t) k ON k.role = e.role AND k.prio = e.prio GROUP BY 1, 2),
d AS (SELECT c.y, c.role, 'price' AS feature, rows, m AS missing, tm AS training_missing, NULL AS unseen, psi FROM c JOIN i USING (role) JOIN p USING (y, role) UNION ALL SELECT c.y, c.role, 'prio', rows, mp, tp, unseen, NULL FROM c JOIN i USING (role) JOIN u USING (y, role))"""


def _drift(spark, sf):
    o, k, y = table(spark, sf, "orders"), F.col("o_orderkey"), F.year("o_orderdate")
    x = o.select(y.alias("y"), F.col("o_orderstatus").alias("role"), F.when(k % 29 != y % 7, F.col("o_totalprice")).alias("price"), F.concat("o_orderpriority", F.when((y > 1997) & (k % 40 == 0), " new").otherwise("")).alias("prio"))
    return audits.drift_cells(x.filter("y <= 1996"), x.filter("y >= 1997"), "role", "y", ["price"], ["prio"])


@query(f"WITH {_DRIFT} SELECT CAST(y AS INTEGER) AS y, role, feature, rows, round(missing, 6) AS missing, round(training_missing, 6) AS training_missing, round(abs(missing - training_missing), 6) AS jump, round(unseen, 6) AS unseen, round(psi, 6) AS psi FROM d")
def drift_cells(spark, sf):
    return _drift(spark, sf).select("y", "role", "feature", "rows", *[r6(c).alias(c) for c in ("missing", "training_missing", "jump", "unseen", "psi")])


@query(f"""WITH {_DRIFT}, w AS (SELECT max(missing) AS missing, max(abs(missing - training_missing)) AS jump, coalesce(max(unseen), 0) AS unseen, coalesce(max(psi), 0) AS psi FROM d),
f AS (SELECT *, concat_ws(',', CASE WHEN missing > 0.05 THEN 'missing' END, CASE WHEN jump > 0.05 THEN 'jump' END, CASE WHEN unseen > 0.02 THEN 'unseen' END, CASE WHEN psi > 0.2 THEN 'psi' END) AS failed FROM w)
SELECT round(missing, 6) AS missing, round(jump, 6) AS jump, round(unseen, 6) AS unseen, round(psi, 6) AS psi, failed, CASE WHEN failed = '' THEN 'admission_pass' ELSE 'admission_pass_distribution_shift_promotion_blocked' END AS status, true AS score_allowed, failed = '' AS promotion_eligible FROM f""")
def admission(spark, sf):
    out = audits.admission(_drift(spark, sf), {"rows_are_there": F.min("rows") > 0})
    return out.select(*[r6(c).alias(c) for c in ("missing", "jump", "unseen", "psi")], "failed", "status", "score_allowed", "promotion_eligible")


_CELLS = f"{_SCORED}, c AS (SELECT s.lang AS role, d.source AS cell, count(*) AS n, avg((0.5 - y) * (0.5 - y) - (p - y) * (p - y)) AS gain FROM scored s JOIN documents d USING (doc_id) GROUP BY 1, 2)"


def _gains(spark, sf):
    s = _scored(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    p, y = F.col("p"), F.col("y")
    return s.withColumn("loss", (p - y) * (p - y)).withColumn("base", (0.5 - y) * (0.5 - y))


@query(f"WITH {_CELLS} SELECT role, count(*) AS groups, count(*) FILTER (WHERE n >= 5) AS sufficient_groups, round(avg(gain) FILTER (WHERE n >= 5), 6) AS estimate, coalesce(avg(gain) FILTER (WHERE n >= 5) >= 0, true) AS passed FROM c GROUP BY 1")
def subgroup_adjudication(spark, sf):
    cells = _gains(spark, sf).groupBy(F.col("lang").alias("role"), "source").agg(F.count("*").alias("n"), F.avg(F.col("base") - F.col("loss")).alias("gain"))
    out = audits.subgroup_adjudication(cells.withColumn("ok", F.col("n") >= 5), "role", "gain", "ok")
    return out.withColumn("estimate", r6("estimate"))


@query(f"WITH {_SCORED}, g AS (SELECT lang, doc_id % 3 = 0 AS cold, count(*) AS n, avg((0.5 - y) * (0.5 - y) - (p - y) * (p - y)) AS gain FROM scored GROUP BY 1, 2) SELECT lang, cold, n AS rows, round(gain, 6) AS improvement, n >= 20 AS sufficient, n < 20 OR gain >= -0.01 AS passed FROM g")
def cold_start_adjudication(spark, sf):
    s = _gains(spark, sf).withColumn("cold", F.col("doc_id") % 3 == 0)
    return audits.cold_start_adjudication(s, ["lang"], "cold", "loss", "base", least=20).withColumn("improvement", r6("improvement"))


@query("""WITH t AS (SELECT c_custkey % 400 AS name, CASE WHEN c_custkey % 10 = 0 THEN 'test' ELSE 'train' END AS part, CAST(c_acctbal > 5000 AS INT) AS label, c_nationkey = 3 AS stale FROM customer), n AS (SELECT name, bool_or(part = 'train') AS a, bool_or(part = 'test') AS b FROM t GROUP BY 1)
SELECT (SELECT count(*) FROM n WHERE a) AS train_names, (SELECT count(*) FROM n WHERE b) AS test_names, (SELECT count(*) FROM n WHERE a AND b) AS overlap, (SELECT round(avg(CAST(label = 0 AS INT)), 6) FROM t WHERE part = 'test') AS all_negative_accuracy, (SELECT count(*) FROM t WHERE label = 0 AND stale) AS stale_negatives, round((SELECT count(*) FROM n WHERE a AND b) / (SELECT count(*) FROM n WHERE b), 6) AS overlap_share""")
def split_leakage(spark, sf):
    k = F.col("c_custkey")
    t = table(spark, sf, "customer").select((k % 400).alias("name"), F.when(k % 10 == 0, "test").otherwise("train").alias("part"), (F.col("c_acctbal") > 5000).cast("int").alias("label"), (F.col("c_nationkey") == 3).alias("stale"))
    out = audits.split_leakage(t, "part", "name", "label", F.col("stale"))
    return out.withColumn("all_negative_accuracy", r6("all_negative_accuracy")).withColumn("overlap_share", r6("overlap_share"))


@query("WITH m AS (SELECT l_suppkey AS team, l_partkey % 25 AS org FROM lineitem), j AS (SELECT m.org, s_nationkey IS NULL OR s_nationkey = m.org AS fits FROM m LEFT JOIN supplier ON s_suppkey = team) SELECT org, count(*) FILTER (WHERE NOT fits) AS quarantined, count(*) AS members FROM j GROUP BY 1")
def quarantined_memberships(spark, sf):
    members = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("team"), (F.col("l_partkey") % 25).alias("org"))
    return audits.quarantine_stale(members, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("team"), "s_nationkey"), "team", "s_nationkey", "org")[1]


#: Objects whose values are of all kinds: numbers and booleans in strings, nulls, arrays and objects.
_MIXED = """CASE event_id % 9 WHEN 0 THEN props WHEN 1 THEN '{"k": "' || event_id || '", "user": ' || user_id || '}' WHEN 2 THEN '{"k": "true", "flag": true, "type": "' || event_type || '"}' WHEN 3 THEN '{"flag": null, "list": [' || user_id || ', "x"], "in": {"k": 1}}'
 WHEN 4 THEN '{"user": ' || user_id || '.5, "a b": false}' WHEN 5 THEN '[1, 2]' WHEN 6 THEN '{"list": "[1]", "in": "{}"}' WHEN 7 THEN '{"big": 12345678901234567890, "exp": 1e300}' ELSE '{}' END"""


@query(f"WITH d AS (SELECT CAST({_MIXED} AS JSON) AS doc FROM events), o AS (SELECT doc FROM d WHERE json_type(doc) = 'OBJECT'), f AS (SELECT unnest(json_keys(doc)) AS key, doc FROM o), k AS (SELECT key, list_sort(list(DISTINCT CASE json_type(doc -> key) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'number' END)) AS kinds FROM f GROUP BY 1), s AS (SELECT '[' || string_agg('[\"' || key || '\",' || CAST(to_json(kinds) AS VARCHAR) || ']', ',' ORDER BY key) || ']' AS shape FROM k) SELECT shape, sha256(shape) AS fingerprint FROM s")
def schema_fingerprint(spark, sf):
    return audits.schema_fingerprint(table(spark, sf, "events").select(F.expr(_MIXED).alias("doc")), "doc")


# --- evaluation ---------------------------------------------------------------------------

_EV = "r AS (SELECT o_orderkey AS id, o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS season, c_mktsegment AS segment, c_nationkey AS nation, CAST(o_orderpriority = '1-URGENT' AS INT) AS e FROM orders JOIN customer ON c_custkey = o_custkey)"


def _events(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("season"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("e"))
    return o.join(_segments(spark, sf), "entity")


@query(f"""WITH {_EV}, t AS (SELECT * FROM r WHERE season < 1997 AND (segment, nation % 3) NOT IN (('BUILDING', 0))), g AS (SELECT avg(e) AS a FROM t), x AS (SELECT segment, nation, (sum(e) + 20 * (SELECT a FROM g)) / (count(*) + 20) AS rate FROM t GROUP BY 1, 2), y AS (SELECT segment, (sum(e) + 20 * (SELECT a FROM g)) / (count(*) + 20) AS rate FROM t GROUP BY 1)
SELECT id, round(least(greatest(coalesce(x.rate, y.rate, (SELECT a FROM g)), 1e-6), 1 - 1e-6), 8) AS prior FROM r LEFT JOIN x ON x.segment = r.segment AND x.nation = r.nation LEFT JOIN y ON y.segment = r.segment""")
def smoothed_priors(spark, sf):
    r = _events(spark, sf)
    t, levels = r.filter((F.col("season") < 1997) & ~((F.col("segment") == "BUILDING") & (F.col("nation") % 3 == 0))), [["segment", "nation"], ["segment"]]
    return evaluation.with_prior(r, levels, evaluation.smoothed_priors(t, levels, "e"), "prior").select("id", F.round("prior", 8).alias("prior"))


_BRIDGE = """r AS (SELECT c_custkey AS id, c_mktsegment AS role, 20 + (c_custkey % 700) / 50.0 AS age, c_acctbal > 7000 AS hit, c_acctbal AS war FROM customer), a AS (SELECT DISTINCT role FROM r), g AS (SELECT role, avg(CAST(hit AS INT)) AS rate FROM r GROUP BY 1), p AS (SELECT role, unnest(range(16, 41)) AS point FROM a),
d AS (SELECT p.role, point, id, hit, war, abs(age - point) AS d, count(*) FILTER (WHERE abs(age - point) <= 1) OVER (PARTITION BY p.role, point) AS n, row_number() OVER (PARTITION BY p.role, point ORDER BY abs(age - point), id) AS k FROM p JOIN r ON r.role = p.role),
l AS (SELECT * FROM d WHERE CASE WHEN n >= 20 THEN d <= 1 ELSE k <= 100 END)"""


@query(f"""WITH {_BRIDGE} SELECT l.role, CAST(point AS INTEGER) AS point, round((sum(CAST(hit AS INT)) + 25 * any_value(rate)) / (count(*) + 25), 8) AS rate, count(*) AS rows, round(quantile_cont(war, 0.1), 3) AS war_q10, round(quantile_cont(war, 0.5), 3) AS war_q50, round(quantile_cont(war, 0.9), 3) AS war_q90 FROM l JOIN g ON g.role = l.role GROUP BY 1, 2""")
def debut_bridge(spark, sf):
    k = F.col("c_custkey")
    r = table(spark, sf, "customer").select(k.alias("id"), F.col("c_mktsegment").alias("role"), (20 + (k % 700) / 50.0).alias("age"), (F.col("c_acctbal") > 7000).cast("int").alias("hit"), F.col("c_acctbal").alias("war"))
    points = r.select("role").distinct().withColumn("point", F.explode(F.sequence(F.lit(16), F.lit(40))))
    out = evaluation.bridge(points, r, "role", "point", "age", "id", "hit", ["war"], (0.1, 0.5, 0.9))
    return out.select("role", "point", F.round("rate", 8).alias("rate"), "rows", *[F.round(f"war_q{q}", 3).alias(f"war_q{q}") for q in (10, 50, 90)])


_WEIGHTED = f"{_SCORED}, w AS (SELECT *, 1.0 + doc_id % 3 AS w FROM scored)"


@query(f"WITH {_WEIGHTED}, b AS (SELECT *, least(floor(sum(w) OVER (PARTITION BY lang ORDER BY p, doc_id) * 10 / sum(w) OVER (PARTITION BY lang) + 1e-12), 9) AS bin FROM w) SELECT lang, CAST(bin AS INTEGER) AS bin, count(*) AS n, sum(w) AS weight, round(sum(w * p) / sum(w), 6) AS mean_p, round(sum(w * y) / sum(w), 6) AS mean_y FROM b GROUP BY 1, 2")
def reliability_by_weight(spark, sf):
    s = _scored(spark, sf).withColumn("w", 1.0 + F.col("doc_id") % 3)
    out = evaluation.reliability_by_weight(s, ["lang"], "p", "y", "w", "doc_id")
    return out.select("lang", "bin", "n", "weight", r6("mean_p").alias("mean_p"), r6("mean_y").alias("mean_y"))


@query(f"""WITH {_SCORED}, e AS (SELECT lang, quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q, min(p) AS lo, max(p) AS hi, count(DISTINCT p) AS k FROM scored GROUP BY 1),
b AS (SELECT s.*, CASE WHEN k <= 10 THEN dense_rank() OVER (PARTITION BY lang ORDER BY p) - 1 ELSE len(list_distinct(list_filter(q, lambda z: z < p AND z > lo AND z < hi))) END AS bin FROM scored s JOIN e USING (lang)) SELECT lang, CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM b GROUP BY 1, 2""")
def reliability_by_quantile(spark, sf):
    return evaluation.reliability_by_quantile(_scored(spark, sf), ["lang"], "p", "y").select("lang", F.col("bin").cast("int").alias("bin"), "n", r6("mean_p").alias("mean_p"), r6("mean_y").alias("mean_y"))


@query(f"""WITH {_WEIGHTED}, c AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY lang ORDER BY p DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= 0.1 * sum(w) OVER (PARTITION BY lang) - 1e-12 AS top FROM w)
SELECT lang, count(*) FILTER (WHERE top) AS rows, round(sum(w * y) FILTER (WHERE top) / sum(w) FILTER (WHERE top), 6) AS rate, round((sum(w * y) FILTER (WHERE top) / sum(w) FILTER (WHERE top)) / nullif(sum(w * y) / sum(w), 0), 6) AS lift FROM c GROUP BY 1""")
def top_by_weight(spark, sf):
    s = _scored(spark, sf).withColumn("w", 1.0 + F.col("doc_id") % 3)
    return evaluation.top_by_weight(s, ["lang"], "p", "y", "w", "doc_id", 0.1).select("lang", "rows", r6("rate").alias("rate"), r6("lift").alias("lift"))


@query(f"WITH {_SCORED}, c AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY p DESC, doc_id) <= greatest(1, ceil(0.1 * count(*) OVER (PARTITION BY lang))) AS top FROM scored) SELECT lang, count(*) FILTER (WHERE top) AS rows, round(avg(y) FILTER (WHERE top), 6) AS rate, round(avg(y) FILTER (WHERE top) / nullif(avg(y), 0), 6) AS lift FROM c GROUP BY 1")
def top_by_count(spark, sf):
    return evaluation.top_by_count(_scored(spark, sf), ["lang"], "p", "y", "doc_id", 0.1).select("lang", "rows", r6("rate").alias("rate"), r6("lift").alias("lift"))


@query("WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) * 2 + (month(o_orderdate) > 6)::INT AS INTEGER) AS s FROM orders), k AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n FROM y), b AS (SELECT n, CASE WHEN n >= 15 THEN greatest(1, n - 11) ELSE greatest(1, floor(n * 0.6)) END AS c FROM k LIMIT 1), t AS (SELECT n, c, CASE WHEN n >= 15 THEN n - 5 ELSE greatest(c + 1, floor(n * 0.8)) END AS t FROM b) SELECT (SELECT s FROM k WHERE i = c) - 1 AS train_end, (SELECT s FROM k WHERE i = c) AS calibration_start, (SELECT s FROM k WHERE i = t) - 1 AS calibration_end, (SELECT s FROM k WHERE i = t) AS test_start, (SELECT max(s) FROM k) AS test_end FROM t WHERE n >= 9")
def origin_split(spark, sf):
    half = F.year("o_orderdate") * 2 + (F.month("o_orderdate") > 6).cast("int")
    return evaluation.origin_split(table(spark, sf, "orders").select(half.alias("season")), "season")


@query(f"""WITH {_EV}, f AS (SELECT r.*, fold, season = fold AS test FROM r JOIN (VALUES (1993), (1994), (1995), (1996), (1997), (1998)) t(fold) ON season <= fold), b AS (SELECT fold, avg(e) AS base, count(*) AS n FROM f WHERE NOT test GROUP BY 1),
s AS (SELECT f.fold, segment, nation, (sum(e) + 20 * any_value(base)) / (count(*) + 20) AS rate FROM f JOIN b USING (fold) WHERE NOT test GROUP BY 1, 2, 3), h AS (SELECT entity, min(season) AS first FROM r GROUP BY 1),
p AS (SELECT f.fold, n, base, e, h.first = f.season AS cold, coalesce(rate, base) AS p FROM f JOIN b USING (fold) JOIN h USING (entity) LEFT JOIN s ON s.fold = f.fold AND s.segment = f.segment AND s.nation = f.nation WHERE test)
SELECT CAST(fold AS INTEGER) AS fold, n AS train_rows, round(base, 6) AS base_rate, count(*) AS test_rows, count(*) FILTER (WHERE cold) AS cold, round(avg((p - e) * (p - e)), 6) AS brier, round(1 - avg((p - e) * (p - e)) / avg((base - e) * (base - e)), 6) AS skill FROM p GROUP BY 1, 2, 3 HAVING count(*) >= 100""")
def rolling_backtest(spark, sf):
    out = evaluation.rolling_backtest(_events(spark, sf), "season", "entity", "e", [["segment", "nation"]], [1992, 1993, 1994, 1995, 1996, 1997, 1998])
    return out.select("fold", "train_rows", r6("base_rate").alias("base_rate"), "test_rows", "cold", r6("brier").alias("brier"), r6("skill").alias("skill"))


@query(f"""{_S}, c AS (SELECT season - 1970 AS age, round(avg(value) / 100000 - 3 - (season - 1994) * 0.3, 6) AS change, round(0.95 - (season - 1992) * 0.02 + (season % 3) * 0.01, 6) AS going FROM seasons GROUP BY season), a AS (SELECT * FROM c WHERE age >= 23), n AS (SELECT median(change) AS m FROM a WHERE change < 0),
t AS (SELECT coalesce((SELECT m FROM n), median(change)) AS dt, max(age) AS last FROM a), d AS (SELECT coalesce((SELECT min(age) FROM a, t WHERE change <= dt AND age >= 25), least(last, 26)) AS d, dt, last FROM t), r AS (SELECT median(going) AS lr FROM a, d WHERE age >= d),
l AS (SELECT coalesce((SELECT min(age) FROM a, d, r WHERE age >= d AND going <= lr AND age >= d + 2), least(last, d + 3)) AS l FROM d)
SELECT CAST(23 AS BIGINT) AS prime_start, CAST(greatest(d, 25) AS BIGINT) AS decline_start, CAST(greatest(l, greatest(d, 25) + 2) AS BIGINT) AS late_start, round(dt, 6) AS decline_change, round(lr, 6) AS late_rate FROM d, r, l""")
def decline_boundaries(spark, sf):
    s = seasons(spark, sf).groupBy("season").agg(F.avg("value").alias("v"))
    x = F.col("season")
    c = s.select((x - 1970).alias("age"), F.round(F.col("v") / 100000 - 3 - (x - 1994) * 0.3, 6).alias("change"), F.round(0.95 - (x - 1992) * 0.02 + (x % 3) * 0.01, 6).alias("going"))
    out = evaluation.decline_boundaries(c, "age", "change", "going", F.lit(23))
    return out.select(*[F.col(n).cast("long").alias(n) for n in ("prime_start", "decline_start", "late_start")], r6("decline_change").alias("decline_change"), r6("late_rate").alias("late_rate"))


_BANK = """s0 AS (SELECT c_custkey AS id, c_mktsegment AS role, c_nationkey AS stage, round(c_acctbal, 2) AS a, round(c_acctbal / 3, 2) AS b, 1.0 + c_custkey % 4 AS w FROM customer), n AS (SELECT '0' AS bank, * FROM s0 UNION ALL SELECT '1/' || role, * FROM s0 UNION ALL SELECT '2/' || role || '/' || stage, * FROM s0 WHERE (role, stage) IN (SELECT (role, stage) FROM s0 GROUP BY role, stage HAVING count(DISTINCT id) >= 3)),
u AS (SELECT bank, a, b, sum(sum(w)) OVER (PARTITION BY bank ORDER BY a, b) / sum(sum(w)) OVER (PARTITION BY bank) AS hi FROM n GROUP BY bank, a, b), g AS (SELECT unnest(range(0, 40)) AS draw)"""


def _bank(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(k.alias("id"), F.col("c_mktsegment").alias("role"), F.col("c_nationkey").alias("stage"), F.round("c_acctbal", 2).alias("a"), F.round(F.col("c_acctbal") / 3, 2).alias("b"), (1.0 + k % 4).alias("w"))
    levels = [([], 1), (["role"], 1), (["role", "stage"], 3)]
    return rows, levels, evaluation.residual_bank(rows, "a", "b", "w", levels, "id", 40)


@query(f"WITH {_BANK}, m AS (SELECT bank, draw, min((a, b)) AS x FROM u JOIN g ON hi >= (draw + 0.5) / 40 - 1e-9 GROUP BY 1, 2) SELECT bank, draw, struct_extract(x, 1) AS first, struct_extract(x, 2) AS second FROM m")
def scenario_bank(spark, sf):
    return _bank(spark, sf)[2]


@query(f"""WITH {_BANK}, m AS (SELECT bank, draw, min((a, b)) AS x FROM u JOIN g ON hi >= (draw + 0.5) / 40 - 1e-9 GROUP BY 1, 2), k AS (SELECT DISTINCT bank FROM m),
r AS (SELECT id, CASE WHEN '2/' || role || '/' || stage IN (SELECT bank FROM k) THEN '2/' || role || '/' || stage ELSE '1/' || role END AS bank, a, 0.05 + (id % 10) / 20.0 AS p FROM s0), v AS (SELECT id, draw, p, a + struct_extract(x, 1) AS v FROM r JOIN m ON m.bank = r.bank),
h AS (SELECT *, count(*) FILTER (WHERE v >= 9000) OVER w AS hit, count(*) OVER w AS n, row_number() OVER (PARTITION BY id ORDER BY v DESC, draw) AS up, row_number() OVER (PARTITION BY id ORDER BY v, draw) AS down FROM v WINDOW w AS (PARTITION BY id)),
f AS (SELECT id, draw, p, v + CASE WHEN hit = 0 AND up = 1 THEN 9000 - v + 1e-6 WHEN hit = n AND down = 1 THEN 9000 - v - 1e-6 ELSE 0 END AS v FROM h), t AS (SELECT id, p, sum(CASE WHEN v >= 9000 THEN 1 ELSE 0 END) AS e FROM f GROUP BY 1, 2)
SELECT id, e AS elite, round(p, 6) AS tail FROM t""".replace("e AS elite", "CAST(e AS BIGINT) AS elite"))
def tilted_scenarios(spark, sf):
    rows, levels, bank = _bank(spark, sf)
    chosen = evaluation.chosen_bank(rows, bank, [keys for keys, _ in levels])
    s = chosen.join(bank, "bank").select("id", "draw", (F.col("a") + F.col("first")).alias("v"), F.lit(9000.0).alias("standard"), (0.05 + (F.col("id") % 10) / 20.0).alias("p"))
    t = evaluation.tilted_scenarios(s, "id", "v", "standard", "p")
    above = F.col("v") >= F.col("standard")
    return t.groupBy("id").agg(F.count_if(above).alias("elite"), r6(F.sum(F.when(above, F.col("weight")))).alias("tail"))


@query("""WITH t AS (SELECT c_custkey, c_acctbal > 0 AS a, CASE WHEN c_custkey % 9 <> 0 THEN c_nationkey < 12 END AS b, c_mktsegment <> 'BUILDING' AS c, c_acctbal > 8000 AS p FROM customer), w AS (SELECT *, a AND coalesce(b, false) AND c AS ok FROM t)
SELECT c_custkey, ok AS eligible, CASE WHEN ok AND p THEN 'priority' WHEN ok THEN 'watch' ELSE 'none' END AS tier, concat_ws(',', CASE WHEN NOT a THEN 'workload' END, CASE WHEN NOT coalesce(b, false) THEN 'young' END, CASE WHEN NOT c THEN 'supported' END) AS failed FROM w""")
def eligibility(spark, sf):
    c = F.col
    ok, tier, failed = evaluation.eligibility({"workload": c("c_acctbal") > 0, "young": F.when(c("c_custkey") % 9 != 0, c("c_nationkey") < 12), "supported": c("c_mktsegment") != "BUILDING"}, c("c_acctbal") > 8000)
    return table(spark, sf, "customer").select("c_custkey", ok.alias("eligible"), tier.alias("tier"), failed.alias("failed"))


# --- publication ---------------------------------------------------------------------------

_STATUSES = ("Active", "Rehab Assignment", "injured 10-Day", "INJURED list", "Development List", "On restricted list", "Military Leave", "Elsewhere")
_CENSUS = """m AS (SELECT l_orderkey AS id, l_partkey * 10 + l_linenumber AS team, l_suppkey % 5 AS org, CAST(l_shipdate AS DATE) AS known_at, CASE WHEN l_linenumber % 2 = 0 THEN 'affiliate' ELSE 'parent_census' END AS kind, l_returnflag AS role, ['AAA', 'AA', 'A+', 'A', 'Rk', 'DSL'][1 + l_partkey % 6] AS level,
 ['active', 'rehab', 'injured', 'injured', 'development', 'restricted', 'inactive', 'other'][1 + l_partkey % 8] AS status FROM lineitem),
p AS (SELECT *, (CASE kind WHEN 'affiliate' THEN 1 ELSE 2 END, CASE status WHEN 'rehab' THEN 1 WHEN 'active' THEN 2 WHEN 'development' THEN 3 WHEN 'injured' THEN 4 WHEN 'restricted' THEN 5 WHEN 'inactive' THEN 6 ELSE 7 END, -CASE level WHEN 'AAA' THEN 5 WHEN 'AA' THEN 4 WHEN 'A+' THEN 3 WHEN 'A' THEN 2 WHEN 'Rk' THEN 1 ELSE 0 END, team) AS place FROM m)"""


@query(f"""WITH {_CENSUS} SELECT id, arg_min(team, (-epoch(known_at), place)) AS team, arg_min(status, (-epoch(known_at), place)) AS status, arg_min(level, (-epoch(known_at), place)) AS level, count(*) AS memberships, count(*) FILTER (WHERE kind = 'affiliate') AS affiliate_memberships, count(DISTINCT role) AS roles, count(DISTINCT org) AS organizations,
 CAST(to_json(list({{'team': team, 'org': org, 'level': level, 'status': status, 'kind': kind}} ORDER BY place, org, level, status)) AS VARCHAR) AS memberships_json FROM p GROUP BY 1""")
def roster_census(spark, sf):
    l, k = table(spark, sf, "lineitem"), F.col("l_partkey")
    pick = lambda names: F.get(F.array(*[F.lit(n) for n in names]), k % len(names))
    m = l.select(
        F.col("l_orderkey").alias("id"), (k * 10 + F.col("l_linenumber")).alias("team"), (F.col("l_suppkey") % 5).alias("org"), F.to_date("l_shipdate").alias("known_at"), F.when(F.col("l_linenumber") % 2 == 0, "affiliate").otherwise("parent_census").alias("kind"),
        F.col("l_returnflag").alias("role"), pick(("AAA", "AA", "A+", "A", "Rk", "DSL")).alias("level"), publication.status_group(pick(_STATUSES)).alias("status"),
    )
    return publication.census(m, "id", "known_at", "kind", "status", "level", "team", "org", "role", ["team", "status", "level"])


_CAPTURES = """c AS (SELECT CAST(ts AS DATE) AS capture, min(ts) AS started_at, max(ts) AS captured_at, max(ts) FILTER (WHERE event_type = 'click') AS source_updated_at, count(DISTINCT event_type) AS endpoints FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events WHERE event_type IN ('click', 'view', 'purchase')))"""


def _captures(spark, sf):
    e = table(spark, sf, "events").withColumn("capture", F.to_date("ts"))
    return publication.complete_captures(e, "capture", "event_type", "ts", "ts", ("click", "view", "purchase"), "click")


@query(f"WITH {_CAPTURES} SELECT * FROM c")
def complete_captures(spark, sf):
    return _captures(spark, sf)


@query(f"WITH {_CAPTURES}, l AS (SELECT capture FROM c ORDER BY source_updated_at DESC NULLS LAST, captured_at DESC, capture DESC LIMIT 1), v AS (SELECT user_id, event_type, count(*) AS views, min(event_id) AS ordinal FROM events JOIN l ON CAST(ts AS DATE) = capture GROUP BY 1, 2) SELECT user_id, event_type, views, row_number() OVER (PARTITION BY event_type ORDER BY views DESC, ordinal, user_id) AS attention_rank FROM v")
def latest_attention(spark, sf):
    e = table(spark, sf, "events").withColumn("capture", F.to_date("ts"))
    last = publication.latest_capture(_captures(spark, sf), "capture").select("capture")
    views = e.join(F.broadcast(last), "capture").groupBy("user_id", "event_type").agg(F.count("*").alias("views"), F.min("event_id").alias("ordinal"))
    return publication.attention_ranks(views, ["event_type"], "views", "ordinal", "user_id").drop("ordinal")


@query("""WITH a AS (SELECT o_custkey AS id, max(o_orderdate) AS last_attempted_at, max(o_orderdate) + INTERVAL 90 DAY AS next_attempt_at, CASE WHEN count(*) % 3 = 0 THEN 'failed' ELSE 'retryable' END AS status FROM orders WHERE o_orderpriority < '2' GROUP BY 1)
SELECT c_custkey AS id, status, last_attempted_at FROM customer LEFT JOIN a ON a.id = c_custkey WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000) AND (status IS NULL OR (status = 'retryable' AND next_attempt_at <= TIMESTAMP '1999-01-01'))""")
def work_queue(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    last = F.max("o_orderdate")
    a = o.filter("o_orderpriority < '2'").groupBy(F.col("o_custkey").alias("id")).agg(last.alias("last_attempted_at"), (last + F.expr("interval 90 days")).alias("next_attempt_at"), F.when(F.count("*") % 3 == 0, "failed").otherwise("retryable").alias("status"))
    done = o.filter("o_totalprice > 490000").select(F.col("o_custkey").alias("id")).distinct()
    return publication.work_queue(c, done, a, "id", F.lit("1999-01-01").cast("timestamp_ntz"), [F.col("c_acctbal").desc_nulls_last(), F.col("id")]).select("id", "status", "last_attempted_at")


@query("SELECT count(DISTINCT o_custkey) AS entities, count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'F') AS finished, count(DISTINCT o_custkey) FILTER (WHERE o_totalprice > 300000) AS large, round(count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'F') / count(DISTINCT o_custkey), 4) AS finished_rate, round(count(DISTINCT o_custkey) FILTER (WHERE o_totalprice > 300000) / count(DISTINCT o_custkey), 4) AS large_rate FROM orders")
def coverage_summary(spark, sf):
    return publication.coverage_summary(table(spark, sf, "orders"), "o_custkey", {"finished": F.col("o_orderstatus") == "F", "large": F.col("o_totalprice") > 300000})


@query("SELECT c_custkey FROM customer WHERE c_name LIKE '%7%' AND c_acctbal <= 5000 ORDER BY c_acctbal DESC, c_custkey LIMIT 5")
def outside_filter(spark, sf):
    c = table(spark, sf, "customer")
    return publication.outside_filter(c, c.filter("c_acctbal > 5000"), "c_custkey", F.col("c_name").contains("7"), [F.col("c_acctbal").desc(), F.col("c_custkey")]).select("c_custkey")


@query("WITH r AS (SELECT p_partkey, p_brand, p_size AS rank FROM part), u AS (SELECT *, max(rank) OVER (PARTITION BY p_brand) AS universe FROM r) SELECT p_partkey, universe, round(CASE WHEN universe > 1 THEN 100.0 * (universe - rank) / (universe - 1) ELSE 100 END, 6) AS percentile FROM u")
def rank_universe(spark, sf):
    out = publication.rank_universe(table(spark, sf, "part").select("p_partkey", "p_brand", F.col("p_size").alias("rank")), "p_brand", "rank")
    return out.select("p_partkey", "universe", r6("percentile").alias("percentile"))


_BOARD = {"prospect_rank": "CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 97 END", "career_index": "CASE WHEN c_custkey % 5 <> 0 THEN round(c_acctbal / 100, 0) END", "outcome_rank": "c_custkey % 83", "stage_percentile": "CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 101 END", "alpha_rank": "CASE WHEN c_custkey % 6 = 0 THEN c_custkey % 61 END",
          "hof_probability": "c_custkey % 31", "near_term": "CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 29 END", "final_war": "c_acctbal", "arrival36": "c_custkey % 43", "dynasty_value": "CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 37 END", "dynasty_percentile": "c_custkey % 91", "dynasty_momentum": "c_custkey % 23 - 11", "gap": "CASE WHEN c_custkey % 8 <> 0 THEN c_custkey % 71 - 35 END", "age": "c_nationkey", "name": "c_name"}


def _places() -> str:
    order = lambda keys: ", ".join(f"{c} {way.upper()} NULLS LAST" for c, way in keys)
    ranks = ", ".join(f"row_number() OVER (ORDER BY {order(keys)}, id) AS \"{name}\"" for name, keys in publication.BOARD_ORDERS.items())
    return f"WITH b AS (SELECT c_custkey AS id, {', '.join(f'{e} AS {n}' for n, e in _BOARD.items())} FROM customer) SELECT id, {ranks} FROM b"


@query(_places())
def board_orders(spark, sf):
    from pitwise.operators.ranking import ranked

    b = table(spark, sf, "customer").selectExpr("c_custkey as id", *[f"{e} as {n}" for n, e in _BOARD.items()])
    out = b.select("id")
    for name in publication.BOARD_ORDERS:
        out = out.join(ranked(b, publication.board_order(name, "id"), name).select("id", name), "id")
    return out


@query("WITH t AS (SELECT p_partkey AS id, 2000 + p_size % 20 AS release_year, p_size % 2 = 0 AS actionable, p_partkey % 13 AS confidence, p_name AS release FROM part) SELECT id, row_number() OVER (ORDER BY release_year DESC, actionable DESC, confidence DESC, release, id) AS place FROM t")
def market_order(spark, sf):
    from pitwise.operators.ranking import ordering, ranked

    t = table(spark, sf, "part").selectExpr("p_partkey as id", "2000 + p_size % 20 as release_year", "p_size % 2 = 0 as actionable", "p_partkey % 13 as confidence", "p_name as release")
    return ranked(t, ordering(*publication.MARKET_ORDER, ("id", "asc")), "place").select("id", "place")


# --- loose roster values ---------------------------------------------------------------------

#: Codes made of the row's numbers and words, and some spelled ones, by remainder.
_CODES = (
    "'*' || p_size || 'H/D' || (p_partkey % 10)", "p_type", "'D/' || p_size % 4", "split_part(p_type, ' ', 1) || '/' || split_part(p_brand, '#', 2)", "CAST(p_size AS VARCHAR)", "p_size || '-' || p_brand", "'H' || p_size % 3", "NULL", "' c '", "'PITCHER'", "'Catcher'",
    "'Shortstop; 2'", "'Starter'", "'UTIL/SS'", "'7/LF'", "'H8/79'", "'9D/H'", "'D3/5H'", "'D/H'", "'*SS'", "'2B-SS'", "'relief-pitcher'", "'ReliefPitcher#'", "'P/OF'", "'OF'", "'lhp'", "'<na>'", "'1B, 3B'", "'Second base'", "'x/Dee'",
)
_CODE_OF = "CASE p_partkey % 30 " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(_CODES)) + " END"
_MARKS = "m(k, v) AS (VALUES ('1', 'P'), ('2', 'C'), ('3', '1B'), ('4', '2B'), ('5', '3B'), ('6', 'SS'), ('7', 'LF'), ('8', 'CF'), ('9', 'RF'), ('D', 'DH'), ('H', 'DH'))"
_NAMES = "w(k, v) AS (SELECT v, v FROM m UNION SELECT 'RP', 'RP' UNION VALUES ('CATCHER', 'C'), ('FIRST', '1B'), ('SECOND', '2B'), ('THIRD', '3B'), ('SHORTSTOP', 'SS'), ('LEFTFIELD', 'LF'), ('CENTERFIELD', 'CF'), ('RIGHTFIELD', 'RF'), ('DESIGNATEDHITTER', 'DH'), ('PITCHER', 'P'), ('STARTER', 'P'), ('STARTINGPITCHER', 'P'), ('RELIEVER', 'RP'), ('RELIEFPITCHER', 'RP'))"


@query(f"""WITH {_MARKS}, {_NAMES}, t AS (SELECT p_partkey, {_CODE_OF} AS x FROM part), n AS (SELECT p_partkey, upper(trim(coalesce(x, ''))) AS raw, replace(replace(upper(trim(coalesce(x, ''))), '*', ''), '#', '') AS bare FROM t),
c AS (SELECT *, regexp_replace(bare, '[\\s,/;-]+', '', 'g') AS code FROM n), k0 AS (SELECT p_partkey, regexp_replace(unnest(string_split_regex(bare, '[\\s,/;-]+')), '[^A-Z0-9]', '', 'g') AS tok, generate_subscripts(string_split_regex(bare, '[\\s,/;-]+'), 1) AS i FROM c),
k AS (SELECT p_partkey, arg_min(coalesce(w.v, f.v, l.v), i) AS v FROM k0 LEFT JOIN w ON w.k = tok LEFT JOIN m f ON f.k = tok LEFT JOIN m l ON l.k = left(tok, 1) WHERE coalesce(w.v, f.v, l.v) IS NOT NULL GROUP BY 1),
p AS (SELECT c.*, k.v AS walked, m.v AS fielded, code <> '' AND NOT regexp_matches(code, '[ABCEFGI-QS-Z]') AS compact FROM c LEFT JOIN k USING (p_partkey) LEFT JOIN m ON m.k = regexp_extract(code, '[2-9]'))
SELECT p_partkey, CASE WHEN raw IN ('', 'NAN', 'NONE', '<NA>') THEN 'UNKNOWN' WHEN raw IN ('C', '1B', '2B', '3B', 'SS', 'LF', 'CF', 'RF', 'DH', 'P', 'RP') THEN raw WHEN compact AND fielded IS NOT NULL THEN fielded WHEN compact AND contains(code, 'D') THEN 'DH' WHEN compact AND contains(code, '1') THEN 'P' WHEN compact AND contains(code, 'H') THEN 'DH' ELSE coalesce(walked, 'UNKNOWN') END AS position,
 CASE WHEN (list_contains(list_filter(string_split_regex(replace(raw, ' ', ''), '[/,;-]'), lambda z: z <> ''), 'P') OR replace(raw, ' ', '') IN ('LHP', 'RHP', 'SP', 'RP')) THEN CASE WHEN len(list_filter(string_split_regex(replace(raw, ' ', ''), '[/,;-]'), lambda z: z NOT IN ('', 'P', 'LHP', 'RHP', 'SP', 'RP'))) > 0 THEN 'two_way' ELSE 'pitcher' END ELSE 'hitter' END AS role FROM p""")
def positions(spark, sf):
    t = table(spark, sf, "part").withColumn("x", F.expr(_CODE_OF.replace("VARCHAR", "STRING")))
    return t.select("p_partkey", roster.position_code(F.col("x")).alias("position"), roster.role_of_positions(F.col("x")).alias("role"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN CAST(year(o_orderdate) AS DOUBLE) END AS year, CASE WHEN o_orderkey % 4 IN (0, 2) THEN CAST(1 + o_custkey % 30 AS DOUBLE) END AS round, CASE o_orderkey % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'international' WHEN 2 THEN 'draft' ELSE 'unknown' END AS acquisition FROM orders""")
def drafts(spark, sf):
    y, r, k = F.year("o_orderdate").cast("string"), (1 + F.col("o_custkey") % 30).cast("string"), F.col("o_orderkey") % 4
    text_ = F.when(k == 0, F.concat(y, F.lit(" Round "), r)).when(k == 1, F.concat(F.lit("J2 "), y)).when(k == 2, F.concat(F.lit("drafted "), y, F.lit(" rd"), r)).otherwise("")
    return table(spark, sf, "orders").select("o_orderkey", roster.draft(text_).alias("d")).select("o_orderkey", "d.year", "d.round", "d.acquisition")


@query("SELECT event_id, CASE WHEN ts < date_trunc('day', ts) + INTERVAL 510 MINUTE THEN date_trunc('day', ts) + INTERVAL 510 MINUTE WHEN ts < date_trunc('day', ts) + INTERVAL 1230 MINUTE THEN date_trunc('day', ts) + INTERVAL 1230 MINUTE ELSE date_trunc('day', ts) + INTERVAL 1950 MINUTE END AS next_run FROM events")
def next_runs(spark, sf):
    return table(spark, sf, "events").select("event_id", roster.next_scheduled(F.col("ts"), (1230, 510)).cast("timestamp_ntz").alias("next_run"))


@query("""SELECT event_type, max(ts) AS last_seen, round((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(max(ts))) / 3.6e9, 2) AS stale_hours, max(ts) < TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 26 HOUR AS alarm FROM events GROUP BY 1""")
def freshness(spark, sf):
    from pitwise.streaming.flows import freshness

    return freshness(table(spark, sf, "events"), ["event_type"], "ts", F.lit("2024-02-01").cast("timestamp_ntz"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(user_id AS VARCHAR) || ',null,' || CAST(user_id + 1 AS VARCHAR) WHEN 5 THEN '7' END AS history FROM events")
def histories(spark, sf):
    u, k = F.col("user_id").cast("string"), F.col("event_id") % 6
    doc = (
        F.when(k == 0, F.concat(F.lit("["), u, F.lit(",null,"), (F.col("user_id") + 1).cast("string"), F.lit("]"))).when(k == 1, "[]").when(k == 2, F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit("1"), 32), ","), F.lit("]")))
        .when(k == 3, "[1.5]").when(k == 4, "[-999999]").otherwise("[7]")
    )
    return table(spark, sf, "events").select("event_id", F.array_join(roster.valid_history(doc, -1000, 1_000_000), ",", "null").alias("history"))


@query("""WITH t AS (SELECT c_custkey AS id, (c_custkey * 7) % 101 AS a, (c_custkey * 13) % 101 AS b, (c_custkey * 29) % 101 AS c, (c_custkey * 3) % 101 AS d FROM customer), r AS (SELECT *, id % 5 <> 0 AS k1, id % 4 <> 0 AS k2 FROM t)
SELECT id, concat_ws(',', CASE WHEN k1 OR true THEN 'contact' END, CASE WHEN k2 THEN 'power' END, 'speed') AS covered, concat_ws(',', CASE WHEN greatest(a, CASE WHEN k1 THEN b ELSE -1 END) >= 80 THEN 'contact' END, CASE WHEN k2 AND c >= 80 THEN 'power' END, CASE WHEN d >= 80 THEN 'speed' END) AS strong,
 concat_ws(',', CASE WHEN k1 AND (b > a) THEN 'whiff' ELSE 'avg' END, CASE WHEN k2 THEN 'iso' END, 'sprint') AS strongest, k2 AS coverage_sufficient, (greatest(a, CASE WHEN k1 THEN b ELSE -1 END) >= 80)::INT + (k2 AND c >= 80)::INT + (d >= 80)::INT >= 2 AS multi_pillar, concat_ws(',', CASE WHEN NOT k2 THEN 'insufficient_pillar_coverage' END, CASE WHEN NOT k1 THEN 'unsupported_metric_source_excluded' END) AS warnings FROM r""")
def trait_evidence(spark, sf):
    k = F.col("c_custkey")
    m = lambda name, p, source: F.struct(name.alias("key") if not isinstance(name, str) else F.lit(name).alias("key"), p.cast("double").alias("percentile"), source.alias("source"))
    ours = F.lit("us")
    iso = m("iso", (k * 29) % 101, ours)
    metrics = F.array(m("AVG ", (k * 7) % 101, ours), m("whiff", (k * 13) % 101, F.when(k % 5 == 0, "them").otherwise("us")), iso, m("sprint", (k * 3) % 101, ours), m("other", k % 101, ours), F.when(k % 4 == 0, iso).otherwise(m("none", k % 101, ours)))
    out = roster.trait_evidence(metrics, {"contact": ("avg", "whiff"), "power": ("iso",), "speed": ("sprint",)}, "us")
    return table(spark, sf, "customer").select(k.alias("id"), out.alias("e")).select("id", "e.*")


#: Warnings of a forecast by the customer's number: registered ones, one that is not, the same twice, none.
_WARNINGS = (
    "two_way_target_not_preregistered_forecast_withheld", "partial_only_unvalidated_forecast_withheld", "broad_role_switch_target_not_supported_forecast_withheld", "current_role_transition_forecast_withheld", "synthetic_hall_standard_forecast_withheld",
    "bridge_debut_age_outside_supported_range_forecast_withheld", "bridge_debut_age_cell_missing_forecast_withheld", "young_elite_distribution_gate_failed_forecast_withheld", "stale_return_feature_state_forecast_withheld",
    "current_opportunity_unobserved_forecast_withheld", "research_only",
)
_NOTES = f"""nt(w, code) AS (VALUES ('{_WARNINGS[0]}', 'two_way_model_scope'), ('{_WARNINGS[1]}', 'rookie_model_pending'), ('{_WARNINGS[2]}', 'role_transition_model_scope'), ('{_WARNINGS[3]}', 'role_transition_model_scope'), ('{_WARNINGS[4]}', 'hall_standard_model_scope'), ('{_WARNINGS[5]}', 'debut_age_model_scope'),
 ('{_WARNINGS[6]}', 'debut_age_model_scope'), ('{_WARNINGS[7]}', 'young_elite_model_scope'), ('{_WARNINGS[8]}', 'stale_return_features'), ('{_WARNINGS[9]}', 'current_opportunity_missing')),
pr AS (SELECT unnest(l) AS code, generate_subscripts(l, 1) AS place FROM (SELECT ['two_way_model_scope', 'role_transition_model_scope', 'hall_standard_model_scope', 'debut_age_model_scope', 'post_debut_minor_assignment', 'young_elite_model_scope', 'rookie_model_pending', 'stale_return_features', 'current_opportunity_missing', 'rookie_prior_unmatched', 'identity_link_missing', 'forecast_not_available', 'forecast_withheld_other'] AS l))"""


@query(f"""WITH {_NOTES}, t AS (SELECT c_custkey AS id, ['pre_debut', 'post_debut_minors', 'recent_callup', 'active', 'inactive'][1 + c_custkey % 5] AS stage, ['Hitter', 'Two-way', 'Pitcher'][1 + c_custkey % 3] AS kind, c_custkey % 7 = 0 AS held, c_custkey % 11 <> 0 AS there, c_custkey % 13 = 0 AS gone, c_custkey % 17 = 0 AS idless,
 CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE list_slice({list(_WARNINGS)!r}, 1 + c_custkey % 12, 1 + c_custkey % 12 + c_nationkey % 3) || CASE WHEN c_nationkey % 4 = 0 THEN ['{_WARNINGS[3]}'] ELSE [] END END AS ws FROM customer),
w AS (SELECT id, code FROM (SELECT id, unnest(ws) AS w FROM t) JOIN nt USING (w)), g AS (SELECT t.*, EXISTS (SELECT 1 FROM w WHERE w.id = t.id) AS warned FROM t),
a AS (SELECT id, code FROM w UNION SELECT id, 'two_way_model_scope' FROM g WHERE kind = 'Two-way' UNION SELECT id, 'post_debut_minor_assignment' FROM g WHERE stage = 'post_debut_minors' UNION SELECT id, 'rookie_prior_unmatched' FROM g WHERE stage = 'recent_callup' AND gone UNION SELECT id, 'identity_link_missing' FROM g WHERE idless
 UNION SELECT id, 'forecast_withheld_other' FROM g WHERE held AND NOT warned AND kind <> 'Two-way' UNION SELECT id, 'forecast_not_available' FROM g WHERE NOT (held AND NOT warned AND kind <> 'Two-way') AND NOT there AND stage IN ('recent_callup', 'active'))
SELECT t.id, coalesce(string_agg(a.code, ',' ORDER BY place), '') AS codes FROM t LEFT JOIN a ON a.id = t.id LEFT JOIN pr ON pr.code = a.code GROUP BY 1""")
def handling_codes(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    pick = lambda names: F.get(F.array(*[F.lit(x) for x in names]), k % len(names))
    some = F.slice(F.array(*[F.lit(w) for w in _WARNINGS]), (1 + k % 12).cast("int"), (1 + n % 3).cast("int"))
    warnings = F.when(k % 11 != 0, F.concat(some, F.when(n % 4 == 0, F.array(F.lit(_WARNINGS[3]))).otherwise(F.array().cast("array<string>"))))
    codes = roster.handling_codes(pick(("pre_debut", "post_debut_minors", "recent_callup", "active", "inactive")), pick(("Hitter", "Two-way", "Pitcher")), k % 7 == 0, k % 11 != 0, warnings, k % 13 == 0, k % 17 == 0)
    return table(spark, sf, "customer").select(k.alias("id"), codes.alias("codes"))


@query("""WITH t AS (SELECT c_custkey AS id, 1 + c_custkey % 4 AS n, c_acctbal / 1000 AS v, CASE WHEN c_custkey % 6 <> 0 THEN (c_custkey % 11 - 5) / 5.0 END AS trend, (c_custkey % 10) / 10.0 AS p, 20 + c_custkey % 22 AS age FROM customer)
SELECT id, CASE WHEN n = 1 THEN CASE WHEN v >= 8 THEN 'breakout' WHEN v >= 3 THEN 'rising' ELSE 'uncertain' END WHEN p >= 0.5 AND v >= 6 AND trend > 0.2 THEN 'breakout' WHEN trend IS NULL THEN 'uncertain' WHEN trend > 0.2 THEN 'rising' WHEN trend < 0.0 THEN 'declining' WHEN v >= 4 THEN 'maintaining' ELSE 'plateau' END AS state,
 CASE WHEN n = 1 THEN 'launch' WHEN age < 25 THEN 'development' WHEN age < 31 THEN 'prime_plateau' WHEN age < 36 THEN 'decline' ELSE 'late_career' END AS chapter FROM t""")
def career_states(spark, sf):
    k = F.col("c_custkey")
    n, v, trend = 1 + k % 4, F.col("c_acctbal") / 1000, F.when(k % 6 != 0, (k % 11 - 5) / 5.0)
    state = roster.trajectory_state(n, v, trend, (k % 10) / 10.0, F.lit(0.1), 8.0, 3.0, 6.0, 4.0, 0.1)
    return table(spark, sf, "customer").select(k.alias("id"), state.alias("state"), roster.chapter(20 + k % 22, n, 25, 31, 36).alias("chapter"))


@query("WITH n AS (SELECT o_orderkey, o_orderpriority AS key, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS k, o_custkey FROM orders) SELECT o_orderkey, CASE WHEN k > 1 THEN CAST(o_custkey AS VARCHAR) || key || '#' || k ELSE CAST(o_custkey AS VARCHAR) || key END AS source_key FROM n")
def distinct_source_keys(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.col("o_custkey").cast("string"), "o_orderpriority").alias("key"))
    return text.distinct_keys(o, "key", [F.col("o_orderkey")], "source_key").select("o_orderkey", "source_key")





# --- joins, labels and scalars ------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = orders.o_custkey + 1 AND year(x.o_orderdate) = year(orders.o_orderdate) AND x.o_orderstatus = orders.o_orderstatus)")
def anti_join_by_several(spark, sf):
    o = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    other = o.select((F.col("o_custkey") - 1).alias("o_custkey"), "y", "o_orderstatus").distinct()
    return o.join(other, ["o_custkey", "y", "o_orderstatus"], "left_anti").select("o_orderkey")


@query("SELECT count(*) FILTER (WHERE c_custkey % 3 <> 0) AS added, count(*) FILTER (WHERE c_custkey % 3 = 0) AS removed FROM customer")
def removed_by_merge(spark, sf):
    from pitwise.operators.identity import removed_by_merge

    c = table(spark, sf, "customer").select("c_custkey")
    return removed_by_merge(c.filter("c_custkey % 3 = 0"), c, ["c_custkey"])


@query("""WITH t AS (SELECT c_custkey AS id, c_acctbal AS bal, c_custkey % 2 = 0 AS one, c_custkey % 3 = 0 AS two FROM customer)
SELECT id, CASE WHEN two AND id % 9 <> 0 THEN -2.0 WHEN one THEN -1.0 WHEN id % 5 <> 0 THEN bal END AS bal, CASE WHEN two THEN 'second' WHEN one THEN 'first' ELSE 'base' END AS origin FROM t WHERE one OR two OR id % 5 <> 0""")
def overlay_chain(spark, sf):
    from pitwise.operators.identity import overlay_chain

    c, k = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal")), F.col("id")
    second = c.filter("id % 3 = 0").select("id", F.when(k % 9 != 0, -2.0).alias("bal"))
    return overlay_chain(c.filter("id % 5 <> 0"), [("first", c.filter("id % 2 = 0").select("id", F.lit(-1.0).alias("bal"))), ("second", second)], ["id"], ["bal"])


@query("""WITH t AS (SELECT o_custkey AS id, o_orderstatus AS role, o_orderkey % 800 AS pa, (o_orderkey * 7) % 700 AS outs, o_totalprice AS price, o_orderkey AS k FROM orders), g AS (SELECT id, arg_max(role, (price, k)) AS best, arg_max(k, (price, k)) AS k, count(DISTINCT role) AS n, max(pa) AS pa, max(outs) AS outs FROM t GROUP BY 1)
SELECT id, CASE WHEN n > 1 AND pa >= 60 AND outs >= 60 AND least(pa / 600.0, outs / 540.0) >= 0.25 * greatest(pa / 600.0, outs / 540.0) THEN 'Two-way' ELSE best END AS role, k, pa, outs FROM g""")
def canonical_two_way(spark, sf):
    from pitwise.operators.board import canonical_two_way

    k = F.col("o_orderkey")
    t = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("role"), (k % 800).alias("pa"), ((k * 7) % 700).alias("outs"), F.col("o_totalprice").alias("price"), k.alias("k"))
    return canonical_two_way(t, "id", "role", "pa", "outs", [F.col("price"), F.col("k")], ["k"])


@query("WITH t AS (SELECT o_custkey % 50 AS team, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE o_orderpriority END AS label, o_orderkey AS k FROM orders) SELECT team, coalesce(arg_min(label, k) FILTER (WHERE coalesce(label, '') <> ''), CAST(team AS VARCHAR)) AS label, count(*) AS n FROM t GROUP BY 1")
def labelled_facets(spark, sf):
    from pitwise.operators.board import labelled_facets

    k = F.col("o_orderkey")
    t = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("team"), F.when(k % 3 == 1, "").when(k % 3 == 2, F.col("o_orderpriority")).alias("label"), k.alias("k"))
    return labelled_facets(t, "team", "label", F.col("k"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'not_json' WHEN 1 THEN 'identity:kind' WHEN 2 THEN 'identity:user' END AS violation, CASE WHEN event_id % 4 = 3 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")
def slice_envelopes(spark, sf):
    from pitwise.sources.readers import envelope

    r, u = F.col("event_id") % 4, F.col("user_id")
    doc = F.when(r == 0, "{not json").otherwise(F.concat(F.lit('{"kind": "'), F.when(r == 1, "other").otherwise(F.col("event_type")), F.lit('", "user": '), F.when(r == 2, u + 1).otherwise(u).cast("string"), F.lit(', "props": '), F.col("props"), F.lit("}")))
    e = table(spark, sf, "events").select("event_id", envelope(doc, "kind string, user bigint, props struct<k:bigint>", {"kind": F.col("event_type"), "user": u}).alias("e"))
    return e.select("event_id", "e.violation", F.col("e.value.props.k").alias("k"))


@query(f"""{_S}, w AS (SELECT entity, season, row_number() OVER p AS number, round(sum(value) OVER p, 2) AS so_far, sum(value) OVER (PARTITION BY entity) AS total, max(season) OVER (PARTITION BY entity) AS last, lead(season) OVER p AS nxt, lead(value) OVER p AS nv FROM seasons WINDOW p AS (PARTITION BY entity ORDER BY season))
SELECT entity, season, CAST(number AS INTEGER) AS number, so_far, CASE WHEN last <= 1998 THEN round(total - so_far, 2) END AS remaining, CASE WHEN nxt = season + 1 THEN nv END AS next_value FROM w""")
def career_landmarks(spark, sf):
    from pitwise.operators.ordered import prefix_features, remaining
    from pitwise.operators.temporal import next_if_adjacent

    s = seasons(spark, sf)
    features = prefix_features(s, "entity", "season", "value", peak=3).select("entity", "season", F.col("seasons_so_far").alias("number"), F.round("total_so_far", 2).alias("so_far"))
    labels = next_if_adjacent(remaining(s, "entity", "season", "value", 2001), "entity", "season", "value", "next_value").select("entity", "season", F.round("remaining", 2).alias("remaining"), "next_value")
    return features.join(labels, ["entity", "season"])


def _index(x: str) -> str:
    return f"CASE WHEN {x} <= 5 THEN {x} * 4 WHEN {x} <= 20 THEN 20 + ({x} - 5) * 25 / 15 WHEN {x} <= 40 THEN 45 + ({x} - 20) WHEN {x} <= 60 THEN 65 + ({x} - 40) * 0.75 WHEN {x} <= 80 THEN 80 + ({x} - 60) * 0.6 ELSE 92 + ({x} - 80) * 0.4 END"


@query(f"""WITH t AS (SELECT c_custkey AS id, (c_custkey % 60) * 1.0 AS a, (c_custkey % 80) * 1.0 AS b, (c_custkey % 100) * 1.0 AS c, c_acctbal AS m FROM customer)
SELECT id, CASE WHEN a <= b AND b <= c THEN floor((0.5 * ({_index('a')}) + 0.3 * ({_index('b')}) + 0.2 * ({_index('c')})) * 10 + 0.5) / 10 END AS level, round_even((id % 40) / 4.0, 0) AS half_even, CASE WHEN id % 3 = 0 THEN NULL ELSE m END AS finite, CASE WHEN (id % 10) / 10.0 >= 0.4 THEN 'first' ELSE 'second' END AS starter,
 id * 1000.0 AS cell, CASE WHEN c >= 90 AND b >= 90 THEN 'bothTop10' WHEN c - b >= 10 THEN 'oracleAhead' WHEN c - b <= -10 THEN 'crowdAhead' ELSE 'none' END AS signal FROM t""")
def board_scalars(spark, sf):
    from pitwise.functions import numbers, safe
    from pitwise.operators.ordered import role_by_share
    from pitwise.sources.readers import cell_number

    k = F.col("c_custkey")
    a, b, c = ((k % n).cast("double") for n in (60, 80, 100))
    loose = F.when(k % 6 == 0, "inf").when(k % 3 == 0, "NaN").otherwise(F.col("c_acctbal").cast("string"))
    cell = F.when(k >= 1, F.concat(k.cast("string"), F.lit(",000"))).otherwise("0")
    starter = role_by_share((k % 10).cast("double"), (10 - k % 10).cast("double"))
    return table(spark, sf, "customer").select(
        k.alias("id"), numbers.level_index(a, b, c).alias("level"), numbers.half_even((k % 40) / 4.0).alias("half_even"), safe.finite_or_null(loose).alias("finite"), starter.alias("starter"), cell_number(cell).alias("cell"), numbers.board_signal(c, b).alias("signal"),
    )
