"""Queries over the point-in-time core: revisions, cohorts, joins, guarded values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitwise.functions import numbers as N
from pitwise.functions import safe as S
from pitwise.functions import text as X
from pitwise.operators import cohorts, identity, temporal
from pitwise.plans.catalog import SEASONS, query, r6, seasons, table
from pitwise.sources import readers, sinks
from pitwise.sources.scratch import cut

_LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1)"""


@query(f"""WITH {_LATEST}, s AS (SELECT user_id, event_type, sum(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS k FROM latest GROUP BY 1, 2)
SELECT user_id, event_type, k, count(k) OVER (PARTITION BY event_type) AS peers,
 CASE WHEN count(k) OVER (PARTITION BY event_type) >= 25 THEN round(100 * percent_rank() OVER (PARTITION BY event_type ORDER BY k), 6) END AS standing FROM s""")
def latest_standing(spark, sf):
    last = temporal.latest_revision(table(spark, sf, "events"), ["user_id", "event_type"], "ts", "event_id")
    s = last.groupBy("user_id", "event_type").agg(F.sum(S.json_number(F.col("props"), "$.k")).alias("k"))
    return cohorts.cohort_percent_rank(s, ["event_type"], "k", "standing").select("user_id", "event_type", "k", "peers", "standing")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts <= TIMESTAMP '2024-01-15') WHERE rn = 1")
def as_of_view(spark, sf):
    v = temporal.as_of_view(table(spark, sf, "events"), ["user_id", "event_type"], F.lit("2024-01-15").cast("timestamp"), "ts", "event_id")
    return v.select("user_id", "event_type", "event_id", "value")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def best_row(spark, sf):
    return temporal.best_row(table(spark, sf, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], ["event_id", "event_type"])


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders), s AS (SELECT o_custkey, o_orderkey AS k2, o_orderdate AS t2, o_totalprice AS p2 FROM orders WHERE o_orderstatus = 'F'),
m AS (SELECT o.o_orderkey, s.k2, s.p2, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY s.t2 DESC, s.k2 DESC) AS rn FROM o LEFT JOIN s ON o.o_custkey = s.o_custkey AND s.t2 <= o.o_orderdate)
SELECT o_orderkey, k2 AS prior_key, p2 AS prior_price FROM m WHERE rn = 1""")
def as_of_join(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    s = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("prior_key"), F.col("o_orderdate").alias("t2"), F.col("o_totalprice").alias("prior_price"))
    j = temporal.as_of_join(o, s, ["o_custkey"], "o_orderdate", "t2", ["prior_key", "prior_price"], ["o_orderkey"], tie="prior_key")
    return j.select("o_orderkey", "prior_key", "prior_price")


@query(f"""WITH {SEASONS}, p AS (SELECT DISTINCT entity, season FROM seasons WHERE season <= 1999)
SELECT p.entity, p.season, round(coalesce(sum(s.value), 0), 2) AS ahead FROM p LEFT JOIN seasons s ON s.entity = p.entity AND s.season BETWEEN p.season + 1 AND p.season + 2 GROUP BY 1, 2""")
def range_join_sum(spark, sf):
    s = seasons(spark, sf)
    left = s.filter("season <= 1999").select("entity", "season").distinct()
    right = s.select("entity", F.col("season").alias("at"), "value")
    out = temporal.range_join_sum(left, right, ["entity"], F.col("season") + 1, F.col("season") + 2, "at", "value", ["entity", "season"], "ahead")
    return out.withColumn("ahead", F.round("ahead", 2))


@query("""WITH v AS (SELECT o_custkey, o_orderkey AS vid, o_orderdate AS begin_at, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS end_at FROM orders),
e AS (SELECT event_id, user_id AS o_custkey, ts - INTERVAL 9 YEAR + INTERVAL 5 YEAR AS moment FROM events)
SELECT event_id, vid FROM e JOIN v USING (o_custkey) WHERE begin_at <= moment AND (end_at IS NULL OR moment < end_at)""")
def valid_at(spark, sf):
    v = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("vid"), F.col("o_orderdate").alias("begin_at"), F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("end_at"))
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("o_custkey"), F.expr("ts - interval 9 years + interval 5 years").alias("at"))
    return temporal.valid_at(e, v, ["o_custkey"], "at", "begin_at", "end_at").select("event_id", "vid")


@query(f"WITH {SEASONS} SELECT entity, season, CASE WHEN lead(season) OVER w = season + 1 THEN lead(value) OVER w END AS next_value FROM seasons WINDOW w AS (PARTITION BY entity ORDER BY season)")
def next_if_adjacent(spark, sf):
    return temporal.next_if_adjacent(seasons(spark, sf), "entity", "season", "value", "next_value").select("entity", "season", "next_value")


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(DISTINCT event_type) AS members FROM events GROUP BY 1, 2 HAVING count(DISTINCT event_type) = 3")
def complete_cohorts(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return cohorts.complete_cohorts(e, ["user_id", "day"], "event_type", 3)


@query("""WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events), d AS (SELECT day FROM e GROUP BY 1 HAVING count(DISTINCT event_type) = 5), l AS (SELECT max(day) AS day FROM d)
SELECT event_id, user_id, e.day FROM e JOIN l ON e.day = l.day""")
def latest_complete_cohort(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return cohorts.latest_complete_cohort(e, [], "day", "event_type", 5).select("event_id", "user_id", "day")


@query("""WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events), d AS (SELECT user_id, day FROM e GROUP BY 1, 2 HAVING count(DISTINCT event_type) = 3), l AS (SELECT user_id, max(day) AS day FROM d GROUP BY 1)
SELECT event_id, e.user_id, e.day FROM e JOIN l ON e.user_id = l.user_id AND e.day = l.day""")
def latest_complete_cohort_by_user(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return cohorts.latest_complete_cohort(e, ["user_id"], "day", "event_type", 3).select("event_id", "user_id", "day")


@query(f"""WITH {SEASONS}, g AS (SELECT s.*, c_mktsegment AS cohort FROM seasons s JOIN customer ON c_custkey = entity), t AS (SELECT cohort, season, entity, n, sum(n) OVER (PARTITION BY cohort, season ORDER BY value) AS le, sum(n) OVER (PARTITION BY cohort, season, value) AS tied, sum(n) OVER (PARTITION BY cohort, season) AS total FROM g)
SELECT cohort, season, entity, round(100 * (le - tied / 2.0) / total, 6) AS percentile FROM t""")
def mid_rank_percentile(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("cohort"))
    g = seasons(spark, sf).join(c, "entity")
    out = cohorts.mid_rank_percentile(g, ["cohort", "season"], "value", F.col("n"), "percentile")
    return out.select("cohort", "season", "entity", r6("percentile").alias("percentile"))


_ADAPT = f"""WITH {SEASONS}, b AS (SELECT entity, min(season) AS born FROM seasons GROUP BY 1), p AS (SELECT s.entity, s.season, s.season - b.born AS age, s.value, c_mktsegment AS cohort FROM seasons s JOIN b USING (entity) JOIN customer ON c_custkey = s.entity),
t AS (SELECT * FROM p WHERE season = 1999),
m AS (SELECT t.cohort, t.entity, t.season, t.age, t.value, p.entity AS peer, abs(p.age - t.age) AS gap, CASE WHEN p.value < t.value THEN 1.0 WHEN p.value = t.value THEN 0.5 ELSE 0 END AS score
 FROM t JOIN p ON p.cohort = t.cohort AND p.season < t.season AND p.entity <> t.entity AND abs(p.age - t.age) <= 3),
w AS (SELECT unnest([0, 1, 2, 3]) AS w), f AS (SELECT cohort, entity, season, age, value, w, count(DISTINCT peer) AS n, 100 * sum(score) / count(*) AS pct FROM m JOIN w ON gap <= w GROUP BY ALL),
c AS (SELECT cohort, entity, season, min(w) AS w FROM f WHERE n >= 220 GROUP BY ALL)
SELECT t.cohort, t.entity, t.age, CAST(c.w AS INTEGER) AS "window", round(f.pct, 6) AS percentile FROM t LEFT JOIN c ON c.entity = t.entity LEFT JOIN f ON f.entity = c.entity AND f.w = c.w"""


_ADAPT_ALL = (
    _ADAPT.replace(" WHERE season = 1999", "")
    .replace("f AS (SELECT cohort, entity, season, age, value, w, count(DISTINCT peer) AS n, 100 * sum(score) / count(*) AS pct FROM m JOIN w ON gap <= w GROUP BY ALL)",
             "g AS (SELECT cohort, entity, season, age, value, w, peer, avg(score) AS share FROM m JOIN w ON gap <= w GROUP BY ALL), f AS (SELECT cohort, entity, season, age, value, w, count(*) AS n, 100 * avg(share) AS pct FROM g GROUP BY ALL)")
    .replace("n >= 220", "n >= 20")
    .replace("SELECT t.cohort, t.entity, t.age", "SELECT t.cohort, t.entity, t.season, t.age")
    .replace("c.entity = t.entity LEFT JOIN f ON f.entity = c.entity AND f.w", "c.entity = t.entity AND c.season = t.season LEFT JOIN f ON f.entity = c.entity AND f.season = c.season AND f.w")
)


@query(_ADAPT_ALL)
def adaptive_window_percentile(spark, sf):
    s = seasons(spark, sf)
    born = s.groupBy("entity").agg(F.min("season").alias("born"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("cohort"))
    p = s.join(born, "entity").join(c, "entity").select("entity", "season", (F.col("season") - F.col("born")).alias("age"), "value", "cohort")
    p = cut(p, "standings")
    out = cohorts.adaptive_window_percentile(p, p, ["cohort"], "age", "value", "entity", "season", least=20)
    return out.select("cohort", "entity", "season", "age", "window", r6("percentile").alias("percentile"))


@query(r"""SELECT event_id, json_extract_string(props, '$.k') AS k_text, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_number, CASE WHEN regexp_matches(event_type, '^[0-9]+$') THEN 1 END AS digits,
 CASE WHEN event_type NOT IN ('click', 'view') THEN event_type END AS other, coalesce('user:' || user_id, 'event:' || event_id) AS key,
 CAST(4 * (value > 50)::INT + 2 * (user_id > 10)::INT + (event_type = 'click')::INT AS INTEGER) AS quality FROM events""")
def guarded_values(spark, sf):
    e, c = table(spark, sf, "events"), F.col
    return e.select(
        "event_id", S.json_text(c("props"), "$.k").alias("k_text"), S.json_number(c("props"), "$.k").alias("k_number"), S.digits_or_null(c("event_type"), "int").alias("digits"), S.null_if_any(c("event_type"), "click", "view").alias("other"),
        S.priority_key(("user", c("user_id")), ("event", c("event_id"))).alias("key"), S.quality_score(c("value") > 50, c("user_id") > 10, c("event_type") == "click").alias("quality"),
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 1 THEN CAST(l_suppkey AS DOUBLE) WHEN 2 THEN l_suppkey / 100000.0 WHEN 3 THEN CAST(l_partkey AS DOUBLE) WHEN 6 THEN -100.0 * l_partkey END AS number, CASE WHEN l_linenumber % 2 = 0 AND l_suppkey % 3 <> 0 THEN CAST(l_shipdate AS DATE) END AS day,
 CASE l_linenumber WHEN 1 THEN true WHEN 2 THEN false END AS flag, CASE WHEN l_linenumber IN (1, 3) AND l_partkey > 0 THEN CAST(l_partkey AS VARCHAR) WHEN l_linenumber = 2 THEN 'x.5' END AS ident FROM lineitem""")
def guarded_texts(spark, sf):
    """Texts of every kind made of the lines' numbers, so that the SQL need not read them."""
    l, n = table(spark, sf, "lineitem"), F.col("l_linenumber")
    s, p = F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")
    x = F.when(n == 1, F.concat(F.lit("+"), s)).when(n == 2, F.concat(F.lit("."), F.lpad(s, 5, "0"))).when(n == 3, F.concat(p, F.lit("."))).when(n == 4, F.concat(F.lit(" "), p, F.lit(" "))).when(n == 5, F.concat(p, F.lit("d"))).when(n == 6, F.concat(F.lit("-"), p, F.lit("E+2"))).otherwise("inf")
    day = F.when(F.col("l_suppkey") % 3 == 0, F.date_format("l_shipdate", "yyyy-M-d'T'")).when(n % 2 == 0, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise("2023-02-30")
    j = F.when(n == 1, '{"b":true}').when(n == 2, '{"b": false}').when(n == 3, '{"b":"true"}').when(n == 4, '{"b":1}').when(n == 5, "no")
    ident = F.when((n == 1) & (F.col("l_partkey") > 0), F.concat(F.lit(" "), p, F.lit(".0 "))).when(n == 2, "x.5").when(n == 3, p).when(n == 4, "NULL").when(n == 5, " 0 ").otherwise("")
    return l.select("l_orderkey", "l_linenumber", "l_partkey", S.number_or_null(x).alias("number"), S.iso_date_or_null(day).alias("day"), S.json_boolean(j, "$.b").alias("flag"), S.clean_identifier(ident, "nan", "none", "null", "0").alias("ident"))


@query(f"""WITH {SEASONS}, f AS (SELECT entity, season, a FROM seasons WHERE a IS NOT NULL), o AS (SELECT entity, season, b FROM seasons WHERE b IS NOT NULL)
SELECT coalesce(f.entity, o.entity) AS entity, coalesce(f.season, o.season) AS season, coalesce(a, b) AS v, a IS NOT NULL AND b IS NOT NULL AND a <> b AS v_conflict, f.entity IS NOT NULL AS in_left, o.entity IS NOT NULL AS in_right FROM f FULL JOIN o ON f.entity = o.entity AND f.season = o.season""")
def full_merge(spark, sf):
    s = seasons(spark, sf)
    a = s.filter("a is not null").select("entity", "season", F.col("a").alias("v"))
    b = s.filter("b is not null").select("entity", "season", F.col("b").alias("v"))
    return identity.full_merge(a, b, ["entity", "season"], ["v"])


@query("""WITH b AS (SELECT c_custkey AS id, c_acctbal AS bal, c_mktsegment AS seg FROM customer WHERE c_acctbal > 0), o AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE -1.0 END AS bal, 'X' AS seg FROM customer WHERE c_acctbal < 5000)
SELECT coalesce(b.id, o.id) AS id, coalesce(o.bal, b.bal) AS bal, coalesce(o.seg, b.seg) AS seg, CASE WHEN o.id IS NULL THEN 'base' WHEN b.id IS NULL THEN 'added' ELSE 'overlaid' END AS origin FROM b FULL JOIN o ON b.id = o.id""")
def overlay(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    over = c.filter("bal < 5000").select("id", F.when(F.col("id") % 4 != 0, -1.0).alias("bal"), F.lit("X").alias("seg"))
    return identity.overlay(c.filter("bal > 0"), over, ["id"], ["bal", "seg"])


@query("SELECT c_custkey AS id, 'first' AS src FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'second' FROM customer WHERE c_custkey % 3 <> 0")
def merge_missing(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return identity.merge_missing(c.filter("id % 3 = 0").withColumn("src", F.lit("first")), c.withColumn("src", F.lit("second")), ["id"])


@query("""WITH d AS (SELECT c_mktsegment, c_nationkey, round(avg(c_acctbal), 6) AS v FROM customer GROUP BY 1, 2 HAVING count(*) >= 14), m AS (SELECT c_mktsegment, round(avg(c_acctbal), 6) AS v FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1), g AS (SELECT round(avg(c_acctbal), 6) AS v FROM customer)
SELECT c_custkey, coalesce(d.v, m.v, g.v) AS expected, CASE WHEN d.v IS NOT NULL THEN 0 WHEN m.v IS NOT NULL THEN 1 ELSE 2 END AS level FROM customer LEFT JOIN d USING (c_mktsegment, c_nationkey) LEFT JOIN m USING (c_mktsegment) CROSS JOIN g""")
def fallback_lookup(spark, sf):
    c = table(spark, sf, "customer")
    v = F.round(F.avg("c_acctbal"), 6).alias("v")
    detail = c.groupBy("c_mktsegment", "c_nationkey").agg(v, F.count("*").alias("n")).filter("n >= 14")
    mid, all_ = c.filter("c_mktsegment <> 'BUILDING'").groupBy("c_mktsegment").agg(v), c.agg(v)
    out = identity.fallback_lookup(c, [(detail, ["c_mktsegment", "c_nationkey"]), (mid, ["c_mktsegment"]), (all_, [])], "v", "expected", "level")
    return out.select("c_custkey", "expected", "level")


@query("SELECT l_orderkey, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) GROUP BY 1 HAVING count(*) = 1")
def unique_keys(spark, sf):
    pairs = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    return identity.unique_keys(pairs, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


_PAIRS = "p AS (SELECT DISTINCT o_orderkey - CAST(o_orderkey % 4 = 3 AS INT) AS a, o_custkey * 10000 + year(o_orderdate) AS b FROM orders)"


@query(f"WITH {_PAIRS}, a1 AS (SELECT * FROM p WHERE a IN (SELECT a FROM p GROUP BY 1 HAVING count(*) = 1)) SELECT a, b FROM a1 WHERE b IN (SELECT b FROM a1 GROUP BY 1 HAVING count(*) = 1)")
def one_to_one(spark, sf):
    p = table(spark, sf, "orders").select((F.col("o_orderkey") - (F.col("o_orderkey") % 4 == 3).cast("int")).alias("a"), (F.col("o_custkey") * 10000 + F.year("o_orderdate")).alias("b"))
    return identity.one_to_one(p, "a", "b")


@query("""WITH r AS (SELECT c_custkey, c_custkey % 50 AS k1, c_custkey % 70 AS k2 FROM customer), t1 AS (SELECT k1, min(target) AS target FROM (SELECT DISTINCT s_suppkey % 60 AS k1, s_suppkey AS target FROM supplier) GROUP BY 1 HAVING count(*) = 1), t2 AS (SELECT k2, min(target) AS target FROM (SELECT DISTINCT s_suppkey % 80 AS k2, s_suppkey AS target FROM supplier) GROUP BY 1 HAVING count(*) = 1),
j AS (SELECT c_custkey, t1.target AS x, t2.target AS y FROM r LEFT JOIN t1 USING (k1) LEFT JOIN t2 USING (k2))
SELECT c_custkey, CASE WHEN x IS NULL OR y IS NULL OR x = y THEN coalesce(x, y) END AS target, CASE WHEN x <> y THEN 'id_collision' WHEN x IS NOT NULL THEN 'k1' WHEN y IS NOT NULL THEN 'k2' ELSE 'unmatched' END AS match_status FROM j""")
def priority_match(spark, sf):
    r = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 50).alias("k1"), (F.col("c_custkey") % 70).alias("k2"))
    s = table(spark, sf, "supplier").select((F.col("s_suppkey") % 60).alias("k1"), (F.col("s_suppkey") % 80).alias("k2"), F.col("s_suppkey").alias("target"))
    return identity.priority_match(r, [("k1", s), ("k2", s)], "target").select("c_custkey", "target", "match_status")


#: Open orders are current, the others historical: together all.
_IDENT = """cur AS (SELECT DISTINCT o_custkey AS sid, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 400 END AS tid FROM orders WHERE coalesce(o_orderstatus = 'O', false)),
his AS (SELECT DISTINCT o_custkey AS sid, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 400 END AS tid FROM orders WHERE NOT coalesce(o_orderstatus = 'O', false))"""


@query(f"""WITH {_IDENT}, c AS (SELECT sid, count(DISTINCT tid) AS nc, min(tid) AS tc FROM cur GROUP BY 1), h AS (SELECT sid, count(DISTINCT tid) AS nh, min(tid) AS th FROM his GROUP BY 1),
b AS (SELECT coalesce(c.sid, h.sid) AS sid, coalesce(nc, 0) AS nc, coalesce(nh, 0) AS nh, tc, th, coalesce(tc, th) AS cand FROM c FULL JOIN h ON c.sid = h.sid),
k AS (SELECT tid, count(DISTINCT sid) AS n FROM (SELECT * FROM cur UNION ALL SELECT * FROM his) WHERE tid IS NOT NULL GROUP BY 1),
s AS (SELECT sid, cand, CASE WHEN nc > 1 THEN 'current_tuple_conflict' WHEN nh > 1 THEN 'historical_tuple_conflict' WHEN tc <> th THEN 'current_history_conflict' WHEN k.n > 1 THEN 'historical_census_conflict' WHEN nc = 1 THEN 'current_exact' WHEN nh = 1 THEN 'historical_exact' ELSE 'unresolved' END AS status FROM b LEFT JOIN k ON k.tid = cand)
SELECT sid, CASE WHEN status IN ('current_exact', 'historical_exact') THEN cand END AS tid, status FROM s""")
def resolve_identities(spark, sf):
    o, current = table(spark, sf, "orders"), F.coalesce(F.col("o_orderstatus") == "O", F.lit(False))
    cur = o.filter(current).selectExpr("o_custkey as sid", "case when o_orderkey % 5 = 0 then o_orderkey % 400 end as tid").distinct()
    his = o.filter(~current).selectExpr("o_custkey as sid", "case when o_orderkey % 3 <> 0 then o_orderkey % 400 end as tid").distinct()
    return identity.resolve_identities(cur, his, "sid", "tid")


@query(f"WITH {SEASONS} SELECT entity, season, CASE WHEN a = b THEN 'agree' WHEN a IS NOT NULL AND b IS NOT NULL THEN 'quarantine' WHEN a IS NOT NULL THEN 'left_only' WHEN b IS NOT NULL THEN 'right_only' ELSE 'none' END AS agreement FROM seasons")
def dual_source_agreement(spark, sf):
    return seasons(spark, sf).select("entity", "season", identity.agree(F.col("a"), F.col("b")).alias("agreement"))


@query("""SELECT n_name, r_name, count(*) AS customers, count(*) FILTER (WHERE c_acctbal < 0) AS negative, bool_or(c_acctbal > 9900) AS any_rich, round(sum(c_acctbal) / nullif(count(DISTINCT c_mktsegment), 0), 4) AS per_segment,
 string_agg(DISTINCT c_mktsegment, ' | ' ORDER BY c_mktsegment) AS segments, count(DISTINCT (c_mktsegment, c_nationkey)) AS tuples FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def grouped_facts(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    from pitwise.operators.aggregates import ordered_set

    return j.groupBy("n_name", "r_name").agg(
        F.count("*").alias("customers"), F.count_if(F.col("c_acctbal") < 0).alias("negative"), F.bool_or(F.col("c_acctbal") > 9900).alias("any_rich"),
        F.round(N.safe_ratio(F.sum("c_acctbal"), F.countDistinct("c_mktsegment")), 4).alias("per_segment"), ordered_set(F.col("c_mktsegment")).alias("segments"), F.countDistinct(F.struct("c_mktsegment", "c_nationkey")).alias("tuples"),
    )


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_join(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join(spark, sf):
    o = table(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT p_partkey, list_aggregate(list_distinct(list_transform(string_split(p_type, ' '), lambda x: upper(trim(x)))), 'count') AS parts, array_to_string(list_transform(string_split(p_type, ' '), lambda x: upper(trim(x))), '|') AS tokens FROM part")
def token_split(spark, sf):
    p = table(spark, sf, "part")
    t = X.upper_tokens(F.col("p_type"), " ")
    return p.select("p_partkey", F.size(t).cast("long").alias("parts"), F.array_join(t, "|").alias("tokens"))


@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(replace(replace(lower(strip_accents(text)), chr(39), ''), chr(8217), ''), '[^\p{L}\p{N}]+', ' ', 'g')) AS key FROM documents) SELECT doc_id, md5(key) AS key, contains(key, 'ene la') OR contains(replace(key, ' ', ''), 'enela') AS hit FROM t""")
def search_keys(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(X.search_key(F.col("text")).cast("binary")).alias("key"), F.coalesce(X.matches_search("Éñe-LÁ", F.col("text")), F.lit(False)).alias("hit"))


@query("SELECT c_custkey, 'jose nunez customer oneal' AS name FROM customer")
def person_names(spark, sf):
    full = F.concat(F.lit("José  NÚÑEZ "), "c_name", F.lit(" ONeal, Jr. III"))
    return table(spark, sf, "customer").select("c_custkey", X.person_name(full).alias("name"))


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) > 512 THEN 'sha256:' || sha256(text) ELSE text END AS key FROM documents")
def bounded_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.bounded_key(F.col("text")).alias("key"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\r\f\v]+', ' ', 'g')) AS body FROM pages""")
def page_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", readers.plain_text(F.col("html")).alias("body"))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, floor(l_extendedprice), l_returnflag, l_linestatus) AS i FROM lineitem), h AS (SELECT DISTINCT l_orderkey FROM l)
SELECT l_orderkey, table_id, CAST("row" AS INTEGER) AS "row", CAST(cell AS INTEGER) AS cell, name, value, number FROM (
SELECT l_orderkey, CASE WHEN l_orderkey % 3 = 0 THEN 'hidden' ELSE 'lines' END AS table_id, 0 AS row, c AS cell, ['part', 'price', 'flag'][c + 1] AS name, ['Part', 'Price', 'Flag'][c + 1] AS value, NULL::DOUBLE AS number FROM h CROSS JOIN (VALUES (0), (1), (2)) v(c)
UNION ALL SELECT l_orderkey, CASE WHEN l_orderkey % 3 = 0 THEN 'hidden' ELSE 'lines' END, i, c, ['part', 'price', 'flag'][c + 1], [CAST(l_partkey AS VARCHAR), format('{:,}', CAST(floor(l_extendedprice) AS BIGINT)), l_returnflag || ' & ' || l_linestatus][c + 1],
 [CAST(l_partkey AS DOUBLE), floor(l_extendedprice), NULL][c + 1] FROM l CROSS JOIN (VALUES (0), (1), (2)) v(c))""")
def html_table_cells(spark, sf):
    c = F.col
    row = F.concat(F.lit("<tr><td data-stat=part csk="), c("l_partkey").cast("string"), F.lit(">#</td><td data-stat=price>"), F.format_number(F.floor("l_extendedprice"), 0), F.lit("</td><td data-stat=flag> "), "l_returnflag", F.lit(" &amp; "), "l_linestatus", F.lit(" </td></tr>"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.floor("l_extendedprice").alias("price"), "l_returnflag", "l_linestatus", row.alias("html")))), lambda r: r["html"]), "\n")  # an order's lines
    pages = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(lines.alias("lines"))
    head = "<tr><th data-stat=part>Part</th><th data-stat=price>Price</th><th data-stat=flag>Flag</th></tr>"
    made = lambda name: F.concat(F.lit(f"<table id={name}>{head}"), "lines", F.lit("</table>"))
    page = F.concat(F.lit("<html><h1>Order</h1><p>1,234</p>"), F.when(c("l_orderkey") % 3 == 0, F.concat(F.lit("<!--"), made("hidden"), F.lit("-->"))).otherwise(made("lines")), F.lit("</html>"))
    return readers.table_cells(pages.select("l_orderkey", page.alias("html")), "html")


@query()
def page_tables(spark, sf):
    """Cells of the tables of crawled pages (those of the tests have none); held against made-up pages in a test."""
    return readers.html_tables(table(spark, sf, "pages"), "page_id", "html")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_recordset(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("["), "props", F.lit("]")).alias("doc"))
    return e.select("event_id", readers.records(F.col("doc"), "k bigint, missing string"))


@query("SELECT n_name AS name, l AS level, CAST(s AS INTEGER) AS season FROM nation CROSS JOIN (VALUES ('a'), ('b')) t(l) CROSS JOIN (VALUES (2020), (2021), (2022)) u(s)")
def slice_matrix(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_name").alias("name")).join(F.broadcast(readers.slice_matrix(spark, level=["a", "b"], season=[2020, 2021, 2022])))  # six rows


@query("SELECT o_custkey AS id, CASE WHEN count(DISTINCT o_orderkey % 3) <= 1 THEN min(o_orderkey % 3) END AS target, CAST(min(year(o_orderdate)) AS INTEGER) AS season, arg_min(o_orderpriority, (year(o_orderdate), -epoch_us(o_orderdate), o_orderpriority)) AS evidence, count(DISTINCT o_orderkey % 3) > 1 AS conflict FROM orders GROUP BY 1")
def merge_evidence(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 3).alias("target"), F.year("o_orderdate").alias("season"), F.col("o_orderdate").alias("stamp"), F.col("o_orderpriority").alias("evidence"))
    return sinks.merge_evidence(o, "id", "target", "season", "stamp", "evidence")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ordinal, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 20) AS BIGINT) AS batch FROM events")
def append_ordinals(spark, sf):
    return sinks.ordinals(table(spark, sf, "events"), 20, [F.col("ts"), F.col("event_id")], ["user_id"]).select("event_id", "ordinal", "batch")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def insert_absent(spark, sf):
    there = table(spark, sf, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return sinks.insert_absent(there, table(spark, sf, "orders").select("o_custkey"), ["o_custkey"])
