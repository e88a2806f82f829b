"""Queries over memberships, risk sets, crosswalks, audits, evaluation and publication."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitwise.operators import careers, crosswalk
from pitwise.plans.catalog import SEASONS, query, r6, seasons, table

_S = f"WITH {SEASONS}"

#: Each order is a stint of its customer in the census of its year.
_MEMBERS = """m AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS census, o_custkey AS id, o_orderkey AS team, o_orderpriority AS organization, o_orderstatus AS level, CAST(o_orderdate AS DATE) AS first_seen,
 CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INTEGER) AS last_seen, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS bats FROM orders)"""


def _members(spark, sf):
    o, c = table(spark, sf, "orders"), F.col
    day = F.to_date("o_orderdate")
    return o.select(
        F.year("o_orderdate").alias("census"), c("o_custkey").alias("id"), c("o_orderkey").alias("team"), c("o_orderpriority").alias("organization"), c("o_orderstatus").alias("level"), day.alias("first_seen"),
        F.date_add(day, (c("o_orderkey") % 40).cast("int")).alias("last_seen"), F.when(c("o_orderkey") % 3 == 0, c("o_orderpriority")).alias("bats"),
    )


def _collapsed(spark, sf):
    return careers.collapse_memberships(
        _members(spark, sf), ["census", "id"], "first_seen", "last_seen", "team", {"organizations": "organization", "levels": "level"}, latest=["organization", "level"], known=["bats"], pooled=["level"], stint=["team", "organization", "level"]
    )


_COLLAPSED = f"""{_MEMBERS}, c AS (SELECT census, id, arg_max(organization, (last_seen, first_seen, team)) AS organization, arg_max(level, (last_seen, first_seen, team)) AS level, arg_max(bats, (last_seen, first_seen, team)) FILTER (WHERE bats IS NOT NULL) AS bats,
 string_agg(DISTINCT organization, ' | ' ORDER BY organization) AS organizations, string_agg(DISTINCT level, ' | ' ORDER BY level) AS levels, CASE WHEN count(DISTINCT level) = 1 THEN min(level) ELSE 'Pooled multi-level' END AS level_pooled,
 min(first_seen) AS first_seen, max(last_seen) AS last_seen, count(*) AS stints, CAST(to_json(list({{'team': team, 'organization': organization, 'level': level}} ORDER BY last_seen, first_seen, team)) AS VARCHAR) AS stints_json FROM m GROUP BY 1, 2)"""


@query(f"WITH {_COLLAPSED} SELECT * FROM c")
def membership_collapse(spark, sf):
    return _collapsed(spark, sf)


@query(f"WITH {_MEMBERS}, g AS (SELECT census, id, count(*) AS n, count(DISTINCT organization) AS o, count(DISTINCT level) AS l FROM m GROUP BY 1, 2) SELECT CAST(sum(n) AS BIGINT) AS stints, count(*) AS keys, CAST(sum(n) - count(*) AS BIGINT) AS collapsed, count(*) FILTER (WHERE o > 1) AS several_organizations, count(*) FILTER (WHERE l > 1) AS several_levels FROM g")
def membership_quality(spark, sf):
    return careers.membership_quality(_members(spark, sf), ["census", "id"], several_organizations="organization", several_levels="level")


#: Statistics end with the last order of a year; the register has some ids twice.
_RISK = f"""{_COLLAPSED}, d AS (SELECT DISTINCT census, make_date(census, 7, 1) AS as_of FROM m), r0 AS (SELECT c_custkey - CAST(c_custkey % 10 = 3 AS INT) AS id, 'p' || c_custkey AS person, make_date(1960 + CAST(c_custkey % 45 AS INTEGER), 1, 1) AS born0 FROM customer),
r AS (SELECT id, any_value(person) AS person FROM r0 GROUP BY 1 HAVING count(*) = 1), b AS (SELECT c_custkey AS id, make_date(1960 + CAST(c_custkey % 45 AS INTEGER), 1, 1) AS born FROM customer),
s AS (SELECT o_custkey AS id, CAST(year(o_orderdate) AS INTEGER) AS season, CAST(max(o_orderdate) AS DATE) AS through, round(sum(o_totalprice), 2) AS volume FROM orders GROUP BY 1, 2),
j AS (SELECT c.census, c.id, as_of, person, born, s.season, s.through, s.volume, row_number() OVER (PARTITION BY c.census, c.id ORDER BY s.through DESC NULLS LAST, s.season DESC) AS rn FROM c JOIN d USING (census) JOIN b USING (id) LEFT JOIN r USING (id) LEFT JOIN s ON s.id = c.id AND s.through <= as_of),
k AS (SELECT census, id, person, CASE WHEN born <= as_of THEN round(date_diff('day', born, as_of) / 365.2425, 4) END AS age, season, through, volume, person IS NOT NULL AS identity_resolved, through IS NOT NULL AS has_prior_stats FROM j WHERE rn = 1)"""


def _risk_set(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    born = F.make_date((F.lit(1960) + F.col("c_custkey") % 45).cast("int"), F.lit(1), F.lit(1))
    members = _collapsed(spark, sf).join(c.select(F.col("c_custkey").alias("id"), born.alias("born")), "id")
    census = members.select("census").distinct().withColumn("as_of", F.make_date("census", F.lit(7), F.lit(1)))
    register = c.select((F.col("c_custkey") - (F.col("c_custkey") % 10 == 3).cast("int")).alias("id"), F.concat(F.lit("p"), "c_custkey").alias("person"))
    stats = o.groupBy(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("season")).agg(F.to_date(F.max("o_orderdate")).alias("through"), F.round(F.sum("o_totalprice"), 2).alias("volume"))
    return careers.risk_set(census, members, register, stats, "census", "as_of", "id", "person", "born", "season", "through", ["volume"])


@query(f"WITH {_RISK} SELECT * FROM k")
def risk_set(spark, sf):
    return _risk_set(spark, sf).select("census", "id", "person", "age", "season", "through", "volume", "identity_resolved", "has_prior_stats")


@query(f"WITH {_RISK} SELECT census, count(*) AS players, count(*) FILTER (WHERE identity_resolved) AS resolved, round(avg(CAST(identity_resolved AS INT)), 6) AS identity_rate, round(avg(CAST(has_prior_stats AS INT)), 6) AS prior_stats_rate FROM k GROUP BY 1")
def risk_set_coverage(spark, sf):
    return careers.risk_set_coverage(_risk_set(spark, sf), "census")


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'SENTINEL' WHEN 2 THEN 'bad' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS x, o_orderkey % 5 < 2 AS gone, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, gone AS seen_imputed, CASE WHEN gone THEN DATE '1998-12-31' WHEN x <> 'bad' THEN d END AS seen FROM t""")
def boundary_dates(spark, sf):
    k = F.col("o_orderkey") % 5
    x = F.when(k == 0, "").when(k == 1, "SENTINEL").when(k == 2, "bad").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return careers.boundary_dates(table(spark, sf, "orders").select("o_orderkey", x.alias("seen")), ["seen"], F.lit("1998-12-31").cast("date"), ("SENTINEL",))


@query("""WITH b AS (SELECT o_custkey AS id, round(sum(o_totalprice), 2) AS batting_g, max(year(o_orderdate)) AS y FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), p AS (SELECT o_custkey AS id, round(sum(o_totalprice), 2) AS pitching_g, max(year(o_orderdate)) AS y FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
h AS (SELECT o_custkey AS id, CAST(min(year(o_orderdate)) + 2 AS INTEGER) AS honour_year FROM orders WHERE o_totalprice > 300000 GROUP BY 1), e AS (SELECT o_custkey AS id, min(CAST(o_orderdate AS DATE)) AS debut, max(CAST(o_orderdate AS DATE)) AS final FROM orders GROUP BY 1),
j AS (SELECT c_custkey AS id, batting_g, pitching_g, CAST(greatest(b.y, p.y) AS INTEGER) AS last_season, honour_year, debut, final FROM customer LEFT JOIN b ON b.id = c_custkey LEFT JOIN p ON p.id = c_custkey LEFT JOIN h ON h.id = c_custkey LEFT JOIN e ON e.id = c_custkey),
s AS (SELECT *, coalesce(honour_year <= 2002, false) AS given, coalesce(last_season <= 1999, false) AS over FROM j)
SELECT id, batting_g, pitching_g, last_season, honour_year, CASE WHEN given THEN 'inducted' WHEN last_season <= 1997 THEN 'inactive_not_inducted_censored' ELSE 'active_or_recent_not_inducted_censored' END AS outcome_state, CASE WHEN given THEN true END AS inducted,
 CASE WHEN last_season IS NULL THEN 'unobserved' WHEN over THEN 'three_year_inactivity_proxy' ELSE 'right_censored' END AS resolution, CAST(CASE WHEN over AND year(final) >= last_season THEN date_diff('day', debut, final) END AS INTEGER) AS career_days FROM s""")
def career_outcomes(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("season"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("g"), "o_orderstatus")
    ends = o.groupBy("id").agg(F.min("day").alias("debut"), F.max("day").alias("final"))
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).join(ends, "id", "left")
    honours = o.filter("g > 300000").select("id", (F.col("season") + 2).alias("year"))
    parts = {"batting": (o.filter("o_orderstatus = 'F'"), ["g"]), "pitching": (o.filter("o_orderstatus = 'O'"), ["g"])}
    out = careers.career_outcomes(people, parts, honours, "id", "season", "final", "debut", "year", 2002)
    return out.select("id", *[F.round(c, 2).alias(c) for c in ("batting_g", "pitching_g")], "last_season", "honour_year", "outcome_state", "inducted", "resolution", "career_days")


@query(f"""{_S}, x AS (SELECT entity, season, value, CASE WHEN (entity + season) % 3 <> 0 THEN season - 1960.0 - entity % 20 + season % 2 END AS age FROM seasons)
SELECT entity, season, coalesce(age, season + median(age - season) OVER (PARTITION BY entity)) AS age FROM x""")
def ages_from_seasons(spark, sf):
    e, s = F.col("entity"), F.col("season")
    x = seasons(spark, sf).select("entity", "season", F.when((e + s) % 3 != 0, s - 1960.0 - e % 20 + s % 2).alias("age"))
    return careers.ages_from_seasons(x, "entity", "season", "age")


@query("""WITH g AS (SELECT l_partkey, CAST(year(l_shipdate) AS INTEGER) AS season, sum(l_quantity) AS l_quantity, round(sum(l_extendedprice), 2) AS l_extendedprice, sum(l_linenumber) AS l_linenumber, count(DISTINCT l_returnflag) > 1 AS pooled FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, season, pooled, round(l_extendedprice / nullif(l_quantity, 0), 6) AS price, round((l_quantity + l_linenumber) / nullif(l_linenumber, 0), 6) AS load FROM g""")
def pooled_rates(spark, sf):
    l = table(spark, sf, "lineitem").withColumn("season", F.year("l_shipdate"))
    out = careers.pooled_rates(l, ["l_partkey", "season"], ["l_quantity", "l_extendedprice", "l_linenumber"], {"price": (["l_extendedprice"], ["l_quantity"]), "load": (["l_quantity", "l_linenumber"], ["l_linenumber"])}, "l_returnflag")
    return out.select("l_partkey", "season", "pooled", r6(F.round("price", 8)).alias("price"), r6("load").alias("load"))


@query(f"""{_S}, t AS (SELECT *, round(sum(value) OVER w, 2) AS total_so_far, coalesce(sum(a) OVER w, 0) AS sa, coalesce(sum(b) OVER w, 0) AS sb FROM seasons WINDOW w AS (PARTITION BY entity ORDER BY season)),
k AS (SELECT t.entity, t.season, s.value, row_number() OVER (PARTITION BY t.entity, t.season ORDER BY s.value DESC) AS rn FROM t JOIN seasons s ON s.entity = t.entity AND s.season <= t.season), p AS (SELECT entity, season, sum(value) AS peak FROM k WHERE rn <= 7 GROUP BY 1, 2),
z AS (SELECT entity, season, CASE WHEN sa >= sb THEN 'a' ELSE 'b' END AS role, (total_so_far + peak) / 2 AS blend FROM t JOIN p USING (entity, season))
SELECT entity, season, role, round(blend, 2) AS blend, role = 'b' AS fallback, round(blend - CASE role WHEN 'a' THEN 800000.0 ELSE 600000.0 END, 2) AS margin FROM z""")
def landmark_panel(spark, sf):
    standards = spark.sql("SELECT * FROM VALUES ('a', 800000D), (CAST(NULL AS STRING), 600000D) AS t(role, standard)")
    out = careers.landmark_panel(seasons(spark, sf), "entity", "season", "value", "a", "b", standards, "role", "standard")
    return out.select("entity", "season", "role", F.round("blend", 2).alias("blend"), "fallback", F.round("margin", 2).alias("margin"))


@query(f"""{_S}, x AS (SELECT entity, season, value, CASE WHEN season % 4 <> 0 THEN season - 1965 END AS age FROM seasons), p AS (SELECT entity, round(sum(value) OVER (PARTITION BY entity ORDER BY season), 3) AS actual, season, age FROM x),
n AS (SELECT entity, max(age) AS age, sum(value) AS total FROM x GROUP BY 1)
SELECT entity, CAST(age AS DOUBLE) AS age, season, actual AS q10, actual AS q50, actual FROM p WHERE age IS NOT NULL
UNION ALL SELECT entity, CAST(least(age + 10, greatest(age + 2, 37)) AS DOUBLE), NULL, round(total, 3), round(total * 2, 3), NULL FROM n WHERE age IS NOT NULL""")
def arc_points(spark, sf):
    x = seasons(spark, sf).select("entity", "season", "value", F.when(F.col("season") % 4 != 0, F.col("season") - 1965).alias("age"))
    projected = x.groupBy("entity").agg(F.sum("value").alias("q10"), (F.sum("value") * 2).alias("q50"))
    return careers.arc_points(x, "entity", "season", "age", "value", projected, ["q10", "q50"])


@query("""WITH t AS (SELECT c_custkey, 18 + (c_custkey % 97) / 10.0 AS age, [(c_custkey % 7) / 20.0, (c_custkey % 5) / 10.0, (c_custkey % 11) / 12.0] AS p FROM customer), r AS (SELECT *, p[1] AS a, greatest(p[1], p[2]) AS b, greatest(p[1], p[2], p[3]) AS c FROM t)
SELECT c_custkey, CAST(greatest(ceil(age), round_even(age + (CASE WHEN c <= 1e-9 THEN 60 ELSE (a * 6 + (b - a) * 18 + (c - b) * 30) / c END) / 12.0, 0)) AS BIGINT) AS expected_age FROM r""")
def expected_event_age(spark, sf):
    k = F.col("c_custkey")
    t = table(spark, sf, "customer").select("c_custkey", (18 + (k % 97) / 10).alias("age"), F.array((k % 7) / 20, (k % 5) / 10, (k % 11) / 12).alias("p"))
    return t.select("c_custkey", careers.expected_event_age(F.col("age"), F.col("p"), (6, 18, 30)).alias("expected_age"))


# --- crosswalks ----------------------------------------------------------------------

#: Orders are the overlay in the order of their keys; customers' ids conflict by remainder.
_OVER = """o AS (SELECT o_orderkey AS n, 'a' || (o_custkey + CAST(o_orderkey % 17 = 0 AS INT)) AS a, 'b' || o_custkey AS b, o_custkey * 10 + CAST(o_orderkey % 13 = 0 AS INT) AS c, CAST(year(o_orderdate) AS INTEGER) AS season, o_orderkey % 19 <> 0 AS ok FROM orders),
au AS (SELECT 'b' || c_custkey AS b, c_custkey * 10 AS c FROM customer WHERE c_custkey % 7 <> 0), st AS (SELECT c_custkey * 10 + CAST(c_custkey % 5 = 0 AS INT) AS c, CASE WHEN c_custkey % 3 = 0 THEN 'a' || (c_custkey + CAST(c_custkey % 9 = 0 AS INT)) END AS a, CAST(CASE WHEN c_custkey % 2 = 0 THEN 1990 END AS INTEGER) AS season FROM customer WHERE c_custkey % 4 = 0),
j AS (SELECT o.*, au.c AS auc, s1.c AS s1c, s1.c IS NOT NULL AS s1there, s1.season AS s1s, s2.a AS s2a, s2.season AS s2s FROM o LEFT JOIN au USING (b) LEFT JOIN st s1 ON s1.a = o.a LEFT JOIN st s2 ON s2.c = o.c),
f AS (SELECT *, CASE WHEN NOT ok THEN 'invalid_overlay_row' WHEN auc IS NULL THEN 'unknown_b' WHEN auc <> c THEN 'b_c_conflict' WHEN s1c <> c THEN 'static_a_conflict' WHEN s2a <> a THEN 'static_c_conflict' END AS fixed FROM j)"""


@query()
def composed_crosswalk(spark, sf):
    """Order decides; the greedy acceptance has no SQL, tests hold it against brute force."""
    o, c, k = table(spark, sf, "orders"), table(spark, sf, "customer"), F.col
    one = lambda when: when.cast("int")
    overlay = o.select(k("o_orderkey").alias("n"), F.concat(F.lit("a"), k("o_custkey") + one(k("o_orderkey") % 17 == 0)).alias("a"), F.concat(F.lit("b"), "o_custkey").alias("b"), (k("o_custkey") * 10 + one(k("o_orderkey") % 13 == 0)).alias("c"), F.year("o_orderdate").alias("season"))
    authority = c.filter("c_custkey % 7 <> 0").select(F.concat(F.lit("b"), "c_custkey").alias("b"), (k("c_custkey") * 10).alias("c"))
    static = c.filter("c_custkey % 4 = 0").select((k("c_custkey") * 10 + one(k("c_custkey") % 5 == 0)).alias("c"), F.when(k("c_custkey") % 3 == 0, F.concat(F.lit("a"), k("c_custkey") + one(k("c_custkey") % 9 == 0))).alias("a"), F.when(k("c_custkey") % 2 == 0, 1990).alias("season"))
    return crosswalk.compose_crosswalk(overlay, static, authority, "n", "a", "b", "c", "season", k("n") % 19 != 0)


@query(f"""{_S}, r AS (SELECT 'p' || c_custkey AS person, c_custkey - CAST(c_custkey % 50 = 7 AS INT) AS target, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS native, CAST(CASE WHEN c_custkey % 6 <> 5 THEN 1993 END AS INTEGER) AS f, CAST(CASE WHEN c_custkey % 11 <> 5 THEN 1996 END AS INTEGER) AS l FROM customer),
k AS (SELECT 'p' || c_custkey AS person, c_custkey + CAST(c_custkey % 8 = 0 AS INT) AS native FROM customer WHERE c_custkey % 3 = 0), s AS (SELECT entity AS native, min(season) AS sf, max(season) AS sl FROM seasons GROUP BY 1),
j AS (SELECT r.target, r.native AS own, k.native AS linked, coalesce(r.native, k.native) AS native, f, l FROM r LEFT JOIN k USING (person)), t AS (SELECT j.*, sf, sl FROM j LEFT JOIN s ON s.native = j.native WHERE j.native IS NOT NULL OR f IS NOT NULL)
SELECT target, native, CAST(coalesce(sf, f) AS INTEGER) AS first_season, CAST(coalesce(sl, l) AS INTEGER) AS last_season, CASE WHEN sf IS NOT NULL THEN 'seasons' WHEN f IS NOT NULL THEN 'register' END AS evidence,
 concat_ws(',', CASE WHEN own <> linked THEN 'link_conflict' END, CASE WHEN (f IS NULL) <> (l IS NULL) THEN 'incomplete_span' END, CASE WHEN f > l THEN 'reversed_span' END, CASE WHEN count(*) OVER (PARTITION BY target) > 1 THEN 'duplicate_target' END,
  CASE WHEN native IS NOT NULL AND count(*) OVER (PARTITION BY native) > 1 THEN 'duplicate_native' END, CASE WHEN f <> sf THEN 'debut_conflict' END, CASE WHEN sl < l THEN 'span_ends_before_register' END) AS violations FROM t""")
def built_crosswalk(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    person = F.concat(F.lit("p"), k).alias("person")
    register = c.select(person, (k - (k % 50 == 7).cast("int")).alias("target"), F.when(k % 2 == 0, k).alias("native"), F.when(k % 6 != 5, 1993).alias("first"), F.when(k % 11 != 5, 1996).alias("last"))
    links = c.filter(k % 3 == 0).select(person, (k + (k % 8 == 0).cast("int")).alias("native"))
    return crosswalk.build_crosswalk(register, links, seasons(spark, sf).select(F.col("entity").alias("native"), "season"), "person", "target", "native", "first", "last", "season")


@query("""WITH p AS (SELECT c_nationkey AS nation, c_custkey % 5 AS version, make_date(1992 + CAST(c_custkey % 7 AS INTEGER), 1, 1) AS b, CASE WHEN c_custkey % 3 <> 0 THEN make_date(1994 + CAST(c_custkey % 7 AS INTEGER), 1, 1) END AS e FROM customer),
q AS (SELECT nation, version, b, e FROM p GROUP BY ALL), j AS (SELECT o_orderkey, version, b, row_number() OVER (PARTITION BY o_orderkey ORDER BY version DESC, b DESC) AS rn FROM orders JOIN customer ON c_custkey = o_custkey JOIN q ON nation = c_nationkey AND b <= CAST(o_orderdate AS DATE) AND (e IS NULL OR CAST(o_orderdate AS DATE) < e))
SELECT o_orderkey, version, b AS valid_from FROM j WHERE rn = 1""")
def latest_permission(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    year = lambda base: F.make_date((base + k % 7).cast("int"), F.lit(1), F.lit(1))
    permissions = c.select(F.col("c_nationkey").alias("nation"), (k % 5).alias("version"), year(F.lit(1992)).alias("valid_from"), F.when(k % 3 != 0, year(F.lit(1994))).alias("valid_to")).distinct()
    rows = table(spark, sf, "orders").join(c.select(k.alias("o_custkey"), F.col("c_nationkey").alias("nation")), "o_custkey").select("o_orderkey", "nation", F.to_date("o_orderdate").alias("day"))
    return crosswalk.latest_permission(rows, permissions, ["nation"], "day", "valid_from", "valid_to", "version", ["o_orderkey"]).select("o_orderkey", "version", "valid_from")


@query("""WITH r AS (SELECT strip_accents(lower('Ángel' || n_name)) AS name, make_date(1990, 1, 1 + CAST(n_nationkey % 20 AS INTEGER)) AS born, n_nationkey FROM nation), u AS (SELECT trim(regexp_replace(name, '[^a-z]+', ' ', 'g')) AS name, born, any_value(n_nationkey) AS n_nationkey FROM r GROUP BY 1, 2 HAVING count(*) = 1),
l AS (SELECT c_custkey, n_name, c_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey, u.n_nationkey AS found FROM l LEFT JOIN u ON u.name = trim(regexp_replace('angel' || lower(n_name), '[^a-z]+', ' ', 'g')) AND u.born = make_date(1990, 1, 1 + CAST(c_nationkey % 20 AS INTEGER))""")
def exact_name_join(spark, sf):
    n = table(spark, sf, "nation")
    born = lambda k: F.make_date(F.lit(1990), F.lit(1), (F.lit(1) + F.col(k) % 20).cast("int")).alias("born")
    left = table(spark, sf, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.concat(F.lit("angel"), "n_name", F.lit(" Jr.")).alias("name"), born("c_nationkey"))
    right = n.select(F.concat(F.lit("Ángel"), "n_name").alias("name"), born("n_nationkey"), F.col("n_nationkey").alias("found"))
    return crosswalk.exact_name_join(left, right, "name", "born", ["found"]).select("c_custkey", "found")


_PRED = """l AS (SELECT o_orderkey AS id, o_custkey % 7 <> 0 AS observed_12m, o_custkey % 7 <> 0 AND o_orderstatus = 'F' AS event_12m, o_custkey % 2 = 0 AS observed_24m, CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus <> 'P' END AS event_24m FROM orders WHERE o_orderkey % 11 <> 0),
p AS (SELECT o_orderkey AS id, h, o_orderkey % 3 <> 0 AS scored FROM orders CROSS JOIN (VALUES (12), (24)) t(h))"""


@query(f"""WITH {_PRED}, j AS (SELECT p.*, l.id IS NOT NULL AS there, CASE h WHEN 12 THEN observed_12m ELSE observed_24m END AS seen, CASE h WHEN 12 THEN event_12m ELSE event_24m END AS event FROM p LEFT JOIN l USING (id)),
v AS (SELECT *, CASE WHEN NOT there THEN 'no_label' WHEN scored AND NOT coalesce(seen, false) THEN 'not_mature' WHEN scored AND event IS NULL THEN 'not_binary' END AS violation FROM j)
SELECT id, CAST(h AS INTEGER) AS h, CASE WHEN scored AND violation IS NULL THEN CAST(event AS INTEGER) END AS outcome, CAST(scored AND violation IS NULL AS INTEGER) AS outcome_observed, violation FROM v""")
def attached_outcomes(spark, sf):
    o, k = table(spark, sf, "orders"), F.col("o_custkey")
    status = F.col("o_orderstatus")
    labels = o.filter("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("id"), (k % 7 != 0).alias("observed_12m"), ((k % 7 != 0) & (status == "F")).alias("event_12m"), (k % 2 == 0).alias("observed_24m"), F.when(k % 2 == 0, status != "P").alias("event_24m"))
    predictions = o.select(F.col("o_orderkey").alias("id"), F.explode(F.array(F.lit(12), F.lit(24))).alias("h"), (F.col("o_orderkey") % 3 != 0).alias("scored"))
    return crosswalk.attach_outcomes(predictions, labels, ["id"], "h", "scored", (12, 24)).drop("scored")
