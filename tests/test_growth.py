"""Work that grows no faster than its rows: plans of one exchange, values worked out once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pitwise.functions import roster
from pitwise.operators import cohorts, ordered, publication
from pitwise.sources import scratch


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_evidence_reads_each_metric_once(spark):
    metric = "array<struct<key:string,percentile:double,source:string>>"
    rows = [
        (1, [(" AVG", 80.0, "us"), ("whiff", 90.0, "them"), ("sprint", 80.0, "us"), ("iso", 3.0, "us")]), (2, [("avg", 5.0, "us"), ("whiff", 5.0, "us"), ("iso", 101.0, "us"), ("sprint", 1.0, "us"), ("sprint ", 2.0, "us")]), (3, None), (4, []),
        (5, [("avg", None, "us"), (None, 99.0, "us"), ("iso", 99.0, None), ("sprint", 100.0, "us")]),
    ]
    pillars = {"contact": ("avg", "whiff"), "power": ("iso",), "speed": ("sprint",)}
    out = spark.createDataFrame(rows, f"i int, m {metric}").select("i", roster.trait_evidence(F.col("m"), pillars, "us").alias("e")).select("i", "e.*")
    few, foreign = "insufficient_pillar_coverage", "unsupported_metric_source_excluded"
    assert sorted(map(tuple, out.collect())) == [
        (1, "contact,power,speed", "contact,speed", "avg,iso,sprint", True, True, foreign), (2, "contact", "", "avg", False, False, few), (3, "", "", "", False, False, few), (4, "", "", "", False, False, few),
        (5, "speed", "speed", "sprint", False, False, few),
    ]
    assert plan(out).count("lower(") == 1


def test_census_deals_memberships_once(spark):
    rows = [(1, "2020-01-01", "affiliate", "active", "AA", 5, 9, "a"), (1, "2020-02-01", "parent", "rehab", "AAA", 6, None, "b"), (1, "2020-02-01", "affiliate", "injured", None, 7, 9, "a"), (2, None, "parent", "x", "A", 8, 1, None), (2, "2021-01-01", "affiliate", "active", "A", 8, 1, None)]
    t = spark.createDataFrame(rows, "id int, at string, kind string, status string, level string, team int, org int, role string").withColumn("at", F.to_date("at"))
    out = publication.census(t, "id", "at", "kind", "status", "level", "team", "org", "role", ["team", "status", "level"])
    assert "Expand" not in plan(out) and out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {r.id: tuple(r)[1:8] for r in out.collect()}
    assert got == {1: (7, "injured", None, 3, 2, 2, 1), 2: (8, "x", "A", 2, 1, 0, 1)}


def test_isotonic_of_many_entities_is_that_of_each(spark):
    r = np.random.default_rng(3)
    rows = [(f"e{e}", g, int(i), float(v), float(w), f"x{i}") for e in range(40) for g in (0, 1) for i, (v, w) in enumerate(zip(r.normal(size=e % 7 + 1).cumsum(), r.uniform(0.1, 2, size=7)))]
    t = spark.createDataFrame(rows, "e string, g int, i int, v double, w double, more string").repartition(5)
    out = ordered.isotonic(t.select("i", "e", "v", "w", "more", "g"), ["e", "g"], "i", "v", "w", "fitted")
    assert out.columns == ["i", "e", "v", "w", "more", "g", "fitted"]
    got = {(x.e, x.g, x.i): x for x in out.collect()}
    for e, g in {(x[0], x[1]) for x in rows}:
        own = [x for x in rows if x[:2] == (e, g)]
        want = ordered.pool_adjacent(np.array([x[3] for x in own]), np.array([x[4] for x in own]))
        assert [got[x[:3]].more for x in own] == [x[5] for x in own] and np.allclose([got[x[:3]].fitted for x in own], want, rtol=0, atol=1e-12)
    assert "FlatMapGroupsInPandas" not in plan(out)



def test_peers_of_a_window_are_weighed_where_they_lie(spark, monkeypatch):
    r = np.random.default_rng(11)
    rows = {(int(e), int(s)): ("ab"[e % 2], int(e), int(s), int(s) - 2000 + int(e) % 4, float(r.integers(0, 9)) if (e + s) % 11 else None) for e, s in r.integers([0, 2000], [60, 2009], (300, 2))}
    t = spark.createDataFrame(list(rows.values()), "g string, e int, s int, age int, v double")
    written = []
    monkeypatch.setattr(cohorts, "cut", lambda df, name: written.append(df._jdf.queryExecution().executedPlan().toString()) or scratch.cut(df, name))
    out = cohorts.adaptive_window_percentile(t.union(t.limit(5)), t, ["g"], "age", "v", "e", "s", least=6)
    laid = [p for p in written if "explode(sequence" in p]
    # between the ages that a peer is laid out for and their first sums there is no exchange
    assert laid and all("Exchange" not in p[: p.index("Generate explode")].split("min(CASE")[-1] for p in laid)
    got = {(x.e, x.s): (x.window, x.percentile) for x in out.collect()}
    assert got.keys() == rows.keys() and {w for w, _ in got.values()} == {None, 0, 1, 2, 3}
    for g, e, s, age, v in rows.values():
        pools = {w: [x for x in rows.values() if x[0] == g and x[2] < s and x[1] != e and abs(x[3] - age) <= w] for w in (0, 1, 2, 3)}
        wide = next((w for w, near in pools.items() if len({x[1] for x in near}) >= 6), None)
        assert got[e, s][0] == wide
        if wide is None or v is None:
            assert got[e, s][1] is None
            continue
        shares = {}
        for x in pools[wide]:
            shares.setdefault(x[1], []).append(0.0 if x[4] is None else 1.0 if x[4] < v else (x[4] == v) / 2)
        assert abs(got[e, s][1] - 100 * np.mean([np.mean(x) for x in shares.values()])) < 1e-9
