"""What SQL cannot express, against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_oracle import SF

from pitwise import registry
from pitwise.operators import careers, cohorts, crosswalk, evaluation, publication
from pitwise.operators.graph import connected
from pitwise.operators.split import running
from pitwise.plans import careers as plans
from pitwise.plans import models
from pitwise.plans.catalog import table


def test_first_accepted_is_greedy_in_order(spark):
    r = random.Random(3)
    for n, ids in ((0, 1), (1, 1), (60, 12), (300, 40), (200, 3)):
        rows = [(i, f"a{r.randrange(ids)}", f"b{r.randrange(ids)}", r.randrange(ids)) for i in range(n)]
        seen, want = ({}, {}, {}), {}
        for i, *keys in rows:
            again = next((name for name, k, s in zip("abc", keys, seen) if k in s), None)
            want[i] = again
            if again is None:
                for k, s in zip(keys, seen):
                    s[k] = i
        got = crosswalk.first_accepted(spark.createDataFrame(rows, "n long, a string, b string, c long").repartition(3), "n", ["a", "b", "c"]).collect()
        assert {x.n: x.duplicate_of for x in got} == want


def accepted_in_order(rows):
    seen, want = ({}, {}), {}
    for i, *keys in sorted(rows):
        want[i] = next((name for name, k, s in zip("ab", keys, seen) if k is not None and k in s), None)
        if want[i] is None:
            for k, s in zip(keys, seen):
                s[k] = i
    return want


def test_a_chain_of_ten_thousand_rows_is_decided(spark):
    chain = [(i, f"k{i}", f"k{i + 1}x") if i % 2 else (i, f"k{i + 1}", f"k{i}x") for i in range(10_000)]  # each row shares a key with the one before and after it
    other = [(20_000 + i, None, f"n{i % 3}") for i in range(9)] + [(30_000 + i, None, None) for i in range(3)] + [(40_000 + i, "hot", f"h{i // 2}") for i in range(50)]
    rows = chain + other
    t = spark.createDataFrame(rows, "n long, a string, b string").repartition(4)
    got = {r.n: r.duplicate_of for r in crosswalk.first_accepted(t, "n", ["a", "b"]).collect()}
    assert got == accepted_in_order(rows)
    short = [r for r in rows if r[0] < 24 or r[0] >= 20_000]  # groups too large for one task go on in rounds
    got = {r.n: r.duplicate_of for r in crosswalk.first_accepted(t.filter("n < 24 or n >= 20000"), "n", ["a", "b"], fold_rows=3).collect()}
    assert got == accepted_in_order(short)


def test_groups_through_shared_keys(spark):
    path, star = [(i, i + 1) for i in range(100, 170)], [(9, i) for i in range(10, 40)]
    got = {r.node: r.group for r in connected(spark.createDataFrame(path + star + [(3, 3)], "u long, v long")).collect()}
    assert got == {i: 100 for i in range(100, 171)} | {i: 9 for i in range(9, 40)}
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_composed_crosswalk_against_the_rules_in_order(spark):
    got = {r.n: (r.reason, r.crosswalk_season) for r in plans.composed_crosswalk(spark, SF).collect()}
    customers = [r[0] for r in table(spark, SF, "customer").select("c_custkey").collect()]
    authority = {f"b{k}": k * 10 for k in customers if k % 7}
    static = [(k * 10 + (k % 5 == 0), f"a{k + (k % 9 == 0)}" if k % 3 == 0 else None, 1990 if k % 2 == 0 else None) for k in customers if k % 4 == 0]
    by_a, by_c = {a: (c, s) for c, a, s in static if a}, {c: (a, s) for c, a, s in static}
    seen, want = (set(), set(), set()), {}
    for n, k, y in sorted(tuple(r) for r in table(spark, SF, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate")).collect()):
        a, b, c = f"a{k + (n % 17 == 0)}", f"b{k}", k * 10 + (n % 13 == 0)
        reason = None
        if n % 19 == 0:
            reason = "invalid_overlay_row"
        elif b not in authority:
            reason = "unknown_b"
        elif authority[b] != c:
            reason = "b_c_conflict"
        elif a in by_a and by_a[a][0] != c:
            reason = "static_a_conflict"
        elif c in by_c and by_c[c][0] is not None and by_c[c][0] != a:
            reason = "static_c_conflict"
        else:
            reason = next((f"duplicate_{name}" for name, x, s in zip("abc", (a, b, c), seen) if x in s), None)
        if reason is None:
            for x, s in zip((a, b, c), seen):
                s.add(x)
        static_season = by_a[a][1] if a in by_a else by_c[c][1] if c in by_c else None
        want[n] = (reason, (static_season or y) if reason is None else None)
    assert got == want and len({r for r, _ in want.values()}) >= 6


def test_running_sums_are_the_same_however_large_keys_are_cut(spark):
    r = random.Random(5)
    rows = [(["x", "y", None][min(i % 9, 2)] if i % 9 < 3 else "x", r.choice([None, *range(40)]), float(r.randrange(5))) for i in range(2000)]
    t = spark.createDataFrame(rows, "k string, v int, w double")
    want = sorted(map(str, running(t, ["k"], "v", {"w": F.col("w")}).collect()))
    assert want == sorted(map(str, running(t, ["k"], "v", {"w": F.col("w")}, split_rows=100).collect()))
    x = cohorts.cohort_percent_rank(t, ["k"], "v", "p", split_rows=100).groupBy("k").agg(F.min("p").alias("a"), F.max("p").alias("b")).collect()
    assert all(r.a == 0 for r in x)
    alone = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    assert [r.p for r in cohorts.cohort_percent_rank(alone, ["k"], "v", "p", least_peers=1, alone=100.0).orderBy("k").collect()] == [100.0, None]


def test_windows_widen_and_entities_weigh_once(spark):
    rows = [("repeat", 2000, 21, 1.0), ("repeat", 2001, 22, 3.0), ("other", 2000, 23, 5.0), ("current", 2025, 22, 4.0), ("current", 2020, 22, 9.0)]
    t = spark.createDataFrame([("c", *x) for x in rows], "g string, e string, s int, age int, v double")
    standing = lambda least: cohorts.adaptive_window_percentile(t.filter("s = 2025"), t, ["g"], "age", "v", "e", "s", least=least, split_rows=1).first()
    assert (standing(2).window, standing(2).percentile) == (1, 50.0) and (standing(1).window, standing(1).percentile) == (0, 100.0)
    assert (standing(3).window, standing(3).percentile) == (None, None)


def test_page_counts_and_queries():
    assert publication.BoardQuery.parse([("page", "2"), ("ids", "a,b")]) == publication.BoardQuery(ids=("a", "b"), page=2)
    for bad in ([("page", "0")], [("page", "1"), ("page", "2")], [("nope", "1")], [("q", "a\x00")], [("ids", "a,a")], [("sort", "x")], [("limit", "1.5")], [("limit", "²")]):
        with pytest.raises(ValueError):
            publication.BoardQuery.parse(bad)


def test_pages_have_a_count(spark):
    t = spark.range(101)
    rows, pages = publication.page_of(t, [F.col("id")], 3, 50)
    assert [r.id for r in rows.collect()] == [100] and pages == 3 and publication.page_of(t.limit(0), [F.col("id")], 1, 50)[1] == 1


def test_roles_and_expected_ages(spark):
    t = spark.createDataFrame([(30, 40, "x"), (30, 0, "x"), (0, 40, "x"), (None, None, "x")], "b int, p int, r string")
    assert [r[0] for r in t.coalesce(1).select(careers.appearance_role(F.col("b"), F.col("p"), F.col("r"))).collect()] == ["two_way", "hitter", "pitcher", "x"]


def test_champion_is_chosen_on_its_own_part_and_judged_on_another(spark):
    rows = spark.range(4000).withColumn("x", F.rand(3)).withColumn("y", (F.rand(4) < F.col("x")).cast("double")).withColumn("g", F.lit("g")).cache()
    parts = {n: rows.filter(f"id % 4 = {i}") for i, n in enumerate(("train", "calibrate", "select", "test"))}
    fits = {"good": lambda train: lambda t: t.withColumn("probability", F.col("x")), "flat": lambda train: lambda t: t.withColumn("probability", F.lit(0.5)), "wrong": lambda train: lambda t: t.withColumn("probability", 1 - F.col("x"))}

    def calibrate(scored, p):
        found = models.calibrations(scored, "g", p, "y")
        return lambda t: models.calibrated(t, found, "g", p, "calibrated")

    best, judged = evaluation.champion(fits, parts, "y", calibrate)
    assert best == "good" and judged.count() == 1000 and judged.filter("calibrated is null").count() == 0


def test_new_queries_are_registered():
    names = set(registry.queries())
    assert {"risk_set", "membership_collapse", "landmark_panel", "composed_crosswalk", "built_crosswalk", "drift_cells", "rolling_backtest", "debut_bridge", "scenario_bank", "roster_census"} <= names
    assert not [n for n in names if n.endswith("_all")]
