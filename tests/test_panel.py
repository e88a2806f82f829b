"""Point-in-time panels: roles, modes, standards and targets of single careers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pitwise.functions.roster import position_code
from pitwise.operators import panel

STANDARDS = [("C", 40.0), ("1B", 50.0), ("2B", 50.0), ("3B", 50.0), ("SS", 50.0), ("LF", 50.0), ("CF", 60.0), ("RF", 50.0), ("P", 55.0), ("RP", 30.0)]
SCHEMA = "entity string, season int, season_state string, age double, position string, b_pa double, p_ip_outs double, p_games double, p_games_started double, b_war double, p_war double, total_war double"


def hitter(who, year, value, position="*6/H", state="complete", age=None, **more):
    row = dict(entity=who, season=year, season_state=state, age=float(age or 22 + year % 10), position=position, b_pa=500.0, p_ip_outs=0.0, p_games=0.0, p_games_started=0.0, b_war=value, p_war=0.0, total_war=value)
    return row | more


def pitcher(who, year, value, position="1", **more):
    return hitter(who, year, value, position, b_pa=0.0, b_war=0.0, p_ip_outs=540.0, p_games=30.0, p_games_started=25.0, p_war=value) | more


@pytest.fixture(scope="module")
def of(spark):
    standards = panel.with_fallbacks(spark.createDataFrame(STANDARDS, "position string, value double"), "position", "value")

    def made(rows, as_of=2020, **k):
        t = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)
        return panel.career_panel(t.repartition(3), standards, as_of, **k).orderBy("entity", "season").collect()

    return made


def test_codes_of_positions(spark):
    want = {
        "H8/79": "CF", "9D/H": "RF", "D3/5H": "1B", "D/H": "DH", "1": "P", "SS": "SS", "PITCHER": "P", "Catcher": "C", "Shortstop": "SS", "Starter": "P", "UTIL/SS": "SS", "7/LF": "LF", "*6/H": "SS", "OF": "UNKNOWN", " c ": "C", "": "UNKNOWN", "nan": "UNKNOWN",
        "relief pitcher": "P", "ReliefPitcher": "RP", "x, y; 2b": "2B", "Dee": "DH", "8/1": "CF", "*#": "UNKNOWN", "1B/3B": "1B",
    }
    t = spark.createDataFrame([(k,) for k in want] + [(None,)], "x string")
    assert {r.x: r.p for r in t.select("x", position_code(F.col("x")).alias("p")).collect()} == want | {None: "UNKNOWN"}


def test_the_position_is_the_mode_so_far_and_targets_take_the_last(of):
    a, b = of([hitter("p", 1990, 25.0, "2", age=22), hitter("p", 1991, 25.0, "8", age=23)])
    assert [(r.position, r.standard_key, r.standard) for r in (a, b)] == [("C", "C", 40.0), ("CF", "CF", 60.0)]  # equal weights: the later
    assert [(r.target_standard_key, r.target_standard, r.reaches_standard, r.reaches_final_standard) for r in (a, b)] == [("CF", 60.0, True, False), ("CF", 60.0, False, False)]
    modes = of([hitter("p", 1990 + i, 1.0, code, b_pa=pa) for i, (code, pa) in enumerate([("2", 300.0), ("8", 200.0), ("8", 50.0), ("8", 0.0), ("8", 49.0), ("2", 0.0)])])
    assert [r.position for r in modes] == ["C", "C", "C", "C", "CF", "C"]  # 251 to 300, then 300 to 300, then 301


def test_starters_and_relievers(of):
    got = of([pitcher("p", 1990, 20.0, p_games=80.0, p_games_started=0.0), pitcher("p", 1991, 20.0, p_games=80.0, p_games_started=80.0)])
    assert [(r.standard_key, r.standard, r.reaches_standard, r.target_eligible, r.broad_role_switch) for r in got] == [("RP", 30.0, True, True, False), ("P", 55.0, False, True, False)]


@pytest.mark.parametrize("code", ["DH", "?"])
def test_a_derived_standard_is_no_target(of, code):
    (r,) = of([hitter("f", 1990, 50.0, code)])
    assert (r.standard_key, r.standard, r.target_fallback, r.target_eligible, r.target_reason) == ("HITTER_FALLBACK", 50.0, True, False, "synthetic_standard_fallback")
    assert r.standard_warning == "standard_fallback:" + ("dh" if code == "DH" else "unknown")


@pytest.mark.parametrize("first", ["hitter", "pitcher"])
def test_a_broad_switch_is_no_target(of, first):
    rows = [hitter("s", 1990, 3.0, "6"), pitcher("s", 1991, 3.0)] if first == "hitter" else [pitcher("s", 1990, 3.0, p_ip_outs=270.0), hitter("s", 1991, 3.0, "6")]
    got = of(rows)
    assert {r.role for r in got} == {"hitter", "pitcher"} and [r.broad_role_switch for r in got] == [False, True]
    assert {(r.target_eligible, r.target_reason) for r in got} == {(False, "broad_role_switch")}


def test_careers_that_may_go_on_have_no_targets(of):
    rows = [hitter("retired", 2010, 3.0), hitter("recent", 2024, 3.0), hitter("active", 2025, 3.0), hitter("active", 2026, 1.0, state="in_season"), hitter("new", 2026, 1.0, state="in_season")]
    got = {r.entity: r for r in of(rows, 2026)}
    assert set(got) == {"retired", "recent", "active"} and got["retired"].resolved and got["retired"].final_value == 3.0
    assert all(not got[w].resolved and got[w].final_blend is None and got[w].target_eligible is None and got[w].reaches_standard is None for w in ("recent", "active"))
    assert [r.resolved for r in of([hitter("a", 2022, 1.0), hitter("b", 2023, 1.0)], 2025)] == [True, False]


def test_entities_of_the_current_roster_have_no_targets(spark, of):
    active = spark.createDataFrame([("back",), ("back",), ("other",)], "entity string")
    (r,) = of([hitter("back", 2019, 3.0)], 2025, active=active)
    assert not r.resolved and r.final_value is None
    with pytest.raises(ValueError):
        of([hitter("x", 2019, 1.0)], 2025, quiet=1)


def test_the_value_follows_the_role(of):
    p, h = pitcher("p", 1990, 4.0) | {"b_war": 20.0, "total_war": 24.0}, hitter("h", 1990, 4.0, "6") | {"p_war": 20.0, "p_ip_outs": 3.0, "p_games": 1.0, "total_war": 24.0}
    assert [(r.entity, r.role, r.value_to_date, r.final_value) for r in of([p, h])] == [("h", "hitter", 4.0, 4.0), ("p", "pitcher", 4.0, 4.0)]


def test_batting_pitchers_are_not_two_way(of):
    rows = [pitcher("pb", 1990 + i, 4.0, "1/H", b_pa=70.0, b_war=0.2, total_war=4.2) for i in range(8)]
    rows[0] |= {"b_pa": 200.0, "p_ip_outs": 750.0}
    rows.append(hitter("tw", 1998, 5.0, "8/1", b_pa=400.0, b_war=3.0, p_ip_outs=150.0, p_war=2.0))
    rows.append(hitter("lim", 1998, 2.0, "D/1", b_pa=70.0, b_war=1.0, p_ip_outs=75.0, p_war=1.0))
    got = of(rows)
    assert {r.role for r in got if r.entity == "pb"} == {"pitcher"}
    assert [(r.role, r.position, r.standard_key, r.value_to_date, r.target_reason) for r in got if r.entity in ("tw", "lim")] == [("two_way", "TWO_WAY", "PITCHER_FALLBACK", v, "two_way_role_path") for v in (2.0, 5.0)]


def test_prefix_values(of):
    values = [1.0, -2.0, 3.0, 8.0, 5.0, 4.0, 2.0, 9.0, 0.5]
    got = of([hitter("p", 1990 + i, v, age=None if i != 3 else 30) for i, v in enumerate(values)])
    for n, r in enumerate(got, 1):
        past = values[:n]
        assert (r.season_number, r.value_to_date, r.peak_to_date, r.best_to_date, r.positive_seasons) == (n, sum(past), sum(sorted(past)[-7:]), max(past), sum(v > 0 for v in past))
        assert r.last_three == pytest.approx(sum(past[-3:]) / len(past[-3:])) and r.blend_to_date == (r.value_to_date + r.peak_to_date) / 2 and r.years_since_debut == n - 1


def test_roles_of_seasons(spark):
    rows = [(0.0, 0.0, "Pitcher"), (0.0, 0.0, "x"), (70.0, 75.0, "hitter"), (70.0, 750.0, "two_way"), (500.0, None, None)]
    t = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, b double, o double, told string")
    got = t.orderBy("i").select(panel.season_role(F.col("b"), F.col("o"), F.col("told")).alias("r")).collect()
    assert [r.r for r in got] == ["pitcher", "hitter", "two_way", "pitcher", "hitter"]


def test_scoring_rows_of_current_entities(spark):
    standards = panel.with_fallbacks(spark.createDataFrame(STANDARDS, "position string, value double"), "position", "value")
    two = {"b_pa": 400.0, "p_ip_outs": 200.0, "b_war": 3.0, "p_war": 2.0, "total_war": 5.0}
    rows = [hitter("old", 2018, 2.0), hitter("on", 2019, 2.0), hitter("on", 2020, 4.0), hitter("on", 2021, 9.0, state="in_season"), hitter("new", 2021, 1.5, "8", state="in_season"), hitter("tw", 2019, 5.0) | two, hitter("tw", 2020, 5.0) | two | {"b_war": -1.0}, hitter("tw", 2021, 1.0, state="in_season")]
    t = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA).repartition(3)
    got = {r.entity: r for r in panel.scoring_rows(t, standards, 2021).collect()}
    assert set(got) == {"on", "new", "tw"}
    assert (got["on"].season, got["on"].value_to_date, got["on"].feature_partial) == (2020, 6.0, False) and (got["new"].season, got["new"].value_to_date, got["new"].position, got["new"].feature_partial) == (2021, 1.5, "CF", True)
    x = got["tw"]
    assert (x.role, x.position, x.standard_key, x.standard, x.standard_fallback, x.two_way_policy) == ("hitter", "DH", "HITTER_FALLBACK", 50.0, False, True)
    assert (x.value_to_date, x.peak_to_date, x.season_value, x.last_three, x.best_to_date, x.positive_seasons) == (2.0, 2.0, -1.0, 1.0, 3.0, 1)
    named = panel.scoring_rows(t, standards, 2021, current=spark.createDataFrame([("old",), ("gone",)], "entity string")).collect()
    assert [(r.entity, r.season) for r in named] == [("old", 2018)]
    done = panel.scoring_rows(t.filter("season_state = 'complete'"), standards, 2021).collect()
    assert sorted(r.entity for r in done) == ["on", "tw"]  # those of the last season


def test_only_careers_that_are_over_are_gone_through_if_asked(of):
    rows = [hitter("a", y, 3.0) for y in (2001, 2002, 2003)] + [hitter("b", y, 4.0) for y in (2017, 2018)] + [pitcher("c", 2004, 2.0), hitter("c", 2005, 1.0, state="in_season"), pitcher("d", 2010, 5.0)]
    every, done = of(rows), of(rows, over=True)
    assert done == [r for r in every if r.resolved] and {r.entity for r in done} == {"a", "d"} and len(every) > len(done)
