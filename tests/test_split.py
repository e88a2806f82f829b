"""Places, exact quantiles and neighbours of large groups, cut into many parts."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitwise.operators import evaluation, ranking, split


def test_quantiles_of_one_key_over_many_parts_are_those_of_numpy(spark):
    r = random.Random(4)
    rows = [("one", r.gauss(0, 9)) for _ in range(3000)] + [("ties", float(r.randrange(3))) for _ in range(500)] + [("few", 2.0), ("few", None), ("none", None), (None, 1.5), (None, 2.5)]
    t = spark.createDataFrame(rows, "k string, v double").repartition(5)
    levels = (0.0, 0.1, 0.25, 0.5, 0.7, 0.9, 1.0)
    want = {k: np.quantile([v for x, v in rows if x == k and v is not None], levels) for k in ("one", "ties", "few", None)}
    for size in (split.SPLIT_ROWS, 200):
        got = {x.k: x.quantiles for x in split.exact_quantiles(t, ["k"], "v", levels, split_rows=size).collect()}
        assert set(got) == set(want) and all(np.allclose(got[k], want[k], rtol=1e-12) for k in want)
        assert np.allclose(split.exact_quantiles(t, [], "v", levels, split_rows=size).first().quantiles, np.quantile([v for _, v in rows if v is not None], levels))
    assert split.exact_quantiles(t.limit(0), ["k"], "v", levels).count() == 0


def test_no_part_holds_a_large_key_and_repeats_are_summed_first(spark):
    t = spark.range(20_000).select(F.lit("k").alias("k"), (F.col("id") % 5_000).alias("v")).unionByName(spark.range(50_000).select(F.lit("k").alias("k"), F.lit(7).cast("long").alias("v")))
    parts = {}
    real = split.cut

    def spy(df, name):
        out = real(df, name)
        if name == "ranged":
            parts["most"], parts["rows"] = out.groupBy("__part").count().agg(F.max("count")).first()[0], out.count()
        return out

    split.cut = spy
    try:
        placed = split.placed_values(t, ["k"], "v", {"n": F.lit(1)}, split_rows=100)
    finally:
        split.cut = real
    assert parts["rows"] == 5_000 and parts["most"] < 1_000  # 70,000 rows are 5,000 values over 50 parts
    assert placed.filter("v = 7").select("tied_n", "upto_n", "all_n").first() == (50_004, 50_032, 70_000)


def test_ranks_within_few_groups(spark):
    r = random.Random(8)
    rows = [(r.choice(["a", "b", None]), r.choice([None, 1.0, 2.0, 3.0]), i) for i in range(400)]
    t = spark.createDataFrame(rows, "g string, v double, i int").repartition(4)
    got = {x.i: x.rank for x in ranking.ranked(t, ranking.ordering(("v", "desc"), ("i", "asc")), within=["g"]).collect()}
    for g in ("a", "b", None):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is None, -(x[1] or 0), x[2]))
        assert [got[i] for *_, i in own] == list(range(1, len(own) + 1))
    kept = {x.i for x in ranking.top_share(t, ["g"], ranking.ordering(("v", "desc"), ("i", "asc")), 0.2).collect()}
    assert kept == {i for g, _, i in rows if got[i] <= -(-sum(x[0] == g for x in rows) // 5)}
    live = {x.i: x.rank for x in ranking.rank_among(t.filter("i < 50"), t.filter("i >= 50"), "v", "i", ["g"]).collect()}
    assert live == {i: 1 + sum(h == g and j >= 50 and (w is not None) >= (v is not None) and (v is None or w >= v) for h, w, j in rows) for g, v, i in rows if i < 50}


def neighbours(points, rows, width, least, most):
    out = []
    for g, p in points:
        own = [x for x in rows if x[0] == g and x[1] is not None]
        local = [x for x in own if abs(x[1] - p) <= width]
        taken = local if len(local) >= least else sorted(own, key=lambda x: (abs(x[1] - p), x[2]))[:most]
        out += [(g, p, i) for _, _, i in taken]
    return sorted(out)


def test_nearest_rows_are_those_of_a_full_comparison(spark):
    r = random.Random(6)
    rows = [("many", round(r.gauss(25, 2), 1), i) for i in range(300)] + [("few", float(r.randrange(18, 40)), 1000 + i) for i in range(40)] + [("tied", 20.0, 2000 + i) for i in range(60)] + [("tied", 26.0, 3000 - i) for i in range(60)] + [("few", None, 9)]
    points = [(g, p) for g in ("many", "few", "tied", "empty") for p in (10.0, 19.5, 20.0, 23.0, 25.3, 26.0, 44.0)]
    t, p = spark.createDataFrame(rows, "g string, v double, i int").repartition(3), spark.createDataFrame(points, "g string, at double")
    for width, least, most in ((1.0, 20, 15), (0.3, 5, 100), (2.0, 61, 7)):
        for size in (split.SPLIT_ROWS, 20):
            got = evaluation.nearest_or_local(p, t, ["g"], "at", "v", "i", width, least, most, split_rows=size)
            assert sorted((x.g, x.point, x.i) for x in got.collect()) == neighbours(points, rows, width, least, most)


def test_quantiles_of_noisy_sums_are_duckdbs_to_the_last_bit(spark):
    duckdb = pytest.importorskip("duckdb")
    r = random.Random(8)
    rows = [(g, r.randrange(200) / 100 + r.randrange(200) / 100 + r.randrange(200) / 100) for g in range(150) for _ in range(r.randrange(2, 60))]
    t = spark.createDataFrame(rows, "g int, v double")
    got = {x.g: list(x.quantiles) for x in split.exact_quantiles(t, ["g"], "v", (0.7, 0.9)).collect()}
    con = duckdb.connect()
    con.register("t", t.toPandas())
    assert got == {g: [a, b] for g, a, b in con.sql("SELECT g, quantile_cont(v, 0.7), quantile_cont(v, 0.9) FROM t GROUP BY 1").fetchall()}
