"""Stacks and champions, predictions out of fold, exact resampling, and paired scenarios."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitwise.operators import metrics, scenarios
from pitwise.plans import ensembles, models

SEED = 29


@pytest.fixture(scope="module")
def labelled(spark):
    t = spark.range(2400).withColumn("e", F.col("id") % 600).withColumn("x", F.rand(3)).withColumn("z", F.rand(5))
    t = t.withColumn("y", (F.rand(4) < 0.1 + 0.8 * F.col("x")).cast("double")).withColumn("weight", F.lit(0.25)).withColumn("debut", (F.col("e") % 30).cast("int"))
    parts = F.array(*[F.lit(p) for p in ("train", "train", "stack", "select", "test")])
    return t.withColumn("g", F.floor(F.col("x") * 3)).withColumn("part", F.get(parts, (F.col("e") % 5).cast("int"))).cache()


def families():
    return {
        "flat": ensembles.prior_family([["part"]], "y", "weight"),
        "banded": ensembles.prior_family([["g"]], "y", "weight"),
        "logistic": ensembles.model_family("logistic", ["x", "z"], [], "y", "weight"),
        "trees": ensembles.model_family("trees", ["x", "z"], [], "y", "weight", iterations=3),
    }


def rows_of(scores, part):
    return sorted((r.family, round(r.brier, 12), round(r.log_loss, 12)) for r in scores.filter(F.col("part") == part).collect())


def test_labels_of_the_test_part_cannot_move_the_choice(labelled):
    run = lambda t: ensembles.tournament(t, "part", families(), "y", "weight", ["id"])
    first = run(labelled)
    turned = labelled.withColumn("y", F.when(F.col("part") == "test", 1 - F.col("y")).otherwise(F.col("y")))
    second = run(turned)
    assert first.champion == second.champion and rows_of(first.scores, "select") == rows_of(second.scores, "select")
    assert rows_of(first.scores, "test") != rows_of(second.scores, "test")
    best = min(rows_of(first.scores, "select"), key=lambda r: (r[1], r[0]))
    assert best[0] == first.champion and [r.family for r in first.scores.filter("champion and part = 'test'").collect()] == [first.champion]
    assert set(f for f, *_ in rows_of(first.scores, "test")) == {*families(), ensembles.ENSEMBLE}
    again = first.predict(labelled.filter("part = 'test'"), "p").select("id", "p").collect()
    told = {r.id: r[first.champion] for r in first.judged.filter("part = 'test'").collect()}
    assert len(again) == len(told) and all(abs(told[r.id] - r.p) < 1e-9 for r in again)


def test_the_second_model_is_the_penalised_optimum_on_logits(labelled):
    t = labelled.withColumn("a", F.col("x") * 0.98 + 0.01).withColumn("b", F.col("z") * 0.98 + 0.01)
    made = ensembles.on_logits(t, ["a", "b"], "y", "weight", 0.5)(t, "p").select("a", "b", "y", "p").toPandas()
    a, b, y, p = (made[c].to_numpy() for c in ("a", "b", "y", "p"))
    d = np.column_stack([np.log(a / (1 - a)), np.log(b / (1 - b)), np.ones(len(a))])
    w, ridge = np.zeros(3), np.array([1.0, 1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-d @ w))
        h = (d * (0.5 * 0.25 * q * (1 - q))[:, None]).T @ d
        w = w - np.linalg.solve(h + np.diag(ridge), 0.5 * 0.25 * d.T @ (q - y) + ridge * w)
    assert np.abs(1 / (1 + np.exp(-d @ w)) - p).max() < 1e-4
    with pytest.raises(ValueError):
        ensembles.on_logits(t.filter("y = 1"), ["a"], "y", "weight", 1.0)


def test_an_era_with_too_few_is_only_told(labelled):
    few = {"flat": families()["flat"], "banded": families()["banded"]}
    got = {r.cutoff: r for r in ensembles.era_sensitivity(labelled, "part", few, "banded", "y", "weight", ["id"], "e", "debut", (0, 10, 29)).collect()}
    assert got[29].status == "insufficient_training_outcomes" and got[29].brier is None
    assert got[0].status == got[10].status == "descriptive" and got[0].entities == 240 > got[10].entities and got[10].brier > 0
    whole = ensembles.tournament(labelled, "part", few, "y", "weight", ["id"]).scores.filter("part = 'test' and family = 'banded'").first()
    assert got[0].brier == pytest.approx(whole.brier, abs=1e-12)


def test_an_era_fits_only_what_its_champion_needs(labelled, monkeypatch):
    few, fits, own = {"flat": families()["flat"], "banded": families()["banded"]}, [], ensembles.on_logits
    monkeypatch.setattr(ensembles, "on_logits", lambda rows, names, *a: fits.append(names) or own(rows, names, *a))
    era = lambda champion: ensembles.era_sensitivity(labelled, "part", few, champion, "y", "weight", ["id"], "e", "debut", (0,)).first().brier
    assert era("banded") > 0 and fits == [["raw_banded"]]
    assert era(ensembles.ENSEMBLE) > 0 and sorted(fits[1:]) == [["raw_banded"], ["raw_banded", "raw_flat"], ["raw_flat"]]


def test_models_side_by_side_are_prepared_once(labelled, monkeypatch):
    made, own = [], models.preparation
    monkeypatch.setattr(models, "preparation", lambda *a: made.append(a) or own(*a))
    kinds = {"a": ("logistic", {}), "b": ("trees", {"iterations": 2, "least": 5})}
    both, train = ensembles.model_families(kinds, ["x", "z"], ["part"], "y", "weight"), labelled.filter("part = 'train'")
    fitted = ensembles.together(labelled.sparkSession, {n: lambda f=f: f(train) for n, f in both.items()})
    assert len(made) == 1
    for n, (kind, options) in kinds.items():
        alone = models.classifier(kind, ["x", "z"], ["part"], "y", "weight", **options).fit(train)
        got = {r.id: r.p for r in fitted[n](labelled, "p").select("id", "p").collect()}
        assert got == pytest.approx({r.id: r.p for r in models.predict(alone, labelled, "p").select("id", "p").collect()}, abs=1e-12)


def test_out_of_fold_rows_are_predicted_once_by_what_lay_before(spark):
    r = np.random.default_rng(2)
    rows = [(f"e{i % 40}", f"e{i % 40}/{i // 40}/{h}" if i % 3 else f"e{i % 40}/{i // 40}", 2000 + i // 40, 2000 + i // 40 + h, "ab"[h % 2], int(r.random() < 0.4)) for i in range(400) for h in (1, 2)]
    rows += [("late", "late", 2009, 2010, "c", 1)]
    t = spark.createDataFrame(rows, "e string, s string, origin int, known int, g string, y int")
    made, support = ensembles.out_of_fold(t, "origin", "known", "e", "s", "y", ensembles.prior_family([["g"]], "y"), list(range(1999, 2010)), groups="g", least_rows=60, least_events=5)
    status = {x.fold: x.status for x in support.collect()}
    learnt = lambda o: [x for x in rows if max(x[3], x[2] + 1) <= o]
    assert [status[o] for o in (1999, 2000, 2001, 2002)] == ["few_rows", "few_rows", "few_rows", "fitted"] and status[2009] == "unsupported_groups"
    want = {}
    for o in (o for o, s in status.items() if s == "fitted"):
        known = learnt(o)
        mean = sum(x[5] for x in known) / len(known)
        for x in (x for x in rows if x[2] == o):
            own = [k[5] for k in known if k[4] == x[4]]
            want[x[:5]] = ((sum(own) + 20 * mean) / (len(own) + 20), not any(k[0] == x[0] for k in known))
    got = made.collect()
    assert len(got) == len(want) and {(x.e, x.s, x.origin, x.known, x.g): (round(x.probability, 9), x.cold) for x in got} == {k: (round(p, 9), c) for k, (p, c) in want.items()}
    assert {x.fold for x in got} == {o for o, s in status.items() if s == "fitted"} and all(x.fold == x.origin for x in got)
    by_entity = {}
    for x in got:
        by_entity[x.e] = by_entity.get(x.e, 0.0) + x.weight
    assert all(abs(v - 1) < 1e-9 for v in by_entity.values())
    nothing, none = ensembles.out_of_fold(t, "origin", "known", "e", "s", "y", ensembles.prior_family([["g"]], "y"), [1999], groups="g")
    assert nothing.count() == 0 and none.first().status == "few_rows"


def test_draws_of_all_blocks_sum_to_the_clusters():
    for clusters, size in ((1, 4), (7, 4), (64, 8), (1000, 64), (1025, 256)):
        counts = np.hstack([metrics.multiplicities(SEED, clusters, size, b, 300) for b in range(-(-clusters // size))])
        assert counts.shape == (300, clusters) and (counts.sum(1) == clusters).all() and (counts >= 0).all()
    many = np.hstack([metrics.multiplicities(3, 100, 8, b, 20_000) for b in range(13)])
    assert np.abs(many.mean(0) - 1).max() < 0.05 and np.abs(many.var(0) - 0.99).max() < 0.07
    assert abs(np.corrcoef(many[:, 0], many[:, 99])[0, 1] + 1 / 99) < 0.03 and abs(np.corrcoef(many[:, 0], many[:, 1])[0, 1] + 1 / 99) < 0.03
    assert (metrics.multiplicities(3, 100, 8, 4, 9) != metrics.multiplicities(4, 100, 8, 4, 9)).any()


def test_replicates_resample_clusters_alike_in_all_cells(spark):
    r = np.random.default_rng(7)
    rows = [(int(c), ["x", "y", None][int(r.integers(3))], float(r.random())) for c in r.integers(0, 150, 900)]
    t = spark.createDataFrame(rows, "c long, g string, v double").repartition(3)
    sums = {"mean": (F.col("v"), F.lit(1.0)), "same": (F.lit(2.0), F.lit(1.0))}
    got = metrics.cluster_bootstrap(t, "c", sums, replicates=200, cells=("g",), block=32).collect()
    assert all(abs(x.same - 2) < 1e-12 for x in got if x.same is not None) and len(got) == 600
    # the same draw as with other blocks of rows, from the numbers that clusters get
    from pitwise.operators.ranking import ranked

    numbers = {x.c: x.n - 1 for x in ranked(t.select("c").distinct().withColumn("h", F.xxhash64(F.lit(29), F.col("c").cast("string"))), [F.col("h"), F.col("c")], "n").collect()}
    n = len(numbers)
    counts = np.hstack([metrics.multiplicities(29, n, 32, b, 200) for b in range(-(-n // 32))])
    for x in got:
        own = [(counts[x.replicate, numbers[c]], v) for c, g, v in rows if g == x.g]
        assert x["mean"] == pytest.approx(sum(k * v for k, v in own) / sum(k for k, _ in own))


def test_gates_of_paired_improvements(spark):
    r = np.random.default_rng(1)
    rows = []
    for i in range(3000):
        p = r.random()
        rows.append((i % 300, "abcd"[i % 4], float(r.random() < p), p, 0.5, p, 1 - p))
    t = spark.createDataFrame(rows, "c int, g string, y double, model double, half double, same double, wrong double")
    points, drawn = metrics.paired_improvements(t, "c", ("g",), "y", "model", ["half", "same", "wrong"], replicates=300)
    got = {x.baseline: x for x in metrics.macro_comparison(points, drawn, ("g",)).collect()}
    assert got["half"].passed and got["wrong"].passed and got["half"].macro_low < got["half"].macro < got["half"].macro_high
    assert not got["same"].passed and got["same"].macro == got["same"].macro_low == got["same"].macro_high == 0 and got["same"].none_worse
    turned, again = metrics.paired_improvements(t, "c", ("g",), "y", "half", ["model"], replicates=300)
    (x,) = metrics.macro_comparison(turned, again, ("g",)).collect()
    assert not x.none_worse and not x.macro_ok and x.worse >= 1


def quantiles(values, weights, levels):
    order = np.argsort(values, kind="stable")
    v, w = np.asarray(values)[order], np.asarray(weights)[order]
    return np.interp(levels, (np.cumsum(w) - w / 2) / w.sum(), v)


def test_one_scenario_is_moved_across_where_a_tail_has_none():
    final, second = np.zeros((2, 8)), np.zeros((2, 8))
    moved, weights, shift = scenarios.tilted(final, second, np.array([10.0, -10.0]), np.array([0.05, 0.9]))
    assert shift[0] > 0 > shift[1] and (np.count_nonzero(moved, axis=1) == 1).all()
    assert ((moved[0] + second[0]) / 2 >= 10).sum() == 1 and ((moved[1] + second[1]) / 2 < -10).sum() == 1
    assert weights[0][moved[0] != 0].sum() == pytest.approx(0.05) and weights[1][moved[1] == 0].sum() == pytest.approx(0.9) and np.allclose(weights.sum(1), 1)


def test_banks_edges_and_distributions_match_plain_numpy(spark):
    r = np.random.default_rng(11)
    rows = [(i, f"p{i % 130}", ["hitter", "pitcher"][i % 130 % 2], 1 + i // 130, round(float(r.gamma(2, 3)), 3), round(float(r.normal()), 3), round(float(r.normal()), 3)) for i in range(910)]
    t = spark.createDataFrame(rows, "id int, e string, role string, n int, v double, r1 double, r2 double").repartition(3)
    least = {"all": 0, "role": 20, "stage": 50, "role_stage": 60, "tier": 18}
    edges, bank = scenarios.paired_bank(t, "role", "n", "v", "r1", "r2", "e", draws=64, least=least)
    stage = lambda n: "first" if n == 1 else "seasons_2_3" if n <= 3 else "seasons_4_6" if n <= 6 else "seasons_7_10" if n <= 10 else "season_11_plus"
    people = lambda g: len({x[1] for x in g})
    groups, cut, names = {"0": rows}, {}, {}
    for x in rows:
        for k in (f"1/{x[2]}", f"2/{stage(x[3])}", f"3/{x[2]}/{stage(x[3])}"):
            groups.setdefault(k, []).append(x)
    for k, g in list(groups.items()):
        if k[0] == "3" and people(g) >= 60:
            cut[k] = np.quantile([x[4] for x in g], [0.7, 0.9])
            for x in g:
                tier = "top_10" if x[4] >= cut[k][1] else "upper_30" if x[4] >= cut[k][0] else "base_70"
                groups.setdefault("4" + k[1:] + "/" + tier, []).append(x)
                names[x[0]] = tier
    need = {"0": 0, "1": 20, "2": 50, "3": 60, "4": 18}
    want = {}
    for k, g in groups.items():
        if people(g) >= need[k[0]]:
            n = {}
            for x in g:
                n[x[1]] = n.get(x[1], 0) + 1
            pairs = sorted((x[5], x[6], 1 / n[x[1]]) for x in g)
            upto = np.cumsum([p[2] for p in pairs]) / sum(p[2] for p in pairs)
            at = np.minimum(np.searchsorted(upto, (np.arange(64) + 0.5) / 64 - 1e-9), len(pairs) - 1)
            want[k] = np.array([pairs[i][:2] for i in at])
    got = bank.orderBy("bank", "draw").toPandas()
    assert set(got.bank) == set(want) and all(np.array_equal(g[["first", "second"]].to_numpy(), want[k]) for k, g in got.groupby("bank"))
    found = {f"3/{x.role}/{x.stage}": x.edges for x in edges.collect()}
    assert set(found) == set(cut) and all(np.allclose(found[k], cut[k]) for k in cut)

    chosen = scenarios.with_bank(t, edges, bank, "role", "n", "v").withColumn("floor", F.col("v") / 2).withColumn("standard", F.lit(6.0) + F.col("n")).withColumn("p", F.col("id") % 10 / 10)
    plain = {x.id: x for x in scenarios.scenario_distributions(chosen, bank, ["id"], "v", "v", "floor", "standard").collect()}
    made = {x.id: x for x in scenarios.scenario_distributions(chosen, bank, ["id"], "v", "v", "floor", "standard", "p").collect()}
    levels = np.array(scenarios.LEVELS)
    for i, _, role, n, v, *_ in rows:
        s = stage(n)
        keys = [f"4/{role}/{s}/{names.get(i)}", f"3/{role}/{s}", f"2/{s}", f"1/{role}", "0"]
        d = want[next(k for k in keys if k in want)]
        one, two, standard, p = v + d[:, 0], np.maximum(v / 2, v + d[:, 1]), 6.0 + n, min(max(i % 10 / 10, 1e-6), 1 - 1e-6)
        assert plain[i].probability == pytest.approx(np.mean((one + two) / 2 >= standard)) and np.allclose(plain[i].blend, np.quantile((one + two) / 2, levels))
        margin, shift = (one + two) / 2 - standard, 0.0
        if not (margin >= 0).any() or (margin >= 0).all():
            k = margin.argmax() if not (margin >= 0).any() else margin.argmin()
            shift = -margin[k] + (1e-6 if margin[k] < 0 else -1e-6)
            one = one.copy()
            one[k] += 2 * shift
        elite = (one + two) / 2 >= standard
        w = np.where(elite, p / elite.sum(), (1 - p) / (~elite).sum())
        for name, values in (("final", one), ("second", two), ("blend", (one + two) / 2), ("margin", (one + two) / 2 - standard)):
            assert np.allclose(made[i][name], quantiles(values, w, levels), atol=1e-9)
        assert made[i].shift == pytest.approx(shift) and made[i].probability == pytest.approx(p)
    told = scenarios.extension_summary(spark.createDataFrame([(0.0,), (2.0,), (-4.0,), (0.0,)], "shift double")).first()
    assert (told.rows, told.extended, told.rate, told["median"], told.most) == (4, 2, 0.5, 3.0, 4.0)
    assert scenarios.extension_summary(spark.createDataFrame([], "shift double")).first().extended == 0
