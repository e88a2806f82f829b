"""Audits of labels, splits, admissions, subgroups and leakage. What is wrong is a row or
a column that names it, never an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitwise.operators.split import exact_quantiles

#: Limits of an admission.
DRIFT_LIMITS = {"missing": 0.05, "jump": 0.05, "unseen": 0.02, "psi": 0.20}
PSI_SMOOTHING = 1e-6


def first_violation(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that is violated (true), null if none is."""
    return F.coalesce(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules])


def outcome_label_violation(as_of: Column, state: Column, event: Column, censored: Column, followup: Column, horizon: Column) -> Column:
    """What is wrong with an outcome label against its snapshot's date and its horizon in
    months (null: none): times before the snapshot, a censoring that does not end the
    follow-up, an event or a censoring beyond the horizon, an immature non-event."""
    end = F.add_months(as_of, horizon)
    cut = state.isin("right_censored", "lost_to_coverage")
    return first_violation(
        ("followup_before_snapshot", followup < as_of), ("event_before_snapshot", event < as_of), ("censored_before_snapshot", censored < as_of),
        ("censoring_does_not_end_followup", cut & ~censored.eqNullSafe(followup)),
        ("event_after_horizon", horizon.isNotNull() & (state == "observed_event") & (event > end)),
        ("non_event_not_mature", horizon.isNotNull() & (state == "observed_non_event") & (followup < end)),
        ("censored_at_or_after_horizon", horizon.isNotNull() & cut & (censored >= end)),
    )


def split_violation(feature_at: Column, label_at: Column, part: Column, begin: Column, end: Column, predicted_at: Column | None = None) -> Column:
    """What is wrong with a row's place in a temporal split: features outside of the
    partition's time, a training label that is known only after it, features made
    after the prediction that uses them."""
    rules = [("feature_before_partition", feature_at < begin), ("feature_after_partition", feature_at >= end), ("label_not_available", part.isin("train", "calibration") & (label_at > end))]
    if predicted_at is not None:
        rules.append(("feature_after_prediction", feature_at > predicted_at))
    return first_violation(*rules)


def label_semantics(labels: DataFrame, as_of: str, event: str, state: str, cutoff: Column, horizons: tuple[int, ...]) -> DataFrame:
    """``rule, n``: labels that differ from what their dates say. Observed and event of each
    horizon (``observed_12m``, ``event_12m``) are worked out anew and compared; an
    unobserved horizon must have no event label."""
    a, e = F.col(as_of), F.col(event)
    rules = {
        "no_landmark": a.isNull(), "as_of_after_cutoff": a > cutoff, "event_outside_window": e.isNotNull() & ((e <= a) | (e > cutoff)),
        "censor_state": ~F.col(state).eqNullSafe(F.when(e.isNotNull(), "event").otherwise("right_censored")),
    }
    for h in horizons:
        end = F.add_months(a, h)
        within = F.coalesce(e <= end, F.lit(False))
        seen = within | (end <= cutoff)
        rules[f"observed_{h}m"] = ~F.col(f"observed_{h}m").eqNullSafe(seen)
        rules[f"event_{h}m"] = F.when(seen, ~F.col(f"event_{h}m").eqNullSafe(within)).otherwise(F.col(f"event_{h}m").isNotNull())
    counts = labels.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad in rules.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules])))


def set_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: values only in the left, only in the right, in both; whether the sets are
    equal, and whether they are disjoint."""
    both = left.select(key, F.lit(1).alias("side")).unionByName(right.select(key, F.lit(2).alias("side")))
    each = both.groupBy(key).agg(F.bool_or(F.col("side") == 1).alias("a"), F.bool_or(F.col("side") == 2).alias("b"))
    out = each.agg(F.count_if(F.col("a") & ~F.col("b")).alias("left_only"), F.count_if(F.col("b") & ~F.col("a")).alias("right_only"), F.count_if(F.col("a") & F.col("b")).alias("shared"))
    return out.withColumn("equal", (F.col("left_only") + F.col("right_only")) == 0).withColumn("disjoint", F.col("shared") == 0)


def drift_cells(training: DataFrame, evaluation: DataFrame, role: str, season: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """``season, role, feature, missing, training_missing, jump, unseen, psi``: how each
    feature of each evaluated season and role differs from the role's training rows.

    ``psi`` is the stability index of a number over the training deciles and a bin of the
    missing; ``unseen`` the share of a category's values that training does not have. All
    features are stacked, so one plan serves them all whatever their number."""
    features = [*numeric, *categorical]
    finite = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c).cast("double"))
    as_rows = F.array(*[F.struct(F.lit(c).alias("feature"), (finite(c) if c in numeric else F.lit(None).cast("double")).alias("x"), (F.lit(None).cast("string") if c in numeric else F.col(c).cast("string")).alias("s")) for c in features])
    stack = lambda rows, *keys: rows.select(*keys, F.inline(as_rows)).withColumn("gone", F.col("x").isNull() & F.col("s").isNull())
    t, e = stack(training, role), stack(evaluation, season, role)
    inner = exact_quantiles(t, [role, "feature"], "x", tuple(i / 10 for i in range(1, 10)), "inner")
    edges = t.groupBy(role, "feature").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n_training"), F.avg(F.col("gone").cast("int")).alias("training_missing")).join(inner, [role, "feature"], "left")
    # the outer quantiles are no edges, nor is an inner one that equals them
    edges = edges.withColumn("inner", F.filter(F.array_distinct("inner"), lambda q: (q > F.col("low")) & (q < F.col("high"))))

    def binned(rows: DataFrame) -> DataFrame:
        met = rows.join(edges.select(role, "feature", "inner"), [role, "feature"])
        return met.withColumn("bin", F.when(F.col("x").isNull(), -1).otherwise(F.size(F.filter("inner", lambda q: q < F.col("x")))))

    number = F.col("feature").isin(*numeric) if numeric else F.lit(False)
    a = binned(t.filter(number)).groupBy(role, "feature", "bin").agg(F.count("*").alias("a"))
    b = binned(e.filter(number)).groupBy(season, role, "feature", "bin").agg(F.count("*").alias("b"))
    cells = e.groupBy(season, role, "feature").agg(F.count("*").alias("rows"), F.avg(F.col("gone").cast("int")).alias("missing"))
    bins = edges.select(role, "feature", "n_training", F.explode(F.sequence(F.lit(-1), F.size("inner"))).alias("bin"), (F.size("inner") + 2).alias("bins"))
    grid = cells.filter(number).select(season, role, "feature", F.col("rows").alias("n")).join(bins, [role, "feature"])
    grid = grid.join(a, [role, "feature", "bin"], "left").join(b, [season, role, "feature", "bin"], "left")
    share = lambda c, n: (F.coalesce(c, F.lit(0)) + PSI_SMOOTHING) / (F.col(n) + PSI_SMOOTHING * F.col("bins"))
    expected, actual = share("a", "n_training"), share("b", "n")
    psi = grid.groupBy(season, role, "feature").agg(F.sum((actual - expected) * F.log(actual / expected)).alias("psi"))
    known = t.filter("s is not null").select(role, "feature", "s").distinct().withColumn("known", F.lit(1))
    unseen = e.filter("s is not null").join(known, [role, "feature", "s"], "left").groupBy(season, role, "feature").agg(F.avg(F.col("known").isNull().cast("int")).alias("unseen"))
    out = cells.join(edges.select(role, "feature", "training_missing"), [role, "feature"]).join(psi, [season, role, "feature"], "left").join(unseen, [season, role, "feature"], "left")
    unseen_or_none = F.when(~number, F.coalesce("unseen", F.lit(0.0)))
    return out.select(season, role, "feature", "rows", "missing", "training_missing", F.abs(F.col("missing") - F.col("training_missing")).alias("jump"), unseen_or_none.alias("unseen"), "psi")


def admission(cells: DataFrame, integrity: dict[str, Column] | None = None, limits: dict[str, float] = DRIFT_LIMITS) -> DataFrame:
    """One row: the worst of each measure, the gates that fail, and the verdict: quarantine
    if integrity fails (``integrity`` are conditions over the cells' aggregates), blocked
    from promotion if only the distribution shifts, else admitted."""
    worst = cells.agg(*[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in limits], *[ok.alias(f"__{n}") for n, ok in (integrity or {}).items()])
    sound = F.array_compact(F.array(*[F.when(~F.coalesce(f"__{n}", F.lit(False)), n) for n in integrity or {}], F.lit(None).cast("string")))
    shift = F.array_compact(F.array(*[F.when(F.col(c) > at, c) for c, at in limits.items()]))
    # fixed values: the three verdicts
    status = F.when(F.size(sound) > 0, "integrity_fail_quarantine").when(F.size(shift) > 0, "admission_pass_distribution_shift_promotion_blocked").otherwise("admission_pass")
    return worst.select(*limits, F.array_join(F.concat(sound, shift), ",").alias("failed"), status.alias("status"), (F.size(sound) == 0).alias("score_allowed"), (F.size(F.concat(sound, shift)) == 0).alias("promotion_eligible"))


def subgroup_adjudication(cells: DataFrame, role: str, improvement: str, sufficient: str, tolerance: float = 0.0) -> DataFrame:
    """``role, groups, sufficient_groups, estimate, passed``: of each role the mean
    improvement over its sufficient groups, each weighing the same; groups with too
    little support are counted and take no part. A role without any has no estimate and
    does not fail."""
    ok = F.coalesce(F.col(sufficient), F.lit(False))
    out = cells.groupBy(role).agg(F.count("*").alias("groups"), F.count_if(ok).alias("sufficient_groups"), F.avg(F.when(ok, F.col(improvement))).alias("estimate"))
    return out.withColumn("passed", F.coalesce(F.col("estimate") >= -tolerance, F.lit(True)))


def cold_start_adjudication(rows: DataFrame, cell: list[str], cold: str, loss: str, baseline_loss: str, least: int = 100, tolerance: float = 0.01) -> DataFrame:
    """For each cell, cold and returning rows: support, mean improvement over the baseline,
    and whether a stratum with support is worse than the baseline by more than allowed."""
    out = rows.groupBy(*cell, cold).agg(F.count("*").alias("rows"), F.avg(F.col(baseline_loss) - F.col(loss)).alias("improvement"))
    enough = F.col("rows") >= least
    return out.withColumn("sufficient", enough).withColumn("passed", ~enough | (F.col("improvement") >= -tolerance))


def split_leakage(rows: DataFrame, part: str, name: str, label: str, stale: Column) -> DataFrame:
    """One row: names of train and test and those in both, their share of the test's
    names, the accuracy on the test of always saying no, and negatives that are stale."""
    names = rows.groupBy(name).agg(F.bool_or(F.col(part) == "train").alias("a"), F.bool_or(F.col(part) == "test").alias("b"))
    sets = names.agg(F.count_if("a").alias("train_names"), F.count_if("b").alias("test_names"), F.count_if(F.col("a") & F.col("b")).alias("overlap"))
    facts = rows.agg(F.avg(F.when(F.col(part) == "test", (F.col(label) == 0).cast("int"))).alias("all_negative_accuracy"), F.count_if((F.col(label) == 0) & F.coalesce(stale, F.lit(False))).alias("stale_negatives"))
    return sets.join(F.broadcast(facts)).withColumn("overlap_share", F.col("overlap") / F.nullif(F.col("test_names"), F.lit(0)))  # one row each


def quarantine_stale(members: DataFrame, teams: DataFrame, team: str, parent: str, claimed: str) -> tuple[DataFrame, DataFrame]:
    """The members whose current team belongs to the organisation they are listed with (or
    to none that is known), and for each organisation how many were put aside."""
    met = members.join(teams.select(team, F.col(parent).alias("__parent")), team, "left")
    fits = F.col("__parent").isNull() | (F.col("__parent") == F.col(claimed))
    return met.filter(F.coalesce(fits, F.lit(True))).select(*members.columns), met.groupBy(claimed).agg(F.count_if(~F.coalesce(fits, F.lit(True))).alias("quarantined"), F.count("*").alias("members"))


def schema_fingerprint(docs: DataFrame, doc: str) -> DataFrame:
    """One row: ``shape``, a JSON array of the keys of the JSON objects, in order, each with the
    kinds that its values have in JSON (so the string "12" is a string), and ``fingerprint``,
    its digest. Texts that are not JSON objects have no keys."""
    parsed = docs.select(F.try_parse_json(F.col(doc)).alias("v")).filter("schema_of_variant(v) like 'OBJECT%'")
    fields = parsed.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("v").outer())).select("key", F.schema_of_variant("value").alias("t"))
    named = F.when(F.col("t") == "VOID", "null").when(F.col("t").startswith("ARRAY"), "array").when(F.col("t").startswith("OBJECT"), "object").when(F.col("t") == "BOOLEAN", "boolean").when(F.col("t") == "STRING", "string").otherwise("number")
    shape = fields.groupBy("key").agg(F.array_sort(F.collect_set(named)).alias("kinds"))  # six kinds at most
    quoted = lambda what: F.regexp_extract(F.to_json(F.array(what)), r"(?s)^\[(.*)\]$", 1)
    entry = F.concat(F.lit("["), quoted(F.col("key")), F.lit(","), F.to_json("kinds"), F.lit("]"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("key", entry.alias("text")))), lambda e: e["text"])  # a row a key
    text = F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]"))
    return shape.agg(text.alias("shape")).withColumn("fingerprint", F.sha2("shape", 256))
