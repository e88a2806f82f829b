"""Families of models side by side: calibrated, stacked, chosen and judged on rows that none of
them saw, and predictions out of fold.

A *family* is a function of training rows that gives a function of rows and a name, which adds a
probability. Families are fitted at the same time, each a Spark job of its own; what they predict
is written once, and calibrations, the stack and all scores work on that table of a few numbers a row."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitwise.operators.aggregates import two_level_weights
from pitwise.operators.evaluation import smoothed_priors, with_prior
from pitwise.operators.metrics import brier, log_loss
from pitwise.operators.ranking import ranked
from pitwise.plans import models
from pitwise.sources.scratch import cut

Predict = Callable[[DataFrame, str], DataFrame]
Family = Callable[[DataFrame], Predict]
ENSEMBLE = "calibrated_ensemble"
CLIP = 1e-6
#: Fits that run at the same time.
SIDE_BY_SIDE = 4


def together(spark: SparkSession, work: dict[str, Callable[[], object]]) -> dict[str, object]:
    """Results by name of functions that run side by side, in threads of the driver that wait for Spark."""
    if not work:
        return {}
    with ThreadPoolExecutor(min(SIDE_BY_SIDE, len(work))) as pool:
        started = {name: pool.submit(inheritable_thread_target(spark)(f)) for name, f in work.items()}
        return {name: s.result() for name, s in started.items()}


def prior_family(levels: list[list[str]], y: str, weight: str | None = None, strength: float = 20.0) -> Family:
    """Smoothed rates of the most detailed level that has the row's keys."""

    def fit(train: DataFrame) -> Predict:
        priors = [cut(t, "priors") for t in smoothed_priors(train, levels, y, weight, strength)]
        return lambda rows, name: with_prior(rows, levels, priors, name)

    return fit


def model_family(kind: str, numbers: list[str], categories: list[str], y: str, weight: str | None = None, **options) -> Family:
    def fit(train: DataFrame) -> Predict:
        model = models.classifier(kind, numbers, categories, y, weight, **options).fit(train)
        return lambda rows, name: models.predict(model, rows, name)

    return fit


def model_families(kinds: dict[str, tuple[str, dict]], numbers: list[str], categories: list[str], y: str, weight: str | None = None) -> dict[str, Family]:
    """``model_family`` by name, of a kind and its options: medians, scales and codes are learnt once for all
    that are fitted on the same table of training rows."""
    lock, last = Lock(), []

    def prepared(train: DataFrame) -> PipelineModel:
        with lock:
            if not last or last[0] is not train:
                last[:] = [train, models.preparation(numbers, categories).fit(train)]
            return last[1]

    def family(kind: str, options: dict) -> Family:
        def fit(train: DataFrame) -> Predict:
            first = prepared(train)
            second = models.learner(kind, y, weight, **options).fit(first.transform(train))
            return lambda rows, name: models.predict(PipelineModel([first, second]), rows, name)

        return fit

    return {name: family(kind, options) for name, (kind, options) in kinds.items()}


def logit(p: str) -> Column:
    q = F.least(F.greatest(F.col(p), F.lit(CLIP)), F.lit(1 - CLIP))
    return F.log(q / (1 - q))


def on_logits(rows: DataFrame, names: list[str], y: str, weight: str, c: float) -> Predict:
    """A second model on the logits of fitted ones: logistic regression with a ridge of ``1 / c``
    against the sum of the weighted losses. One name gives a sigmoid calibration, several a stack."""
    if rows.agg(F.min(y) < F.max(y)).first()[0] is not True:
        raise ValueError("a calibration needs rows of both classes")
    total = rows.agg(F.sum(weight)).first()[0]

    def featured(t: DataFrame) -> DataFrame:
        t = t.withColumns({f"__l{i}": logit(n) for i, n in enumerate(names)})
        return VectorAssembler(inputCols=[f"__l{i}" for i in range(len(names))], outputCol="__x").transform(t)

    second = LogisticRegression(featuresCol="__x", labelCol=y, weightCol=weight, regParam=1 / (c * total), maxIter=200, tol=1e-10, standardization=False, probabilityCol="__q", rawPredictionCol="__r", predictionCol="__c")
    model = second.fit(featured(rows))
    return lambda t, name: model.transform(featured(t)).withColumn(name, vector_to_array("__q")[1]).drop("__x", "__q", "__r", "__c", *[f"__l{i}" for i in range(len(names))])


@dataclass
class Tournament:
    champion: str
    scores: DataFrame  # part, family, rows, weight, brier, log_loss, base_brier, champion
    judged: DataFrame  # id columns, part, y, weight and a probability a family
    predict: Predict


def tournament(rows: DataFrame, part: str, families: dict[str, Family], y: str, weight: str, ids: list[str], stack_c: float = 0.5, sigmoid_c: float = 1.0, stacked: bool = True) -> Tournament:
    """``part`` of a row is ``train``, ``stack``, ``select`` or ``test``. Families are fitted on ``train``; each is
    calibrated, and all are stacked, on ``stack``; the least Brier score on ``select`` (the name
    on ties) makes the champion; scores on ``test`` are told, never looked at. Unless ``stacked`` there is no stack."""
    train = rows.filter(F.col(part) == "train")
    fitted = together(rows.sparkSession, {name: lambda fit=fit: fit(train) for name, fit in families.items()})
    names = sorted(families)
    scored = rows.filter(F.col(part) != "train")
    for name in names:
        scored = fitted[name](scored, f"raw_{name}")
    raw = cut(scored.select(*ids, part, F.col(y).cast("double").alias(y), weight, *[f"raw_{n}" for n in names]), "raw-predictions")
    stack = raw.filter(F.col(part) == "stack")
    wanted = {n: lambda n=n: on_logits(stack, [f"raw_{n}"], y, weight, sigmoid_c) for n in names}
    if stacked:
        wanted[ENSEMBLE] = lambda: on_logits(stack, [f"raw_{n}" for n in names], y, weight, stack_c)
    second = together(rows.sparkSession, wanted)

    def adjusted(t: DataFrame) -> DataFrame:
        for name, add in second.items():
            t = add(t, name)
        return t

    entrants = list(wanted)
    judged = cut(adjusted(raw).select(*ids, part, y, weight, *entrants), "judged-predictions")
    scores = cut(model_scores(judged.filter(F.col(part) != "stack"), [part], entrants, y, weight), "scores")
    chosen = scores.filter(F.col(part) == "select").orderBy("brier", "family").first()
    if chosen is None:
        raise ValueError("no rows to choose by")
    champion = chosen["family"]

    def predict(t: DataFrame, name: str) -> DataFrame:
        needed = names if champion == ENSEMBLE else [champion]
        out = t
        for n in needed:
            out = fitted[n](out, f"raw_{n}")
        return second[champion](out, name).drop(*[f"raw_{n}" for n in needed])

    return Tournament(champion, scores.withColumn("champion", F.col("family") == champion), judged, predict)


def model_scores(judged: DataFrame, keys: list[str], entrants: list[str], y: str, weight: str) -> DataFrame:
    """``keys, family, rows, weight, brier, log_loss, base_brier``: all families in one pass."""
    long = judged.unpivot([*keys, y, weight], entrants, "family", "p")
    p, t, w = F.col("p"), F.col(y), F.col(weight)
    mean = F.sum(w * t) / F.sum(w)
    return long.groupBy(*keys, "family").agg(F.count("*").alias("rows"), F.sum(w).alias("weight"), brier(p, t, w).alias("brier"), log_loss(p, t, w).alias("log_loss"), (mean * (1 - mean)).alias("base_brier"))


def era_sensitivity(rows: DataFrame, part: str, families: dict[str, Family], champion: str, y: str, weight: str, ids: list[str], entity: str, debut: str, cutoffs: tuple[int, ...], least_entities: int = 50, least_events: int = 20) -> DataFrame:
    """The champion fitted anew on entities that began in or after each cutoff, and its scores on the same
    test rows: ``cutoff, status, entities, events, brier, log_loss``. With too few it is only said so."""
    spark, out = rows.sparkSession, []
    ever = rows.filter(F.col(part) == "train").groupBy(entity, debut).agg(F.max(F.col(y).cast("int")).alias("__e"))
    support = ever.agg(*[F.count_if(F.col(debut) >= c).alias(f"n{c}") for c in cutoffs], *[F.count_if((F.col(debut) >= c) & (F.col("__e") == 1)).alias(f"e{c}") for c in cutoffs]).first()
    for c in cutoffs:
        n, e = support[f"n{c}"], support[f"e{c}"]
        if n < least_entities or e < least_events:
            out.append((c, "insufficient_training_outcomes", n, e, None, None))
            continue
        kept = rows.filter((F.col(part) == "test") | (F.col(debut) >= c))
        own = families if champion == ENSEMBLE else {champion: families[champion]}
        again = tournament(kept, part, own, y, weight, ids, stacked=champion == ENSEMBLE)
        s = again.scores.filter((F.col(part) == "test") & (F.col("family") == champion)).first()
        out.append((c, "descriptive", n, e, s["brier"], s["log_loss"]))
    return spark.createDataFrame(out, "cutoff int, status string, entities long, events long, brier double, log_loss double")


def top_precision(rows: DataFrame, p: str, y: str, tie: str, shares: tuple[float, ...] = (0.01, 0.05, 0.1)) -> DataFrame:
    """``share, rows, precision, lift`` of the ``ceil(share n)`` most probable rows; the tie column decides."""
    t = ranked(rows.select(p, y, tie), [F.col(p).desc(), F.col(tie)], "place")
    whole = t.agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("base"))  # one row
    cuts = F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.greatest(F.lit(1), F.ceil(F.col("n") * s)).alias("rows")) for s in shares]))
    wanted = whole.select("base", cuts.alias("x")).select("base", "x.*")
    top = t.join(F.broadcast(wanted), F.col("place") <= F.col("rows"))
    precision = F.avg(F.col(y).cast("double"))
    return top.groupBy("share", "rows").agg(precision.alias("precision"), (precision / F.nullif(F.first("base"), F.lit(0.0))).alias("lift"))


def out_of_fold(
    rows: DataFrame, origin: str, known: str, entity: str, snapshot: str, y: str, fit: Family, origins: list[int], groups: str | None = None, least_rows: int = 100, least_events: int = 10, name: str = "probability"
) -> tuple[DataFrame, DataFrame]:
    """Each row predicted once, by a model of rows that lie before it and whose outcome was ``known`` by its
    origin. Two tables: the rows of supported folds with ``fold``, ``cold`` (nothing of the entity was learnt from), ``probability`` and ``weight`` (entities weigh the same, and each one's
    snapshots); and ``fold, train_rows, events, test_rows, missing_groups, status``. A fold is skipped, and counted as such, when it has fewer than
    ``least_rows`` to learn from, fewer than ``least_events`` of either outcome, or test rows of ``groups`` that it never learnt."""
    learnt = F.greatest(F.col(known), F.col(origin) + 1)  # the first origin at which the row may be learnt from
    folds = F.array(*[F.lit(int(o)) for o in sorted(origins)])
    spread = rows.select(F.explode(folds).alias("fold"), origin, learnt.alias("__learnt"), F.col(y).cast("int").alias("__y"), *([F.col(groups).alias("__g")] if groups else []))
    train, test = F.col("__learnt") <= F.col("fold"), F.col(origin) == F.col("fold")
    by_group = spread.groupBy("fold", *(["__g"] if groups else [])).agg(F.count_if(train).alias("t"), F.count_if(train & (F.col("__y") == 1)).alias("e"), F.count_if(test).alias("n"))
    counts = by_group.groupBy("fold").agg(F.sum("t").alias("train_rows"), F.sum("e").alias("events"), F.sum("n").alias("test_rows"), F.count_if((F.col("t") == 0) & (F.col("n") > 0)).alias("missing_groups"))
    few = F.when(F.col("train_rows") < least_rows, "few_rows").when(F.least(F.col("events"), F.col("train_rows") - F.col("events")) < least_events, "few_outcomes")
    status = F.coalesce(few, F.when(F.col("test_rows") == 0, "no_test_rows"), F.when(F.col("missing_groups") > 0, "unsupported_groups"), F.lit("fitted"))
    support = cut(counts.withColumn("status", status), "folds")
    able = [r["fold"] for r in support.filter("status = 'fitted'").orderBy("fold").collect()]  # a row an origin
    first = F.min(learnt).over(Window.partitionBy(entity))
    marked = rows.withColumn("__first", first)

    def one(o: int) -> DataFrame:
        predict = fit(rows.filter(learnt <= o))
        mine = marked.filter(F.col(origin) == o).withColumn("fold", F.lit(o)).withColumn("cold", F.col("__first") > o).drop("__first")
        return cut(predict(mine, name), "fold")

    made = together(rows.sparkSession, {str(o): lambda o=o: one(o) for o in able})
    parts = [made[str(o)] for o in able] or [marked.limit(0).drop("__first").withColumns({"fold": F.lit(0), "cold": F.lit(False), name: F.lit(0.0)})]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return two_level_weights(out, entity, snapshot, "weight"), support

