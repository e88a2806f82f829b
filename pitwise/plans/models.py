"""Learned baselines on pyspark.ml, and calibration pulled towards the identity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitwise.functions.numbers import interpolated

CLIP, RIDGE = 1e-6, 0.01


def preparation(numbers: list[str], categories: list[str]) -> Pipeline:
    """Median imputation, scaling and one-hot encoding."""
    filled, coded = [f"{c}__f" for c in numbers], [f"{c}__v" for c in categories]
    stages = [Imputer(inputCols=numbers, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="__numbers"), StandardScaler(inputCol="__numbers", outputCol="__scaled", withMean=True)]
    if categories:
        stages += [StringIndexer(inputCols=categories, outputCols=[f"{c}__i" for c in categories], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}__i" for c in categories], outputCols=coded)]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=["__scaled", *coded], outputCol="__features")])


def learner(kind: str, label: str, weight: str | None = None, iterations: int = 150, least: int = 100) -> LogisticRegression | GBTClassifier:
    """``logistic`` or ``trees`` (of ``least`` rows a leaf) over what ``preparation`` gives."""
    if kind == "logistic":
        model = LogisticRegression(featuresCol="__features", labelCol=label, regParam=1 / 0.25 / 1000, probabilityCol="__p", rawPredictionCol="__r", predictionCol="__c")
    elif kind == "trees":
        model = GBTClassifier(featuresCol="__features", labelCol=label, maxIter=iterations, stepSize=0.04, maxDepth=4, minInstancesPerNode=least, seed=29, predictionCol="__c")
        model.setProbabilityCol("__p").setRawPredictionCol("__r")
    else:
        raise ValueError(f"no model {kind}")
    if weight:
        model.setWeightCol(weight)
    return model


def classifier(kind: str, numbers: list[str], categories: list[str], label: str, weight: str | None = None, iterations: int = 150, least: int = 100) -> Pipeline:
    """``preparation`` and a ``learner``."""
    return Pipeline(stages=[*preparation(numbers, categories).getStages(), learner(kind, label, weight, iterations, least)])


def predict(model: PipelineModel, rows: DataFrame, name: str = "probability") -> DataFrame:
    return model.transform(rows).select(*rows.columns, vector_to_array("__p")[1].alias(name))


def _newton(d: np.ndarray, y: np.ndarray, w: np.ndarray, start: np.ndarray, towards: np.ndarray) -> np.ndarray:
    """The minimum of the weighted log loss and the ridge, which is convex: steps are halved
    until they lower it. It is an error if that does not settle."""

    def loss(a: np.ndarray) -> float:
        x = d @ a
        return float(np.sum(w * (np.logaddexp(0.0, x) - y * x)) + 0.5 * RIDGE * np.sum((a - towards) ** 2))

    a = start.astype(float)
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(d @ a, -700, 700)))
        gradient = d.T @ (w * (q - y)) + RIDGE * (a - towards)
        if np.abs(gradient).max() < 1e-9:
            return a
        step = np.linalg.solve(d.T @ (d * (w * q * (1 - q))[:, None]) + RIDGE * np.eye(len(a)), gradient)
        now, size = loss(a), 1.0
        while size > 1e-12 and loss(a - size * step) > now + 1e-15:
            size /= 2
        a = a - size * step
    raise ValueError("the calibration does not converge")


def _fit(p: np.ndarray, y: np.ndarray, w: np.ndarray, cold: np.ndarray) -> tuple[float, float, float]:
    """Intercept, slope and cold-start shift on the logit, pulled to (0, 1, 0). The slope is
    not negative: where the free optimum is, it is 0 and the others are fitted anew."""
    q = np.clip(p, CLIP, 1 - CLIP)
    d = np.stack([np.ones_like(q), np.log(q) - np.log1p(-q), cold], 1)
    w = w / w.sum()
    a = _newton(d, y, w, np.array([0.0, 1.0, 0.0]), np.array([0.0, 1.0, 0.0]))
    if a[1] < 0:
        other = _newton(d[:, [0, 2]], y, w, np.zeros(2), np.zeros(2))
        a = np.array([other[0], 0.0, other[1]])
    return float(a[0]), float(a[1]), float(a[2])


def calibrations(rows: DataFrame, by: str, p: str, y: str, weight: str | None = None, cold: str | None = None, resolution: int = 2000) -> DataFrame:
    """``by, intercept, slope, shift`` of each group; ``cold`` names rows (1) to which the shift
    applies. Rows are first summed to ``resolution`` bins of the logit, so that what is
    fitted in one task does not grow with the data."""
    w = F.col(weight) if weight else F.lit(1.0)
    c = F.coalesce(F.col(cold).cast("double"), F.lit(0.0)) if cold else F.lit(0.0)
    q = F.least(F.greatest(F.col(p), F.lit(CLIP)), F.lit(1 - CLIP))
    bin_ = F.round(F.log(q / (1 - q)) * (resolution / 28.0))
    binned = rows.groupBy(by, bin_.alias("bin"), c.alias("cold")).agg(F.sum(w).alias("w"), (F.sum(w * q) / F.sum(w)).alias("p"), (F.sum(w * F.col(y)) / F.sum(w)).alias("y"))
    schema = T.StructType([rows.schema[by], *[T.StructField(n, T.DoubleType()) for n in ("intercept", "slope", "shift")]])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, c = _fit(*(pdf[n].to_numpy() for n in ("p", "y", "w", "cold")))
        return pd.DataFrame({by: [pdf[by].iloc[0]], "intercept": [a], "slope": [b], "shift": [c]})

    return binned.groupBy(by).applyInPandas(fit, schema)


def calibrated(rows: DataFrame, table: DataFrame, by: str, p: str, name: str, cold: str | None = None) -> DataFrame:
    q = F.least(F.greatest(F.col(p), F.lit(CLIP)), F.lit(1 - CLIP))
    shift = F.col("shift") * F.coalesce(F.col(cold).cast("double"), F.lit(0.0)) if cold else F.lit(0.0)
    x = F.col("intercept") + F.col("slope") * F.log(q / (1 - q)) + shift
    return rows.join(table, by, "left").withColumn(name, 1 / (1 + F.exp(-x))).drop("intercept", "slope", "shift")


def mixture_quantiles(rows: DataFrame, zero: str, points: str, levels: tuple[float, ...], name: str) -> DataFrame:
    """Quantiles of a mixture of zero (with probability ``zero``) and a distribution given
    by its quantiles at the same levels, linear between them."""
    grid = F.array(*[F.lit(float(x)) for x in levels])

    def at(level):
        inner = (F.lit(float(level)) - F.col(zero)) / F.nullif(1 - F.col(zero), F.lit(0.0))
        return F.when(F.col(zero) >= level, F.lit(0.0)).otherwise(interpolated(inner, grid, F.col(points)))

    return rows.withColumn(name, F.array(*[at(x) for x in levels]))
