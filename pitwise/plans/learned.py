"""Queries over learned models; no SQL gives their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitwise.plans import models
from pitwise.plans.catalog import query, r6, table


def _rows(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    commas = F.length("text") - F.length(F.replace("text", F.lit(","), F.lit("")))
    return d.select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"), commas.cast("double").alias("commas"), F.col("quality").cast("double").alias("y"))


@query()
def logistic_model(spark, sf):
    rows = _rows(spark, sf)
    model = models.classifier("logistic", ["n_chars", "commas"], ["lang"], "y").fit(rows.filter("doc_id % 2 = 0"))
    return models.predict(model, rows.filter("doc_id % 2 = 1")).select("doc_id", "lang", "y", r6("probability").alias("probability"))


@query()
def calibrated_model(spark, sf):
    scored = logistic_model(spark, sf)
    table_ = models.calibrations(scored, "lang", "probability", "y")
    return models.calibrated(scored, table_, "lang", "probability", "calibrated")


@query()
def mixture_quantiles(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", ((F.col("c_custkey") % 10) / 10).alias("zero"), F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: i * 10.0).alias("points"))
    return models.mixture_quantiles(rows, "zero", "points", (0.1, 0.25, 0.5, 0.75, 0.9), "quantiles")
