"""Queries over the relational operators, with the SQL that must agree with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitwise.plans import analysis, careers, core, evaluations, learned, panels
from pitwise.plans.catalog import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.latest_standing(spark, sf_dir)


def queries():
    assert analysis and careers and core and evaluations and learned and panels  # they fill the register
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
