"""A register of queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


#: The customers' years stand for an entity's seasons.
SEASONS = """seasons AS (
 SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS season, round(sum(o_totalprice), 2) AS value, count(*) AS n,
        round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS a, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS b
 FROM orders GROUP BY 1, 2)"""


def seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    part = lambda s: F.round(F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))), 2)
    return o.groupBy(F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("season")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("value"), F.count("*").alias("n"), part("F").alias("a"), part("O").alias("b")
    )
