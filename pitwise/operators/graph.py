"""Groups of rows that hang together through shared keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwise.sources.scratch import cut, forget

MAX_ROUNDS = 100


def _nearest(edges: DataFrame) -> DataFrame:
    """Each node with the least of itself and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("least"))


def connected(edges: DataFrame) -> DataFrame:
    """``node, group`` of all nodes of ``edges`` (``u, v``, of one type, neither null); a group
    is named by its least node. Larger neighbours are hung on the least of a
    neighbourhood, then smaller ones, in turns, until only stars are left: about as many
    rounds as the longest chain has digits in base two, each written."""
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        high = both.join(_nearest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        high = cut(high.filter("u <> v").distinct(), "edges")
        low = high.join(_nearest(high), "u")
        low = cut(low.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(low.select("u", F.col("least").alias("v"))).filter("u <> v").distinct(), "edges")
        forget(high)
        same = low.count() == now.count() and low.exceptAll(now).isEmpty()
        forget(now)
        now = low
        if same:
            nodes = now.select(F.col("u").alias("node"), F.col("v").alias("group"))
            return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("group")).distinct())
    raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")
