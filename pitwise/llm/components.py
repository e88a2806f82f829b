"""Connected components of links that lie in a table, by alternating stars.

Each round points the larger neighbours of every node at the least of its
neighbourhood (large star), then the smaller ones (small star); the edges end as
stars around the least node of each component, after about log(n) rounds on paths
and two or three on the shallow groups that copies make. Nothing is collected: every
round is two aggregations and two joins, cut on the shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut, forget

MAX_ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    """``u, m``: the least of each node's neighbours and itself."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined = both.join(_least(both), "u").filter("v > u")
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        joined = down.join(_least(down), "u")
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of all nodes in ``edges`` (``u, v``, both long and not
    null, ``u <> v``); a component is named by its least node."""
    edges = cut(edges.select("u", "v").distinct(), "edges")
    before = _mark(edges)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        last, edges = edges, cut(_star(_star(edges, True), False), "edges")
        forget(last)
        now = _mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")
    ends = edges.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("component"))
    return ends.union(ends.select(F.col("component").alias("node"), "component")).distinct()
