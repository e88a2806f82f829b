"""Paired scenarios: what became of others like it, as pairs of residuals that stay together,
tilted so that a tail has a given probability."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitwise.operators.evaluation import residual_bank
from pitwise.operators.sizes import broadcast_if_small
from pitwise.operators.split import exact_quantiles

#: The last seasons of the stages, shares of the tiers, and the entities that a
#: bank of each kind must have at least.
STAGES = ((1, "first"), (3, "seasons_2_3"), (6, "seasons_4_6"), (10, "seasons_7_10"))
LAST_STAGE = "season_11_plus"
TIERS = (0.7, 0.9)
LEAST = {"all": 0, "role": 20, "stage": 50, "role_stage": 50, "tier": 50}
LEVELS = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)
EPSILON, CLIP = 1e-6, 1e-6


def stage(season_number: Column) -> Column:
    out = F.lit(LAST_STAGE)
    for last, name in reversed(STAGES):
        out = F.when(season_number <= last, name).otherwise(out)
    return out


def tier_edges(rows: DataFrame, role: str, value: str, entity: str, least: int) -> DataFrame:
    """``role, stage, edges``: where the tiers of each role and stage with entities enough begin."""
    enough = rows.groupBy(role, "stage").agg(F.countDistinct(entity).alias("__n")).filter(F.col("__n") >= least).select(role, "stage")
    return exact_quantiles(rows.join(broadcast_if_small(enough), [role, "stage"]), [role, "stage"], value, TIERS, "edges")


def tiered(rows: DataFrame, edges: DataFrame, role: str, value: str) -> DataFrame:
    """``tier`` by the edges of the row's role and stage; null where there are none."""
    met = rows.join(broadcast_if_small(edges), [role, "stage"], "left")
    upper, top = F.col("edges")[0], F.col("edges")[1]
    return met.withColumn("tier", F.when(F.col(value) >= top, "top_10").when(F.col(value) >= upper, "upper_30").when(F.col("edges").isNotNull(), "base_70")).drop("edges")


def paired_bank(rows: DataFrame, role: str, season_number: str, value: str, first: str, second: str, entity: str, draws: int = 2048, least: dict[str, int] = LEAST) -> tuple[DataFrame, DataFrame]:
    """Edges of the tiers, and the bank: ``bank, draw, first, second`` for all rows, each role, each
    stage, each role's stage, and each tier of those. In a bank each entity weighs the same."""
    t = rows.withColumn("stage", stage(F.col(season_number)))
    edges = tier_edges(t, role, value, entity, least["role_stage"])
    t = tiered(t, edges, role, value)
    levels = [([], least["all"]), ([role], least["role"]), (["stage"], least["stage"]), ([role, "stage"], least["role_stage"])]
    bank = residual_bank(t, first, second, None, levels, entity, draws)
    tiers = residual_bank(t.filter("tier is not null"), first, second, None, [([role, "stage", "tier"], least["tier"])], entity, draws, names=("4",))
    return edges, bank.unionByName(tiers)


def with_bank(rows: DataFrame, edges: DataFrame, bank: DataFrame, role: str, season_number: str, value: str) -> DataFrame:
    """``bank``, the narrowest that there is: tier, role and stage, stage, role, all."""
    t = tiered(rows.withColumn("stage", stage(F.col(season_number))), edges, role, value)
    there = bank.select("bank").distinct()
    for i, keys in enumerate(([], [role], ["stage"], [role, "stage"], [role, "stage", "tier"])):
        key = F.concat(F.lit(str(i)), *[x for k in keys for x in (F.lit("/"), F.col(k).cast("string"))])
        t = t.withColumn(f"__k{i}", key).join(broadcast_if_small(there.select(F.col("bank").alias(f"__b{i}"))), F.col(f"__k{i}") == F.col(f"__b{i}"), "left")
    return t.withColumn("bank", F.coalesce(*[F.col(f"__b{i}") for i in (4, 3, 2, 1, 0)])).drop(*[f"__{c}{i}" for c in "kb" for i in range(5)])


def weighted_quantiles_of_rows(values: np.ndarray, weights: np.ndarray, levels: tuple[float, ...]) -> np.ndarray:
    """Rows x levels: linear between the middles of the weights, held at the ends."""
    order = np.argsort(values, axis=1, kind="stable")
    v, w = np.take_along_axis(values, order, 1), np.take_along_axis(weights, order, 1)
    at = (np.cumsum(w, axis=1) - w / 2) / w.sum(1, keepdims=True)
    return np.stack([np.interp(levels, a, x) for a, x in zip(at, v)]) if len(v) else np.zeros((0, len(levels)))


def tilted(final: np.ndarray, second: np.ndarray, standard: np.ndarray, probability: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scenarios (rows x draws), weights and extensions: those whose mean of both reaches the standard
    have the probability together. Where all lie on one side, the nearest is moved across
    by twice its distance in the first of the pair, the second left as it is."""
    final, margin = final.copy(), (final + second) / 2 - standard[:, None]
    hit = (margin >= 0).sum(1)
    shift = np.zeros(len(final))
    none, every = np.flatnonzero(hit == 0), np.flatnonzero(hit == final.shape[1])
    for rows, best, sign in ((none, margin[none].argmax(1), 1), (every, margin[every].argmin(1), -1)):
        shift[rows] = -margin[rows, best] + sign * EPSILON
        final[rows, best] += 2 * shift[rows]
    elite = (final + second) / 2 - standard[:, None] >= 0
    p, n = np.clip(probability, CLIP, 1 - CLIP)[:, None], elite.sum(1, keepdims=True)
    return final, np.where(elite, p / np.maximum(n, 1), (1 - p) / np.maximum(final.shape[1] - n, 1)), shift


def scenario_distributions(
    rows: DataFrame, bank: DataFrame, key: list[str], final: str, second: str, floor: str, standard: str, probability: str | None = None, levels: tuple[float, ...] = LEVELS
) -> DataFrame:
    """``key, probability, shift`` and arrays of quantiles at ``levels`` of ``final``, ``second``, their mean (``blend``) and its
    ``margin`` over the standard. Scenarios are the row's centres plus its bank's pairs; the second of a pair does not fall below the ``floor``. With ``probability`` they are tilted to it,
    without it all weigh the same and it is the share that reaches the standard."""
    packed = bank.groupBy("bank").agg(F.array_sort(F.collect_list(F.struct("draw", "first", "second"))).alias("__d"))  # as many as there are draws
    packed = packed.select("bank", F.transform("__d", lambda d: d["first"]).alias("__first"), F.transform("__d", lambda d: d["second"]).alias("__second"))
    source = F.col(probability).cast("double") if probability else F.lit(None).cast("double")
    numbers = [F.col(c).cast("double").alias(f"__{i}") for i, c in enumerate((final, second, floor, standard))]
    met = rows.select(*key, "bank", *numbers, source.alias("__p")).join(broadcast_if_small(packed, 1_000), "bank")
    outputs = ("final", "second", "blend", "margin")

    def distribute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), 256):
                f = frame.iloc[lo : lo + 256]
                for draws, g in f.groupby(f["__first"].map(len)):
                    a, b, low, standards = (g[f"__{i}"].to_numpy() for i in range(4))
                    one = a[:, None] + np.stack(g["__first"].to_numpy())
                    two = np.maximum(low[:, None], b[:, None] + np.stack(g["__second"].to_numpy()))
                    if probability:
                        p = g["__p"].to_numpy()
                        one, weights, shift = tilted(one, two, standards, p)
                        p = np.clip(p, CLIP, 1 - CLIP)
                    else:
                        weights, shift = np.full(one.shape, 1.0 / draws), np.zeros(len(g))
                        p = ((one + two) / 2 >= standards[:, None]).mean(1)
                    blend = (one + two) / 2
                    made = g[key].copy()
                    made["probability"], made["shift"] = p, shift
                    for name, values in zip(outputs, (one, two, blend, blend - standards[:, None])):
                        q = weighted_quantiles_of_rows(values, weights, levels) if probability else np.quantile(values, levels, axis=1).T
                        made[name] = list(q)
                    yield made

    schema = T.StructType([*[rows.schema[k] for k in key], T.StructField("probability", T.DoubleType()), T.StructField("shift", T.DoubleType()), *[T.StructField(o, T.ArrayType(T.DoubleType())) for o in outputs]])
    return met.mapInPandas(distribute, schema)


def extension_summary(made: DataFrame) -> DataFrame:
    """One row: how many rows had to be extended, and by how much."""
    used = F.abs("shift") > 1e-12
    size = exact_quantiles(made.filter(used).withColumn("__s", F.abs("shift")), [], "__s", (0.5, 0.9, 1.0), "__q")
    counts = made.agg(F.count("*").alias("rows"), F.count_if(used).alias("extended"))
    out = counts.join(F.broadcast(size), how="left")  # one row each
    at = lambda i: F.coalesce(F.get("__q", F.lit(i)), F.lit(0.0))
    return out.select("rows", "extended", (F.col("extended") / F.nullif(F.col("rows"), F.lit(0))).alias("rate"), at(0).alias("median"), at(1).alias("p90"), at(2).alias("most"))
