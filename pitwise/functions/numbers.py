"""Scores, roundings, bands and calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS_IN_YEAR = 365.2425
#: Anchors of the index and weights of its three levels.
ANCHORS = ((0.0, 0.0), (5.0, 20.0), (20.0, 45.0), (40.0, 65.0), (60.0, 80.0), (80.0, 92.0), (100.0, 100.0))
LEVEL_WEIGHTS = (0.5, 0.3, 0.2)


def interpolated(at: Column, xs: Column, ys: Column) -> Column:
    """The line through the points of two arrays (``xs`` rising) at ``at``, held at the ends;
    null without points, where they differ in number or where ``at`` is null."""
    n = F.size(xs)
    below = F.size(F.filter(xs, lambda x: x <= at))
    i = F.greatest(F.least(below, n - 1), F.lit(1))
    x0, x1, y0, y1 = (F.try_element_at(a, k.cast("int")) for a, k in ((xs, i), (xs, i + 1), (ys, i), (ys, i + 1)))
    inner = y0 + (at - x0) / F.nullif(x1 - x0, F.lit(0.0)) * (y1 - y0)
    first, last = F.try_element_at(ys, F.lit(1)), F.try_element_at(ys, F.lit(-1))
    held = F.when(at <= F.try_element_at(xs, F.lit(1)), first).when(at >= F.try_element_at(xs, F.lit(-1)), last).otherwise(inner)
    return F.when((n == F.size(ys)) & (n > 0) & at.isNotNull(), held)


def safe_ratio(top: Column, bottom: Column) -> Column:
    """Null over nothing."""
    return top / F.nullif(bottom, F.lit(0))


def logit(p: Column, clip: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def piecewise(x: Column, anchors: tuple[tuple[float, float], ...] = ANCHORS) -> Column:
    """Linear between anchors, held at the ends."""
    out = F.lit(anchors[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(anchors, anchors[1:]))):
        out = F.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return F.when(x.isNotNull(), F.when(x <= anchors[0][0], F.lit(anchors[0][1])).otherwise(out))


def level_index(mid: Column, high: Column, top: Column) -> Column:
    """Weighted index of three levels to one decimal; null if they are not in order."""
    total = sum((w * piecewise(c) for w, c in zip(LEVEL_WEIGHTS, (mid, high, top))), F.lit(0.0))
    return F.when((mid <= high) & (high <= top), half_up(total, 1))


def half_up(x: Column, digits: int = 0) -> Column:
    """Half up, towards plus infinity."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def half_even(x: Column, digits: int = 0) -> Column:
    """Halves to the even neighbour."""
    return F.bround(x, digits)


def gap(percentile: Column, other: Column) -> Column:
    return percentile - other


def board_signal(ours: Column, theirs: Column, apart: float = 10.0, top: float = 90.0) -> Column:
    """``bothTop10``, ``oracleAhead``, ``crowdAhead`` or none."""
    d = gap(ours, theirs)
    return F.when((ours >= top) & (theirs >= top), "bothTop10").when(d >= apart, "oracleAhead").when(d <= -apart, "crowdAhead").otherwise("none")


def two_way(batting: Column, pitching: Column, full_batting: float = 600.0, full_pitching: float = 540.0, least: float = 60.0, ratio: float = 0.25) -> Column:
    """Whether both workloads are there and the smaller is ``ratio`` of the larger."""
    a, b = batting / full_batting, pitching / full_pitching
    return (batting >= least) & (pitching >= least) & (F.least(a, b) >= ratio * F.greatest(a, b))


def innings_to_outs(text: Column) -> Column:
    """``12.1`` is 37 outs; a third digit other than 0, 1, 2 is null."""
    part = F.split(text, r"\.")
    whole, rest = F.get(part, F.lit(0)).try_cast("int"), F.coalesce(F.get(part, F.lit(1)), F.lit("0")).try_cast("int")
    return F.when(rest.between(0, 2), whole * 3 + rest)


def outs_to_innings(outs: Column) -> Column:
    return F.concat_ws(".", F.floor(outs / 3).cast("string"), F.pmod(outs, F.lit(3)).cast("string"))


def band(x: Column, edges: tuple[float, ...], labels: tuple[str, ...], missing: str = "missing") -> Column:
    """Right-closed bands: ``labels`` has one more than ``edges``."""
    out = F.lit(labels[-1])
    for e, label in reversed(list(zip(edges, labels))):
        out = F.when(x <= e, F.lit(label)).otherwise(out)
    return F.when(x.isNull(), F.lit(missing)).otherwise(out)


def bucket_of(x: Column, edges: list[float]) -> Column:
    """Number of edges below ``x``: 0 up to the first edge, right-closed."""
    return sum(((x > F.lit(e)).cast("int") for e in edges), F.lit(0))


def age_years(born: Column, on: Column) -> Column:
    return F.round(F.datediff(on, born) / DAYS_IN_YEAR, 4)


def season_of(day: Column, first_month: int = 4) -> Column:
    """The year a day belongs to when seasons begin in ``first_month``."""
    return F.year(day) - (F.month(day) < first_month).cast("int")


def rank_percentile(rank: Column, universe: Column, alone: float | None = 100.0) -> Column:
    """100 for the first, 0 for the last; ``alone`` for a universe of one."""
    return F.when(universe > 1, 100.0 * (universe - rank) / (universe - 1)).otherwise(F.lit(alone).cast("double"))


def momentum(previous: Column, now: Column, universe: Column) -> Column:
    """Places gained as per cent of the universe."""
    return 100.0 * (previous - now) / F.nullif(universe, F.lit(0))
