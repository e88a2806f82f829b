"""Broadcasts of tables whose size has been looked at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More rows than this are joined by shuffles.
BROADCAST_ROWS = 100_000


def broadcast_if_small(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``table``, to be broadcast if it has ``most`` rows or fewer; else Spark chooses."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table
