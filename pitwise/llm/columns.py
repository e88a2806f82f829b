"""Helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is worked out once, however often it is used: inside a
    lambda a column expression would be worked out anew for each element."""
    return F.get(F.transform(F.array(value), make), F.lit(0))
