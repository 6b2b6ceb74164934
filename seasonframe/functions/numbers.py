"""Rounding that does not depend on how rows were partitioned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def steady_round(value: Column | str, digits: int) -> Column:
    """Half-even rounding of an aggregate, insensitive to summation order.

    Partial sums arrive in any order, so the last bits of a mean vary between runs and a plain
    half-even rounding could flip at a tie. Snapping to 9 decimals first removes that noise.
    """
    return F.bround(F.round(value, 9), digits)


def steady_sql(aggregate: str, digits: int) -> str:
    """The same rounding as SQL text."""
    return f"bround(round({aggregate}, 9), {digits})"
