"""Small numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slot(value: Column, width: int) -> Column:
    """Number of the ``width``-wide slot a whole number falls into (floor, exact)."""
    return ((value - F.pmod(value, F.lit(width))) / F.lit(width)).cast("long")

