"""Rounding as databases do it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int) -> Column:
    """A double to so many places, by the double that ``x`` times a power of ten is, as C's round has it.

    Spark's round takes the shortest decimal instead: 0.64565, whose ten-thousandfold is 6456.499999999999, would be 0.6457.
    """
    return F.round(x * 10.0**places) / 10.0**places
