"""Rounding of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """x to so many decimals by its binary value, halves away from zero: 0.60325, a little less in binary, is 0.6032.

    F.round would go by the shortest decimal text and give 0.6033.
    """
    return F.round(x * float(10**digits)) / float(10**digits)
