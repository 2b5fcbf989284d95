"""Sums that do not depend on the order of addition.

A double is split into its whole part and a count of fixed-size ticks. Both are
summed as 64-bit integers, which hash aggregation keeps in place, and are put
together again after the aggregation. Partial results therefore merge to the
same digits whatever the number of tasks, retries or partitions. With ANSI mode
on, an overflow fails the query; it never wraps.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MICRO = 6     # minutes, money
FINE = 7      # coordinates


def whole_part(value: Column) -> Column:
    return F.floor(value)


def tick_part(value: Column, digits: int = MICRO) -> Column:
    return F.floor((value - F.floor(value)) * F.lit(float(10 ** digits)) + 0.5)


def join_parts(whole_sum: Column, tick_sum: Column, digits: int = MICRO) -> Column:
    """Decimal total of two summed parts."""
    unit = F.lit(Decimal(1).scaleb(-digits))
    return whole_sum.cast(f"decimal(38,{digits})") + tick_sum.cast("decimal(38,0)") * unit


def exact_sum(value: Column, digits: int = MICRO) -> Column:
    """Aggregate: decimal sum of a double column."""
    return join_parts(F.sum(whole_part(value)), F.sum(tick_part(value, digits)), digits)


def exact_mean(value: Column, digits: int = MICRO) -> Column:
    """Aggregate: mean of a double column, null for an empty group."""
    return F.try_divide(exact_sum(value, digits).cast("double"), F.count(value).cast("double"))
