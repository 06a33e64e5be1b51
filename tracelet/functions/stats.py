"""Statistics as aggregate expressions; empty input gives zero, non-numbers are left out."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def number(value: Column) -> Column:
    return value.try_cast("double")


def total(value: Column) -> Column:
    return F.coalesce(F.sum(number(value)), F.lit(0.0))


def mean(value: Column) -> Column:
    return F.coalesce(F.avg(number(value)), F.lit(0.0))


def variance(value: Column) -> Column:
    """Of the population; zero for one value."""
    return F.coalesce(F.var_pop(number(value)), F.lit(0.0))


def deviation(value: Column) -> Column:
    return F.coalesce(F.stddev_pop(number(value)), F.lit(0.0))


def percentile(value: Column, p: float) -> Column:
    """Linear interpolation between the closest ranks; ``p`` in 0..100, values beyond count as the ends."""
    return F.coalesce(F.percentile(number(value), min(100.0, max(0.0, p)) / 100.0), F.lit(0.0))


def median(value: Column) -> Column:
    return percentile(value, 50)


def normalized(value: Column, *by: str) -> Column:
    """Share of the sum within ``by``; zeros where the sum is not positive."""
    whole = F.sum(value).over(Window.partitionBy(*by))
    return F.when(whole > 0, value / whole).otherwise(F.lit(0.0))


def ladder(value: Column, rungs: list[tuple[float, str]], last: str, least: bool = True) -> Column:
    """Name of the first rung that the value reaches (``least``) or stays under."""
    made = F.lit(last)
    for bound, name in reversed(rungs):
        made = F.when(value >= bound if least else value < bound, name).otherwise(made)
    return made
