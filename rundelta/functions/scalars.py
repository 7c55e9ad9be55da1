"""Scalar functions that SQL lacks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softplus(x: Column) -> Column:
    """ln(1 + exp(x)) without overflow at either end."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def month_end(day: Column, months: Column) -> Column:
    """The last day of the month that lies ``months`` months after a date's, its own counted as the first."""
    return F.last_day(F.add_months(day, (months - 1).cast("int")))


def growth_share(age: Column, omega: float, theta: float, curve: str) -> Column:
    """Share developed at an age by a loglogistic or a weibull curve; nothing before age 0."""
    x = F.greatest(age.cast("double"), F.lit(0.0))
    if curve == "loglogistic":
        return F.pow(x, F.lit(omega)) / (F.pow(x, F.lit(omega)) + float(theta) ** omega)
    return 1 - F.exp(-F.pow(x / theta, F.lit(omega)))
