"""Small integer-arithmetic expressions that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(value: Column, divisor: int) -> Column:
    """Floor division of an integer column, exact for negative values too."""
    d = F.lit(divisor).cast("bigint")
    return ((value - F.pmod(value, d)) / d).cast("bigint")


def two_digits(value: Column) -> Column:
    return F.lpad(value.cast("string"), 2, "0")


def epoch_date(days: Column) -> Column:
    return F.date_from_unix_date(days.cast("int"))
