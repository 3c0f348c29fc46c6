"""Sums and quotients that do not depend on task order and that no single value can stop.

A value enters as decimal(38,6). Sums of values up to HELD_BELOW stay exact in any order for a million rows
of that size, and for correspondingly more smaller ones; larger values are not held but counted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE, NARROW = "decimal(38,6)", "decimal(20,6)"
HELD_BELOW, NARROW_BELOW = 1e26, 1e13


def held(value: Column) -> Column:
    """The value with six decimals; NULL where it is too large, or no number."""
    return F.when(F.abs(value) < HELD_BELOW, value.cast(WIDE))


def exact_sum(value: Column) -> Column:
    """Sum of what can be held."""
    return F.try_sum(held(value))


def not_held(value: Column) -> Column:
    """How many values `exact_sum` leaves out."""
    return F.count_if(value.isNotNull() & ~F.coalesce(F.abs(value) < HELD_BELOW, F.lit(False)))


def quotient(num: Column, den: Column, digits: int, factor: int = 1) -> Column:
    """num * factor / den, rounded half up: in decimals as long as both are below NARROW_BELOW, else in doubles."""
    small = (F.abs(num) < NARROW_BELOW) & (F.abs(den) < NARROW_BELOW)
    n, d = (F.when(small, x.cast(NARROW)) for x in (num, den))
    return F.when(small, F.round(F.try_divide(n * factor, d), digits).cast("double")).otherwise(
        F.round(num.cast("double") * factor / F.nullif(den.cast("double"), F.lit(0.0)), digits))
