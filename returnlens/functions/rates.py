"""Rates of counts and the choice between levels of a forecast.

Rounded rates divide decimals, so that a tie such as 57/200 rounds up as it does on
paper; the result becomes a double only after rounding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COUNT = "decimal(20,0)"
MONEY = "decimal(24,2)"


def quotient(numerator: Column, denominator: Column, digits: int, kind: str = COUNT) -> Column:
    """``numerator / denominator`` half-up rounded; NULL when the denominator is 0."""
    exact = F.try_divide(numerator.cast(kind), denominator.cast(kind))
    return F.round(exact, digits).cast("double")


def difference_rate(before: Column, after: Column) -> Column:
    """Unrounded share of ``before`` that is missing in ``after``; 0 when nothing came before."""
    share = F.try_divide((before - after).cast("double"), before.cast("double"))
    return F.when(before == 0, F.lit(0.0)).otherwise(share)


def rounded_difference_rate(before: Column, after: Column, digits: int, kind: str = COUNT) -> Column:
    return F.when(before == 0, F.lit(0.0)).otherwise(quotient(before - after, before, digits, kind))


def count_rate(part: Column, whole: Column, digits: int = 2) -> Column:
    """Rounded ``part / whole``; 0 when ``whole`` is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(quotient(part, whole, digits))


def fallback_rate(
    count: Column, rate: Column, parent_count: Column, parent_rate: Column, top_rate: Column, minimum: int
) -> Column:
    """Own rate with enough sales, else the parent's with enough sales, else the top rate.

    A NULL count at any level is not enough.
    """
    return (
        F.when(count >= minimum, rate)
        .when((count < minimum) & (parent_count >= minimum), parent_rate)
        .otherwise(top_rate)
    )
