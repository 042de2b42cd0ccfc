"""Training periods and ages, written as plain ranges on the raw column.

Every condition compares the stored column itself with a constant or with a scalar
subquery, never with a function of the column, so the scan can use it.

Spark's Parquet reader skips nothing by zone-free timestamps. A table may therefore hold, usually
as its partition column, the day of such a column under ``day_column``; every condition then also
limits the days.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_SECONDS = 86400


@dataclass(frozen=True)
class Lookback:
    """Days counted back from the newest row.

    ``latest`` is the newest row's time (or date id) if the caller knows it, for example
    from the load job. Without it the table is scanned once for the maximum.
    """

    start: int
    end: int
    latest: datetime | int | None = None


def day_column(column: str) -> str:
    return f"{column}_day"


def timestamp(value: datetime) -> Column:
    """A zone-free timestamp constant."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def days(count: int) -> Column:
    return F.make_dt_interval(F.lit(count))


def midnight(moment: Column) -> Column:
    return moment.cast("date").cast("timestamp_ntz")


def next_midnight(moment: Column) -> Column:
    """The moment itself at midnight, else the start of the following day."""
    start = midnight(moment)
    return F.when(moment == start, start).otherwise(start + days(1))


def open_period(table: DataFrame, column: str, lookback: Lookback) -> Column:
    """Strictly between newest − start and newest − end days, time of day included."""
    newest = _newest(table, column, lookback)
    lower = newest(lambda m: m - days(lookback.start))
    upper = newest(lambda m: m - days(lookback.end))
    return (F.col(column) > lower) & (F.col(column) < upper) & _days_between(table, column, lower, upper)


def whole_days_after(table: DataFrame, column: str, lookback: Lookback) -> Column:
    """The row's calendar day is after newest − start and before newest − end.

    The bounds keep their time of day, hence the day on which the upper bound falls counts
    unless that bound is midnight.
    """
    newest = _newest(table, column, lookback)
    lower = newest(lambda m: midnight(m - days(lookback.start)) + days(1))
    upper = newest(lambda m: next_midnight(m - days(lookback.end)))
    return (F.col(column) >= lower) & (F.col(column) < upper) & _days_between(table, column, lower, upper)


def whole_days_from(table: DataFrame, column: str, lookback: Lookback) -> Column:
    """As ``whole_days_after``, but a day starting exactly on the lower bound counts too."""
    newest = _newest(table, column, lookback)
    lower = newest(lambda m: next_midnight(m - days(lookback.start)))
    upper = newest(lambda m: next_midnight(m - days(lookback.end)))
    return (F.col(column) >= lower) & (F.col(column) < upper) & _days_between(table, column, lower, upper)


def date_id_bounds(fact: DataFrame, lookback: Lookback) -> tuple[Column, Column]:
    """First date id of the period and the first one after it."""
    newest = _newest(fact, "date_id", lookback)
    return newest(lambda m: m - lookback.start), newest(lambda m: m - lookback.end)


def between(table: DataFrame, column: str, start: datetime, end: datetime) -> Column:
    """From one instant to another, both included."""
    lower, upper = timestamp(start), timestamp(end)
    return F.col(column).between(lower, upper) & _days_between(table, column, lower, upper)


def aged_at_most(table: DataFrame, column: str, as_of: Column, limit: int) -> Column:
    """Age in days, rounded to a whole number, is at most ``limit``."""
    oldest = as_of - _half_day_after(limit)
    return (F.col(column) > oldest) & _days_between(table, column, oldest)


def aged_exactly(table: DataFrame, column: str, as_of: Column, point: int) -> Column:
    """Age in days, rounded half away from zero, equals ``point``."""
    oldest = as_of - _half_day_after(point)
    newest = as_of - _half_day_after(point - 1)
    after = F.col(column) > oldest if point >= 0 else F.col(column) >= oldest
    until = F.col(column) <= newest if point > 0 else F.col(column) < newest
    return after & until & _days_between(table, column, oldest, newest)


def rounded_age(column: Column, as_of: Column, extra_days: int = 0) -> Column:
    """Whole days from ``column`` to ``as_of``, halves rounded away from zero."""
    gap = as_of - column
    seconds = (
        F.date_part(F.lit("DAY"), gap) * DAY_SECONDS
        + F.date_part(F.lit("HOUR"), gap) * 3600
        + F.date_part(F.lit("MINUTE"), gap) * 60
        + F.date_part(F.lit("SECOND"), gap)
    ).cast("decimal(20,6)")
    return F.round(seconds / F.lit(DAY_SECONDS).cast("decimal(5,0)") + extra_days, 0).cast("long")


def now() -> Column:
    return F.localtimestamp()


def _days_between(table: DataFrame, column: str, lower: Column, upper: Column | None = None) -> Column:
    day = day_column(column)
    if day not in table.columns:
        return F.lit(True)
    after = F.col(day) >= lower.cast("date")
    return after if upper is None else after & (F.col(day) <= upper.cast("date"))


def _half_day_after(whole_days: int) -> Column:
    return F.make_dt_interval(F.lit(whole_days), F.lit(12))


def _newest_day(table: DataFrame, column: str) -> DataFrame:
    """The rows of the newest day where the table has the days of the column, else all rows.

    The days of a table stored by day are known without reading a column, and one folder holds the newest row.
    """
    day = day_column(column)
    if day not in table.columns:
        return table
    return table.filter(F.col(day) == table.agg(F.max(day)).scalar())


def _newest(table: DataFrame, column: str, lookback: Lookback):
    if lookback.latest is None:
        newest = _newest_day(table, column).agg(F.max(column).alias("newest"))
        # Spark would merge the bounds into fields of one struct, which no scan takes as a filter. It leaves
        # subqueries alone that end in a coalesce; their common aggregation still runs once.
        return lambda shift: newest.select(shift(F.col("newest"))).coalesce(1).scalar()
    if isinstance(lookback.latest, datetime):
        return lambda shift: shift(timestamp(lookback.latest))
    return lambda shift: shift(F.lit(lookback.latest))
