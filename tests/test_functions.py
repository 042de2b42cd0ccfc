from __future__ import annotations

from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

import pytest
from collected import rows
from pyspark.sql import functions as F

from returnlens.functions import periods, rates, states
from returnlens.functions.periods import Lookback
from returnlens.functions.skew import known, once_per_key
from returnlens.functions.skus import config_prefix


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "sku, expected",
    [("C12-3", "C12"), ("A-b-c", "A"), ("nodash", None), ("-lead", None), ("", None), (None, None), ("x-", "x")],
)
def test_config_prefix(spark, sku, expected):
    assert one(spark, config_prefix(F.lit(sku).cast("string"))) == expected


@pytest.mark.parametrize("state, expected", [(None, 0), ("item_invalid", 0), ("item_canceled", 0), ("item_new", 1)])
def test_a_null_state_counts_nowhere(spark, state, expected):
    column = F.lit(state).cast("string")
    assert one(spark, states.flag(states.outside(states.NET_OF_CANCEL, column))) == expected
    assert one(spark, states.flag(states.inside(["item_new"], column))) == expected


@pytest.mark.parametrize(
    "part, whole, digits, expected",
    [
        (57, 200, 2, 0.29),
        (-57, 200, 2, -0.29),
        (57, -200, 2, -0.29),
        (1, 8, 2, 0.13),
        (1, 3, 3, 0.333),
        (0, 7, 2, 0.0),
        (5, 0, 2, None),
        (None, 3, 2, None),
    ],
)
def test_quotient_rounds_halves_away_from_zero(spark, part, whole, digits, expected):
    assert one(spark, rates.quotient(F.lit(part).cast("long"), F.lit(whole).cast("long"), digits)) == expected


def test_quotient_equals_decimal_arithmetic(spark):
    found = (
        spark.range(0, 400)
        .crossJoin(spark.range(1, 60).withColumnRenamed("id", "whole"))
        .select("id", "whole", rates.quotient(F.col("id"), F.col("whole"), 2))
    )
    for part, whole, rate in found.collect():
        exact = (Decimal(part) / Decimal(whole)).quantize(Decimal("0.01"), ROUND_HALF_UP)
        assert rate == float(exact)


def test_difference_rate_guards(spark):
    def rate(before, after):
        return one(spark, rates.difference_rate(F.lit(before).cast("long"), F.lit(after).cast("long")))

    assert rate(0, 0) == 0.0
    assert rate(8, 6) == 0.25
    assert rate(2, 3) == -0.5
    assert rate(None, None) is None
    assert one(spark, rates.count_rate(F.lit(4), F.lit(0))) == 0.0


@pytest.mark.parametrize(
    "count, parent, expected", [(8, 0, "own"), (7, 8, "parent"), (7, 7, "top"), (7, None, "top"), (None, 9, "top")]
)
def test_fallback(spark, count, parent, expected):
    chosen = rates.fallback_rate(
        F.lit(count).cast("long"), F.lit("own"), F.lit(parent).cast("long"), F.lit("parent"), F.lit("top"), 8
    )
    assert one(spark, chosen) == expected


NEWEST = [datetime(2001, 8, 1), datetime(2001, 8, 1, 7, 30)]


def moments(newest):
    steps = [
        timedelta(days=-d, hours=h, seconds=s)
        for d in (29, 30, 31, 77, 78, 79)
        for h in range(0, 24, 3)
        for s in (-1, 0, 1)
    ]
    return sorted({newest, datetime(2001, 5, 15), datetime(2001, 7, 2)} | {newest + s for s in steps})


def kept_by(spark, condition, newest):
    table = spark.createDataFrame([(m,) for m in moments(newest)], "created_at timestamp_ntz")
    found = {}
    for label, latest in (("scanned", None), ("given", newest)):
        lookback = Lookback(78, 30, latest)
        found[label] = {r[0] for r in table.filter(condition(table, "created_at", lookback)).collect()}
    assert found["scanned"] == found["given"]
    return found["scanned"]


def day(moment):
    return datetime(moment.year, moment.month, moment.day)


@pytest.mark.parametrize("newest", NEWEST)
def test_period_boundaries(spark, newest):
    low, high = newest - timedelta(days=78), newest - timedelta(days=30)
    every = moments(newest)
    assert kept_by(spark, periods.open_period, newest) == {m for m in every if low < m < high}
    assert kept_by(spark, periods.whole_days_after, newest) == {m for m in every if low < day(m) < high}
    assert kept_by(spark, periods.whole_days_from, newest) == {m for m in every if low <= day(m) < high}


def test_date_id_bounds(spark):
    fact = spark.createDataFrame([(d,) for d in range(100)], "date_id int")
    first, after = periods.date_id_bounds(fact, Lookback(78, 30))
    kept = fact.filter((F.col("date_id") >= first) & (F.col("date_id") < after))
    assert [r[0] for r in kept.collect()] == list(range(21, 69))


def test_an_empty_table_has_an_empty_period(spark):
    table = spark.createDataFrame([], "created_at timestamp_ntz")
    assert table.filter(periods.open_period(table, "created_at", Lookback(78, 30))).count() == 0


def half_away(value: Decimal) -> int:
    return int(value.quantize(Decimal(1), ROUND_HALF_UP))


def test_ages(spark):
    as_of = datetime(2001, 8, 2, 9)
    now = periods.timestamp(as_of)
    times = [as_of - timedelta(hours=h, seconds=s) for h in range(-60, 300, 6) for s in (-1, 0, 1)]
    table = spark.createDataFrame([(t,) for t in times], "at timestamp_ntz")
    age = {t: half_away(Decimal((as_of - t).total_seconds()) / 86400) for t in times}
    assert {r[0]: r[1] for r in table.select("at", periods.rounded_age(F.col("at"), now)).collect()} == age
    for point in (-1, 0, 1, 2, 10):
        kept = {r[0] for r in table.filter(periods.aged_exactly(table, "at", now, point)).collect()}
        assert kept == {t for t in times if age[t] == point}
    for limit in (0, 1, 10):
        kept = {r[0] for r in table.filter(periods.aged_at_most(table, "at", now, limit)).collect()}
        assert kept == {t for t in times if age[t] <= limit}


def test_extra_days_are_added_before_rounding(spark):
    as_of = datetime(2001, 8, 2, 9)
    age = periods.rounded_age(periods.timestamp(as_of - timedelta(hours=12)), periods.timestamp(as_of), 14)
    assert one(spark, age) == 15


def test_once_per_key(spark):
    table = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", 4)], "k string, v int")
    assert rows(once_per_key(table, "k")) == [(None,), ("a",), ("b",)]
    assert rows(once_per_key(table, "k", F.sum("v").alias("v"))) == [(None, 3), ("a", 3), ("b", 4)]
    assert one(spark, known(F.lit(None).cast("string"))) == ""
