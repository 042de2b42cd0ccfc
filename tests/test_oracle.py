"""Every registered query against DuckDB, on the test data and on small hostile tables."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta
from decimal import Decimal
from functools import reduce

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import oracle_queries
from returnlens.functions.periods import open_period
from returnlens.functions.skus import config_prefix
from returnlens.functions.states import outside
from returnlens.operators import returns
from returnlens.operators.units import UNIT_KEY
from returnlens.sources.schemas import SCHEMAS
from returnlens.sources.ventures import declared

FOLDER = "/root/testdata/sf0.001"
RAW = ("orders", "lineitem", "part", "events")
DAYS_BACK = (0, 1, 2, 9, 10, 11, 30, 31, 50, 78, 100, 149, 150, 151)
FACT_DAYS = (0, 1, 21, 22, 48, 49, 60, 68, 69, 70, 98, 99)


def without_blanks(table: str) -> str:
    """The columns of a table, blank texts as NULL."""
    columns = (part.split(" ") for part in SCHEMAS[table].split(", "))
    return ", ".join(f"nullif({n}, '') as {n}" if kind == "string" else n for n, kind in columns)


def ordered(found):
    return sorted(found, key=lambda r: tuple((v is not None, str(v)) for v in r))


def compare(frame, connection, sql):
    relation = connection.sql(sql)
    assert sorted(relation.columns) == sorted(frame.columns)
    columns = sorted(frame.columns)
    expected = connection.sql(f"select {', '.join(columns)} from ({sql})").fetchall()
    actual = [tuple(r) for r in frame.select(*columns).collect()]
    assert ordered(actual) == ordered(expected)
    return actual


@pytest.fixture(scope="module")
def testdata():
    connection = duckdb.connect()
    for name in RAW:
        connection.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return connection


def test_every_query_has_an_oracle():
    assert {*entry.REGISTRY, "write_forecast_table"} == set(oracle_queries.all_queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", oracle_queries.all_queries())
def test_on_test_data(spark, testdata, name):
    compare(entry.queries()[name](spark, FOLDER), testdata, entry.oracle_sql()[name])


def hostile_tables(seed: int) -> dict[str, list[tuple]]:
    """Few keys, many copies, missing values, hot keys, boundary instants."""
    pick = random.Random(seed)
    newest = datetime(2001, 8, 1, pick.choice([0, 7]))

    def maybe(value, chance=0.1):
        return None if pick.random() < chance else value

    def hot(values):
        return values[0] if pick.random() < 1 / 3 else pick.choice(values)

    skus = ["A-0", "A-1", "B-0", "C-9-x", "nodash", "-lead", "A", "B"]
    states = [
        "item_invalid",
        "item_canceled",
        "item_returned",
        "item_exchanged",
        "item_rejected",
        "item_delivered",
        "item_shipped",
    ]
    ends = [datetime(9999, 12, 31), datetime(9999, 12, 31), datetime(1999, 1, 1)]
    moments = (
        [newest - timedelta(days=d, hours=h) for d in DAYS_BACK for h in (0, 7, 12)]
        + [datetime(2000, 8, d, h) for d in (1, 15, 30, 31) for h in (0, 1)]
        + [newest]
    )

    def item():
        number = pick.randrange(60)
        return (
            maybe(number, 0.03),
            maybe(hot([number % 12, 1, 2]), 0.05),
            maybe(hot(skus)),
            maybe(pick.choice(["n1", "n2"])),
            Decimal(pick.randrange(100, 900)) / 100,
            maybe(pick.choice(states), 0.05),
            maybe(pick.choice(moments), 0.03),
            pick.choice(ends),
        )

    def order():
        number = pick.randrange(14)
        return (
            number,
            maybe(f"N{hot([number, 3])}"),
            maybe(hot([7, 8, 9])),
            maybe(pick.choice(moments), 0.05),
            pick.choice(ends),
        )

    def product():
        kind = pick.choice(["simple", "simple", "configurable"])
        return (
            maybe(hot(skus)),
            kind,
            pick.randrange(6) + (100 if kind == "configurable" else 0),
            maybe(100 + pick.randrange(6)) if kind == "simple" else None,
            maybe(pick.choice(["X", "Y", "unspecified"]), 0.2),
            pick.choice([1, 1, 0]),
            maybe(pick.choice(["Own Warehouse", "Own Warehouse", "Marketplace"]), 0.2),
            maybe(pick.choice(moments), 0.3),
            pick.choice(moments),
            pick.choice(ends),
        )

    def fact():
        before = pick.randrange(3)
        return (4000 + pick.choice(FACT_DAYS), hot([1, 2, 3, 4]), before, pick.randrange(before + 1))

    def dim_product():
        start = pick.choice([date(1990, 1, 1), date(2000, 12, 1), date(2000, 12, 20)])
        return (
            pick.randrange(5),
            maybe(hot(skus)),
            maybe(pick.choice(["t1", "t2"])),
            maybe(pick.choice(["d1", "d2"])),
            start,
            pick.choice([date(2000, 12, 10), date(9999, 12, 31)]),
        )

    def conf():
        code = pick.choice(list(kinds))
        return (maybe(code), kinds[code], pick.choice(["abandoned", "other", None]))

    def blanked(row):
        """Now and then '' for a text, which means it is missing."""
        return tuple("" if isinstance(v, str) and pick.random() < 0.04 else v for v in row)

    def many(make, count):
        return [blanked(make()) for _ in range(count)]

    kinds = {"c1": "x Abandoned y", "c2": "none", "c3": None}
    return {
        "sales_order_item": many(item, 500),
        "sales_order": many(order, 40),
        "order_list": [("N1",), ("N1",), ("N3",), ("unknown",), (None,), ("",)],
        "product": many(product, 40),
        "stock": many(
            lambda: (maybe(hot(skus)), pick.choice(moments), maybe(pick.randrange(3)), pick.choice(ends)), 120
        ),
        "web_orders": many(lambda: (maybe(f"N{pick.randrange(14)}"), maybe(hot([1, 2, 3, 4]))), 30),
        "web_visitors": many(lambda: (maybe(pick.randrange(4)),), 6),
        "web_campaigns": many(lambda: (maybe(hot([1, 2, 3])), maybe(pick.choice(["c1", "c2", "c3", "c4"]))), 12),
        "web_confdata": many(conf, 6),
        "dim_dates": [
            (4000 + d, (date(2000, 10, 4) + timedelta(days=d)).strftime("%Y.%m.%d")) for d in range(100) if d != 22
        ],
        "dim_articles": many(lambda: (hot([1, 2, 3, 5]), pick.randrange(5)), 8),
        "dim_products": many(dim_product, 20),
        "fct_sales": many(fact, 200),
    }


@pytest.fixture(scope="module", params=[1, 2])
def hostile(request, spark):
    data = hostile_tables(request.param)
    connection = duckdb.connect()
    frames = {}
    for name, found in data.items():
        frames[name] = declared(spark.createDataFrame(found, SCHEMAS[name]).repartition(3), name)
        columns = SCHEMAS[name].replace("timestamp_ntz", "timestamp").replace("string", "varchar")
        connection.execute(f"create table fixture_{name} ({columns})")
        connection.executemany(f"insert into fixture_{name} values ({', '.join('?' * len(found[0]))})", found)
    return frames, connection


@pytest.mark.parametrize("name", entry.REGISTRY)
def test_on_hostile_tables(hostile, monkeypatch, name):
    frames, connection = hostile
    monkeypatch.setattr(oracle_queries, "TABLES", {n: f"select {without_blanks(n)} from fixture_{n}" for n in frames})
    monkeypatch.setattr(oracle_queries, "NEEDS", {})
    compare(entry.REGISTRY[name].run(frames.__getitem__), connection, oracle_queries.all_queries()[name])


def test_one_scan_equals_stacking_one_distinct_branch_per_count(hostile):
    """The flags of a single scan give what a set union of separately tagged scans gives."""
    items, orders, product = (hostile[0][n] for n in (entry.ITEMS, entry.ORDERS, "product"))
    counts = returns.RETURN_CANCEL_COUNTS
    branches = [
        items.filter(outside(states)).select(
            *UNIT_KEY, *(F.lit(int(name == other)).alias(other) for other in counts)
        )
        for name, states in counts.items()
    ]
    stacked = reduce(lambda left, right: left.unionByName(right), branches).distinct()
    placed = orders.filter(open_period(orders, "created_at", returns.PERIOD)).select("id_sales_order")
    brands = product.select(F.col("sku").alias("productsku"), "brand")
    expected = (
        stacked.withColumn("productsku", config_prefix("sku"))
        .join(placed, F.col("fk_sales_order") == F.col("id_sales_order"))
        .join(brands, "productsku", "left")
        .groupBy("productsku", "brand")
        .agg(*(F.sum(n).alias(n) for n in counts))
    )
    actual = returns.config_brand_counts(items, orders, product)
    assert ordered(map(tuple, actual.collect())) == ordered(map(tuple, expected.collect()))


def test_counts_shrink_with_every_excluded_state(spark):
    found = entry.queries()["abandoned_totals_by_config"](spark, "/root/testdata/sf0.01")
    for kind in ("orders", "sold_items", "customers", "rev"):
        wrong = (F.col(f"{kind}_bef_cancel") < F.col(f"{kind}_bef_return")) | (F.col(f"{kind}_bef_return") < F.col(kind))
        assert found.filter(wrong).count() == 0
    rates = entry.queries()["brand_rates_unfiltered"](spark, "/root/testdata/sf0.01")
    assert rates.filter(~F.col("return_rate_brand").between(0, 1)).count() == 0
    assert rates.filter(~F.col("cancellation_rate_brand").between(0, 1)).count() == 0
