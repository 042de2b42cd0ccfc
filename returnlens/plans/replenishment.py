"""The replenishment report."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnlens.functions.rates import quotient
from returnlens.operators.replenishment import (
    Observation,
    days_active,
    days_without_stock,
    sales_in_observation,
    stock_on_hand,
    visible_days,
)

# Fixed value: days of stock reported for a sku that does not sell.
NEVER_SOLD_OUT = 999.0


def replenishment_report(
    product: DataFrame, stock: DataFrame, items: DataFrame, seen: Observation = Observation()
) -> DataFrame:
    """Sales rate, days of stock and sell-through per visible simple sku.

    A figure whose divisor is 0 is NULL. Sales and stock are one row per sku (stock on hand: per
    sku and stock time) before they meet; the catalogue rows are then joined once. ``distinct``
    drops no row: as in ``once_per_key`` it keeps a sku with many catalogue rows divisible.
    """
    activity = (
        days_without_stock(stock, seen)
        .join(sales_in_observation(items, seen), "sku", "full")
        .join(stock_on_hand(stock, seen), "sku", "full")
        .distinct()
    )
    sold, visible, amount = (
        F.col("sold_items_before_return"),
        F.col("visibility_period"),
        F.col("amount_on_stock"),
    )
    return (
        days_active(product, seen)
        .join(activity, "sku", "left")
        .withColumn("sold_items_before_return", F.coalesce(sold, F.lit(0)))
        .withColumn("visibility_period", visible_days(seen))
        .select(
            "sku",
            quotient(sold, visible, 2).alias("sales_rate"),
            amount,
            sold,
            visible,
            _inventory_days(sold, visible, amount).alias("inventory_days"),
            quotient(sold, amount, 3).alias("sell_through_rate_item_based"),
        )
    )


def replenishment_report_v2(
    product: DataFrame, stock: DataFrame, items: DataFrame, seen: Observation = Observation()
) -> DataFrame:
    """The report on venture tables: no history rows to drop, unknown inventory types accepted."""
    return replenishment_report(product, stock, items, replace(seen, current_only=False, unknown_inventory=True))


def _inventory_days(sold: Column, visible: Column, amount: Column) -> Column:
    # amount / (sold / visible) as one exact division.
    return F.when((sold == 0) & (visible != 0), F.lit(NEVER_SOLD_OUT)).otherwise(
        F.when(visible != 0, quotient(amount * visible, sold, 1))
    )
