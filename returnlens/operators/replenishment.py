"""Visibility, sales and stock of simple skus within an observation period."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnlens.functions.periods import aged_at_most, aged_exactly, now, rounded_age, timestamp
from returnlens.functions.skew import once_per_key
from returnlens.functions.states import NET_OF_CANCEL, outside


@dataclass(frozen=True)
class Observation:
    """What is observed, and when.

    ``as_of`` stands for the current time. ``current_only`` drops closed history rows and
    ``unknown_inventory`` also takes products without an inventory type; the venture tables are
    read without the first and with the second.
    """

    as_of: datetime | None = None
    days: int = 10
    missing_activation_days: int = 14
    activation_cutoff: int = 21
    stock_point: int = 1
    inventory_type: str = "Own Warehouse"
    current_only: bool = True
    unknown_inventory: bool = False

    @property
    def moment(self) -> Column:
        return now() if self.as_of is None else timestamp(self.as_of)

    def current(self, table: DataFrame) -> DataFrame:
        return table.filter(F.col("dg_end_date") > self.moment) if self.current_only else table


def days_active(product: DataFrame, seen: Observation = Observation()) -> DataFrame:
    """Days each visible simple sku was active, at most the period.

    A sku without an activation time is judged by its creation time plus a fixed number of
    days; the result may then exceed the period up to the cutoff.
    """
    own = F.col("inventory_type") == seen.inventory_type
    if seen.unknown_inventory:
        own = own | F.col("inventory_type").isNull() | (F.col("inventory_type") == "")
    visible = seen.current(product).filter((F.col("status") == 1) & own & (F.col("type_id") == "simple"))
    active = rounded_age(F.col("activated_at"), seen.moment)
    estimated = rounded_age(F.col("created_at"), seen.moment, seen.missing_activation_days)
    unknown = F.col("activated_at").isNull()
    period = F.lit(seen.days).cast("long")
    return visible.select(
        "sku",
        F.when(active > seen.days, period)
        .when(unknown & (estimated <= seen.activation_cutoff), estimated)
        .when(unknown & (estimated > seen.activation_cutoff), period)
        .otherwise(active)
        .alias("days_active_in_obs_period"),
        "activated_at",
        "created_at",
    )


def days_without_stock(stock: DataFrame, seen: Observation = Observation()) -> DataFrame:
    """Stock rows with nothing on stock within the period, per sku."""
    empty = seen.current(stock).filter(
        aged_at_most(stock, "stock_date", seen.moment, seen.days) & (F.col("quantity") == 0)
    )
    return once_per_key(empty, "sku", F.count("stock_date").alias("days_without_stock"))


def visibility_period(product: DataFrame, stock: DataFrame, seen: Observation = Observation()) -> DataFrame:
    """Active days less days without stock; the whole period for a sku never out of stock."""
    joined = days_active(product, seen).join(days_without_stock(stock, seen), "sku", "left")
    return joined.select("sku", visible_days(seen).alias("visibility_period"))


def visible_days(seen: Observation) -> Column:
    empty = F.col("days_without_stock")
    return F.when(empty.isNull(), F.lit(seen.days).cast("long")).otherwise(
        F.col("days_active_in_obs_period") - empty
    )


def sales_in_observation(items: DataFrame, seen: Observation = Observation()) -> DataFrame:
    """Item rows sold within the period and not canceled, per sku."""
    sold = seen.current(items).filter(
        aged_at_most(items, "created_at", seen.moment, seen.days) & outside(NET_OF_CANCEL)
    )
    return sold.groupBy("sku").agg(F.count("id_sales_order_item").alias("sold_items_before_return"))


def stock_on_hand(stock: DataFrame, seen: Observation = Observation()) -> DataFrame:
    """Quantity per sku and stock time, for stock exactly ``stock_point`` days old."""
    observed = seen.current(stock).filter(aged_exactly(stock, "stock_date", seen.moment, seen.stock_point))
    return observed.groupBy("sku", "stock_date").agg(F.sum("quantity").alias("amount_on_stock"))
