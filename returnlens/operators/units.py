"""Sold units: one row per distinct item with one count per set of shipment states."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnlens.functions.skus import config_prefix
from returnlens.functions.states import flag, outside

UNIT_KEY = ("fk_sales_order", "id_sales_order_item", "sku", "name")


def flagged_items(items: DataFrame, counts: Mapping[str, Iterable[str]]) -> DataFrame:
    """Item rows with a 0/1 column per count; rows that no count takes are left out."""
    never_counted = set.intersection(*(set(states) for states in counts.values()))
    return items.filter(outside(sorted(never_counted))).select(
        *UNIT_KEY, *(flag(outside(states)).alias(name) for name, states in counts.items())
    )


def ordered_units(
    items: DataFrame, placed: DataFrame, counts: Mapping[str, Iterable[str]], marks: Iterable[str] = ()
) -> DataFrame:
    """Distinct items of the given orders, each count multiplied by the order's rows.

    Several rows of one item (its history) count once per set of states, however many of them
    fall into the set. ``placed`` comes from ``order_rows``. The shuffle that brings items to
    their order also serves the deduplication. ``marks`` are further columns of ``placed`` to keep.
    """
    flagged = flagged_items(items, counts)
    joined = flagged.join(placed, flagged.fk_sales_order == placed.id_sales_order)
    units = joined.groupBy(*UNIT_KEY).agg(
        *(F.max(name).alias(name) for name in counts), *(F.max(c).alias(c) for c in ("order_rows", *marks))
    )
    return units.select(
        "id_sales_order_item",
        "sku",
        "name",
        config_prefix("sku").alias("productsku"),
        *((F.col(name) * F.col("order_rows")).alias(name) for name in counts),
        *marks,
    )


def sums(names: Iterable[str]) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]
