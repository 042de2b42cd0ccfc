"""Return and cancellation rates per name, sku, config sku and brand."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnlens.functions.periods import Lookback, open_period
from returnlens.functions.pruning import between_ends
from returnlens.functions.rates import difference_rate, rounded_difference_rate
from returnlens.functions.skew import order_rows, row_counts
from returnlens.functions.states import (
    AFTER_CANCEL_EXCH,
    AFTER_RETURN,
    AFTER_RETURN_OLD,
    BEFORE_RETURN_REJ,
    GROSS,
)
from returnlens.operators.units import ordered_units, sums

PERIOD = Lookback(start=78, end=30)

RETURN_COUNTS = {"sold_articles_bef_return": BEFORE_RETURN_REJ, "sold_articles": AFTER_RETURN_OLD}

RETURN_CANCEL_COUNTS = {
    "bef_return": BEFORE_RETURN_REJ,
    "aft_return": AFTER_RETURN,
    "bef_cancellation": GROSS,
    "aft_cancellation": AFTER_CANCEL_EXCH,
}


def period_units(
    items: DataFrame, orders: DataFrame, counts: Mapping[str, Iterable[str]], lookback: Lookback
) -> DataFrame:
    """Distinct items ordered within the period."""
    in_period = orders.filter(open_period(orders, "created_at", lookback))
    near = between_ends(items, "fk_sales_order", in_period, "id_sales_order")
    return ordered_units(near, order_rows(in_period), counts)


def return_rate_by_name(items: DataFrame, orders: DataFrame, lookback: Lookback = PERIOD) -> DataFrame:
    return _return_rate(items, orders, "name", lookback)


def return_rate_by_sku(items: DataFrame, orders: DataFrame, lookback: Lookback = PERIOD) -> DataFrame:
    return _return_rate(items, orders, "sku", lookback)


def return_rate_by_config_sku(items: DataFrame, orders: DataFrame, lookback: Lookback = PERIOD) -> DataFrame:
    return _return_rate(items, orders, "productsku", lookback)


def return_rate_by_brand(
    items: DataFrame, orders: DataFrame, product: DataFrame, lookback: Lookback = PERIOD
) -> DataFrame:
    """Per brand of the config sku's catalogue rows; the NULL group holds unmatched skus too."""
    configs = _config_brand_counts(items, orders, product, RETURN_COUNTS, lookback)
    return _with_return_rate(configs.groupBy("brand").agg(*sums(RETURN_COUNTS)), "brand")


def config_return_cancel_rates(
    items: DataFrame, orders: DataFrame, product: DataFrame, lookback: Lookback = PERIOD
) -> DataFrame:
    """Four counters and two unrounded rates per (config sku, brand)."""
    counts = config_brand_counts(items, orders, product, lookback)
    return _return_cancel(counts, ["productsku", "brand"], "products", "product")


def brand_rates_unfiltered(
    items: DataFrame, orders: DataFrame, product: DataFrame, lookback: Lookback = PERIOD
) -> DataFrame:
    """Four counters and two unrounded rates per brand."""
    return _return_cancel(_brand_counts(items, orders, product, lookback), ["brand"], "brands", "brand")


def brand_return_cancel_rates(
    items: DataFrame,
    orders: DataFrame,
    product: DataFrame,
    lookback: Lookback = PERIOD,
    minimum: int = 100,
) -> DataFrame:
    """Rates rounded to 2 digits, for brands with at least ``minimum`` items before returns."""
    enough = _brand_counts(items, orders, product, lookback).filter(F.col("bef_return") >= minimum)
    return _return_cancel(enough, ["brand"], "brands", "brand", digits=2)


def config_brand_counts(
    items: DataFrame, orders: DataFrame, product: DataFrame, lookback: Lookback = PERIOD
) -> DataFrame:
    """The four counters per (config sku, brand); the level all return/cancel rates start from."""
    return _config_brand_counts(items, orders, product, RETURN_CANCEL_COUNTS, lookback)


def _brand_counts(items, orders, product, lookback) -> DataFrame:
    counts = config_brand_counts(items, orders, product, lookback)
    return counts.groupBy("brand").agg(*sums(RETURN_CANCEL_COUNTS))


def _config_brand_counts(items, orders, product, counts, lookback) -> DataFrame:
    # Both sides are aggregated to one row per key first, so a hot sku is one row in the join;
    # duplicate catalogue rows multiply the counts through their number.
    per_config = period_units(items, orders, counts, lookback).groupBy("productsku").agg(*sums(counts))
    brands = row_counts(product, "sku", "brand")
    times = F.coalesce("copies", F.lit(1))
    return per_config.join(brands, per_config.productsku == brands.sku, "left").select(
        "productsku", "brand", *((F.col(n) * times).alias(n) for n in counts)
    )


def _return_rate(items, orders, key, lookback) -> DataFrame:
    units = period_units(items, orders, RETURN_COUNTS, lookback)
    return _with_return_rate(units.groupBy(key).agg(*sums(RETURN_COUNTS)), key)


def _with_return_rate(totals: DataFrame, key: str) -> DataFrame:
    before, after = F.col("sold_articles_bef_return"), F.col("sold_articles")
    return totals.select(key, before, after, difference_rate(before, after).alias("return_rate_description"))


def _return_cancel(counts: DataFrame, keys: list[str], plural: str, singular: str, digits: int | None = None):
    def rate(before, after):
        if digits is None:
            return difference_rate(F.col(before), F.col(after))
        return rounded_difference_rate(F.col(before), F.col(after), digits)

    return counts.select(
        *keys,
        F.col("bef_return").alias(f"sold_{plural}_bef_return"),
        F.col("aft_return").alias(f"sold_{plural}_aft_return"),
        rate("bef_return", "aft_return").alias(f"return_rate_{singular}"),
        F.col("bef_cancellation").alias(f"sold_{plural}_bef_cancellation"),
        F.col("aft_cancellation").alias(f"sold_{plural}_aft_cancellation"),
        rate("bef_cancellation", "aft_cancellation").alias(f"cancellation_rate_{singular}"),
    )
