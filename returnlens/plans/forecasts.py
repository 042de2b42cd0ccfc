"""Forecasts that pick, per product, the finest level with enough sales."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnlens.functions.periods import Lookback
from returnlens.functions.rates import fallback_rate, rounded_difference_rate
from returnlens.functions.skew import known, once_per_key
from returnlens.operators import forecast, returns, star


def config_brand_forecast(
    items: DataFrame,
    orders: DataFrame,
    product: DataFrame,
    lookback: Lookback = returns.PERIOD,
    minimum: int = 8,
    all_return_rate: float = 1.0,
    all_cancel_rate: float = 1.0,
) -> DataFrame:
    """Config sku, else brand, else a constant; the cancellation rate is always a constant.

    The brand level is summed from the config level, so the items are read once. A product
    without a brand finds no brand level.
    """
    counts = returns.config_brand_counts(items, orders, product, lookback)
    before, after = F.col("bef_return"), F.col("aft_return")
    own = counts.select(
        "productsku", "brand", before.alias("own_count"), rounded_difference_rate(before, after, 2).alias("own_rate")
    )
    brand = once_per_key(
        counts.withColumn("brand", known("brand")),
        "brand",
        F.sum(before).alias("bef_return"),
        F.sum(after).alias("aft_return"),
    )
    brand = brand.select(
        "brand", before.alias("brand_count"), rounded_difference_rate(before, after, 2).alias("brand_rate")
    )
    chosen = fallback_rate(
        F.col("own_count"),
        F.col("own_rate"),
        F.col("brand_count"),
        F.col("brand_rate"),
        F.round(F.lit(all_return_rate), 2),
        minimum,
    )
    return own.join(brand, "brand", "left").select(
        F.col("productsku").alias("sku"),
        "brand",
        chosen.alias("return_rate_forecast"),
        F.round(F.lit(all_cancel_rate), 2).alias("cancellation_rate_forecast"),
    )


def star_return_forecast(
    fct_sales: DataFrame,
    dim_dates: DataFrame,
    dim_articles: DataFrame,
    dim_products: DataFrame,
    lookback: Lookback = star.PERIOD,
    minimum: int = 8,
) -> DataFrame:
    """Sku, else targetgroup, else description; the last level has no minimum."""
    sales = star.product_sales(fct_sales, dim_dates, dim_articles, dim_products, lookback)
    before, after = (F.col(n) for n in star.SOLD)
    rate = rounded_difference_rate(before, after, 2)
    own = star.with_attributes(star.level_sales(sales, "sku"), fct_sales, dim_dates, dim_products, lookback).select(
        "product_sku", "targetgroup", "description", before.alias("own_count"), rate.alias("own_rate")
    )
    targetgroup = star.level_sales(sales, "targetgroup").select(
        "targetgroup", before.alias("targetgroup_count"), rate.alias("targetgroup_rate")
    )
    description = star.level_sales(sales, "description").select("description", rate.alias("description_rate"))
    chosen = fallback_rate(
        F.col("own_count"),
        F.col("own_rate"),
        F.col("targetgroup_count"),
        F.col("targetgroup_rate"),
        F.col("description_rate"),
        minimum,
    )
    return own.join(targetgroup, "targetgroup").join(description, "description").select(
        "product_sku", "targetgroup", "description", chosen.alias("return_rate_forecast")
    )


def return_cancel_forecast(
    items: DataFrame,
    product: DataFrame,
    venture: str,
    lookback: Lookback = forecast.PERIOD,
    minimum: int = 30,
) -> DataFrame:
    """Config sku, else brand, else total; the cancellation forecast is the total rate."""
    counts = forecast.sku_counts(items, lookback)
    config = forecast.config_level_of(counts, product, venture).withColumnRenamed(
        "sold_items_before_cancellation", "sold_items_bfr_cancel_config"
    )
    brand = forecast.brand_level_of(counts, product, venture).select(
        "brand", F.col("sold_items_before_cancellation").alias("brand_sold"), "return_rate_brand_lvl"
    )
    total = forecast.total_level_of(counts, product, venture).select(
        "venture", "return_rate_total_lvl", "cancel_rate_total_lvl"
    )
    chosen = fallback_rate(
        F.col("sold_items_bfr_cancel_config"),
        F.col("return_rate_config_lvl"),
        F.col("brand_sold"),
        F.col("return_rate_brand_lvl"),
        F.col("return_rate_total_lvl"),
        minimum,
    )
    # The total is one row by construction (grouped by a constant). As a scalar subquery it would
    # not share the scan of the items.
    return (
        config.join(brand, "brand")
        .join(F.broadcast(total), "venture")
        .select(
            "config_sku",
            "brand",
            "venture",
            "sold_items_bfr_cancel_config",
            chosen.alias("return_rate_forecast"),
            F.col("cancel_rate_total_lvl").alias("cancel_rate_forecast"),
        )
    )
