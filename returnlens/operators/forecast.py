"""Return and cancellation rates on config, brand and total level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from returnlens.functions.periods import Lookback, whole_days_from
from returnlens.functions.rates import count_rate, quotient
from returnlens.functions.skew import known, once_per_key, row_counts
from returnlens.functions.states import CANCELED, GROSS, SENT_BACK, inside, outside

PERIOD = Lookback(start=150, end=30)
UNSPECIFIED = "unspecified"
COUNTS = ("sold", "canceled", "returned")


def catalog_config_map(product: DataFrame) -> DataFrame:
    """Distinct (simple sku, config sku, brand of the simple)."""
    config = (
        product.filter(F.col("type_id") == "configurable")
        .select(F.col("sku").alias("config_sku"), F.col("entity_id").alias("config_id"))
        .distinct()
    )
    simple = product.filter(F.col("type_id") == "simple").select("sku", "parent_id", "brand").distinct()
    return simple.join(config, simple.parent_id == config.config_id).select("sku", "config_sku", "brand").distinct()


def sku_counts(items: DataFrame, lookback: Lookback = PERIOD) -> DataFrame:
    """Sold (not invalid), canceled and returned item rows of the period per simple sku.

    All levels start from this table and need all of it, so the items are read, filtered and
    shuffled once, and a hot sku or brand is a single row in every join that follows. Items
    without a sku stand under ''.
    """
    in_period = items.filter(whole_days_from(items, "created_at", lookback) & outside(GROSS))
    item = F.col("id_sales_order_item")
    return once_per_key(
        in_period.withColumn("sku", known("sku")),
        "sku",
        F.count(item).alias("sold"),
        F.count(F.when(inside([CANCELED]), item)).alias("canceled"),
        F.count(F.when(inside(SENT_BACK), item)).alias("returned"),
    )


def config_level_rates(
    items: DataFrame, product: DataFrame, venture: str, lookback: Lookback = PERIOD
) -> DataFrame:
    return config_level_of(sku_counts(items, lookback), product, venture)


def brand_level_rates(
    items: DataFrame, product: DataFrame, venture: str, lookback: Lookback = PERIOD
) -> DataFrame:
    return brand_level_of(sku_counts(items, lookback), product, venture)


def total_level_rates(
    items: DataFrame, product: DataFrame, venture: str, lookback: Lookback = PERIOD
) -> DataFrame:
    return total_level_of(sku_counts(items, lookback), product, venture)


def config_level_of(counts: DataFrame, product: DataFrame, venture: str) -> DataFrame:
    """Per (config sku, brand): own sales, and the config's cancels and returns over all its brands.

    The window holds one row per brand of a config, already summed.
    """
    mapped = counts.join(catalog_config_map(product), "sku")
    per_brand = mapped.groupBy("config_sku", _brand().alias("brand")).agg(*_sums())
    config = Window.partitionBy("config_sku")

    def over_brands(name: str) -> Column:
        return F.when(F.col("config_sku").isNull(), F.lit(0)).otherwise(F.sum(name).over(config))

    sold, canceled, returned = F.col("sold"), F.col("canceled_items"), F.col("returned_items")
    return (
        per_brand.withColumn("canceled_items", over_brands("canceled"))
        .withColumn("returned_items", over_brands("returned"))
        .select(
            F.lit(venture).alias("venture"),
            "config_sku",
            "brand",
            sold.alias("sold_items_before_cancellation"),
            "canceled_items",
            "returned_items",
            count_rate(returned, sold - canceled).alias("return_rate_config_lvl"),
        )
    )


def brand_level_of(counts: DataFrame, product: DataFrame, venture: str) -> DataFrame:
    """Per brand, over the distinct (sku, brand) pairs of every product type."""
    brands = product.select("sku", "brand").distinct()
    per_brand = once_per_key(counts.join(brands, "sku").withColumn("brand", _brand()), "brand", *_sums())
    sold, canceled, returned = (F.col(n) for n in COUNTS)
    return per_brand.select(
        F.lit(venture).alias("venture"),
        "brand",
        sold.alias("sold_items_before_cancellation"),
        count_rate(returned, sold - canceled).alias("return_rate_brand_lvl"),
    )


def total_level_of(counts: DataFrame, product: DataFrame, venture: str) -> DataFrame:
    """One row, or none without sales.

    Returns count once per catalogue row of their sku, sales and cancels once. The return rate
    is NULL when everything sold was canceled.
    """
    listed = row_counts(product, "sku").select(F.col("sku").alias("listed_sku"), "copies")
    totals = (
        counts.join(listed, counts.sku == listed.listed_sku, "left")
        .withColumn("returned", F.col("returned") * F.coalesce("copies", F.lit(0)))
        .groupBy(F.lit(venture).alias("venture"))
        .agg(*_sums())
    )
    sold, canceled, returned = (F.col(n) for n in COUNTS)
    kept = F.when(sold == 0, F.lit(0.0)).otherwise(quotient(returned, sold - canceled, 2))
    return totals.select(
        "venture",
        sold.alias("sold_items_before_cancellation"),
        kept.alias("return_rate_total_lvl"),
        count_rate(canceled, sold).alias("cancel_rate_total_lvl"),
    )


def _brand() -> Column:
    return F.coalesce("brand", F.lit(UNSPECIFIED))


def _sums() -> list[Column]:
    return [F.sum(n).alias(n) for n in COUNTS]
