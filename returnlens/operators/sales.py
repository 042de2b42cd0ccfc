"""Sales counts and product listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnlens.functions.skew import missing_blank, once_per_key, order_rows, row_counts
from returnlens.functions.states import AFTER_RETURN_OLD, BEFORE_RETURN_REJ, flag, outside


def count_sales_before_returns(items: DataFrame) -> DataFrame:
    return items.filter(outside(BEFORE_RETURN_REJ)).agg(
        F.count_distinct("id_sales_order_item").alias("dc_id_sales_order_item")
    )


def sum_sales_before_returns(items: DataFrame) -> DataFrame:
    """The same number as a sum, NULL instead of 0 when nothing was sold."""
    ids = items.filter(outside(BEFORE_RETURN_REJ)).select("id_sales_order_item").distinct()
    return ids.agg(F.sum(F.lit(1)).alias("sales_bef_rev"))


def count_sales_after_returns(items: DataFrame) -> DataFrame:
    return items.filter(outside(AFTER_RETURN_OLD)).agg(
        F.count_distinct("id_sales_order_item").alias("sold_articles")
    )


def product_order_listing(product: DataFrame, items: DataFrame, orders: DataFrame) -> DataFrame:
    """Every catalogue row with each of its sold items and the order time.

    Unsold products are added by an anti join rather than kept by an outer join: an outer join
    can be cut only on the preserved side, and the uneven side here is the items.
    """
    catalogue = product.select("parent_id", "entity_id", F.col("sku").alias("product_sku"), missing_blank("type_id"))
    placed = orders.select("id_sales_order", "created_at")
    sold = items.select(F.col("sku").alias("item_sku"), "fk_sales_order")
    timed = sold.join(placed, sold.fk_sales_order == placed.id_sales_order, "left")
    listed = catalogue.join(timed, catalogue.product_sku == timed.item_sku)
    sold_skus = once_per_key(sold, "item_sku")
    unsold = catalogue.join(sold_skus, catalogue.product_sku == sold_skus.item_sku, "left_anti")
    columns = ["parent_id", "entity_id", "product_sku", "type_id", "item_sku", "created_at"]
    return listed.select(*columns).unionByName(
        unsold.withColumn("item_sku", F.lit(None).cast("string")).withColumn(
            "created_at", F.lit(None).cast(placed.schema["created_at"].dataType)
        )
    )


def product_parent_listing(product: DataFrame) -> DataFrame:
    """Every catalogue row with its parent row; rows without a parent are kept."""
    child = product.select("entity_id", "parent_id", "sku")
    parent = product.select(
        F.col("entity_id").alias("parent_entity_id"),
        F.col("parent_id").alias("parent_parent_id"),
        F.col("sku").alias("parent_sku"),
    )
    listed = child.join(parent, child.parent_id == parent.parent_entity_id, "left")
    return listed.select(
        "entity_id", "parent_id", "parent_entity_id", "parent_parent_id", "sku", "parent_sku"
    )


def sold_articles_tagged(product: DataFrame, items: DataFrame, orders: DataFrame) -> DataFrame:
    """Item rows before and after returns per sku, for products that have a parent.

    Nothing is deduplicated: an item row counts once per matching order row and catalogue row.
    """
    counts = {"sold_articles_bef_return": BEFORE_RETURN_REJ, "sold_articles": AFTER_RETURN_OLD}
    sold = items.filter(outside(set(BEFORE_RETURN_REJ) & set(AFTER_RETURN_OLD))).select(
        "sku", "fk_sales_order", *(flag(outside(states)).alias(name) for name, states in counts.items())
    )
    placed = order_rows(orders)
    times = F.coalesce("order_rows", F.lit(1))
    per_sku = (
        sold.join(placed, sold.fk_sales_order == placed.id_sales_order, "left")
        .groupBy("sku")
        .agg(*(F.sum(F.col(n) * times).alias(n) for n in counts))
    )
    children = row_counts(product.filter(F.col("parent_id").isNotNull()), "sku")
    return per_sku.join(children, "sku").select(
        "sku", *((F.col(n) * F.col("copies")).alias(n) for n in counts)
    )
