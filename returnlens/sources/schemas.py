"""Columns of the input tables."""

from __future__ import annotations

SCHEMAS = {
    "sales_order_item": (
        "id_sales_order_item bigint, fk_sales_order bigint, sku string, name string, "
        "paid_price decimal(12,2), dwh_shipment_state string, created_at timestamp_ntz, "
        "dg_end_date timestamp_ntz"
    ),
    "sales_order": (
        "id_sales_order bigint, order_nr string, mage_customer_entity_id bigint, "
        "created_at timestamp_ntz, dg_end_date timestamp_ntz"
    ),
    "product": (
        "sku string, type_id string, entity_id bigint, parent_id bigint, brand string, status int, "
        "inventory_type string, activated_at timestamp_ntz, created_at timestamp_ntz, "
        "dg_end_date timestamp_ntz"
    ),
    "stock": "sku string, stock_date timestamp_ntz, quantity bigint, dg_end_date timestamp_ntz",
    "web_orders": "order_id string, sid bigint",
    "web_visitors": "sid bigint",
    "web_campaigns": "sid bigint, campaign string",
    "web_confdata": "datasourcevalue string, campaign string, category_4th_level string",
    "order_list": "order_nr string",
    "dim_dates": "date_id int, iso_date string",
    "dim_articles": "article_id bigint, product_id bigint",
    "dim_products": (
        "product_id bigint, sku string, targetgroup string, description string, "
        "valid_from date, valid_to date"
    ),
    "fct_sales": "date_id int, article_id bigint, sold_articles_bef_return int, sold_articles int",
}

# An empty string means "missing" in every text column. It is read as NULL, except in columns that are filtered by
# constants: there the comparisons leave it out, and their filters reach the scan.
BLANK_KEPT = {
    "sales_order_item": ("dwh_shipment_state",),
    "product": ("type_id", "inventory_type"),
}


def blank_is_null(table: str, column: str, kind: str) -> bool:
    return kind == "string" and column not in BLANK_KEPT.get(table, ())
