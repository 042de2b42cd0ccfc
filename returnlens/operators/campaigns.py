"""Sales that came, or did not come, through a web campaign or an order list."""

from __future__ import annotations

import functools
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnlens.functions.periods import Lookback, between, now, timestamp, whole_days_after
from returnlens.functions.pruning import between_ends, likely_partners
from returnlens.functions.rates import MONEY, difference_rate, rounded_difference_rate
from returnlens.functions.skew import once_per_key, order_rows
from returnlens.functions.states import AFTER_RETURN, GROSS, NET_OF_CANCEL, flag, outside
from returnlens.operators.units import UNIT_KEY, flagged_items, ordered_units, sums

PERIOD = Lookback(start=150, end=30)
PATTERN = "ABANDONED"

PRODUCT_COUNTS = ("sold_products_bef_return", "sold_products_aft_return")

# Count suffix -> states left out.
STAGES = {"_bef_cancel": GROSS, "_bef_return": NET_OF_CANCEL, "": AFTER_RETURN}


def mentions(column: str, pattern: str) -> Column:
    return F.upper(column).contains(pattern.upper())


def reached_orders(
    web_orders: DataFrame, web_campaigns: DataFrame, confdata: DataFrame, pattern: str = PATTERN
) -> DataFrame:
    """Order numbers with a session of a campaign whose category mentions the pattern, each once."""
    matching = confdata.filter(mentions("category_4th_level", pattern))
    codes = once_per_key(matching, "datasourcevalue")
    sessions = web_campaigns.join(codes, web_campaigns.campaign == codes.datasourcevalue, "left_semi")
    reached = web_orders.join(once_per_key(sessions, "sid"), "sid", "left_semi")
    return once_per_key(reached.select(F.col("order_id").alias("order_nr")), "order_nr")


def order_list_return_rate(items: DataFrame, orders: DataFrame, order_list: DataFrame) -> DataFrame:
    """Per config sku, for the orders whose number is in ``order_list`` (column ``order_nr``)."""
    listed = orders.join(once_per_key(order_list, "order_nr"), "order_nr", "left_semi")
    counts = dict(zip(PRODUCT_COUNTS, (GROSS, AFTER_RETURN)))
    placed = order_rows(_distinct_rows(listed))
    # Every order has a row. Asking for it keeps the number, so that the bit set reads the same shuffle as the join.
    near = likely_partners(items, "fk_sales_order", placed.filter("order_rows > 0"), "id_sales_order")
    units = ordered_units(near, placed, counts)
    return _product_rate(units.groupBy("productsku").agg(*sums(PRODUCT_COUNTS)))


def non_campaign_return_rate(
    items: DataFrame,
    orders: DataFrame,
    web_orders: DataFrame,
    web_campaigns: DataFrame,
    confdata: DataFrame,
    start: datetime,
    end: datetime,
    pattern: str = PATTERN,
) -> DataFrame:
    """Per config sku, for orders of [start, end] without items a campaign reached.

    Each count leaves out its own set of reached item ids, by the rule of NOT IN: a reached item without an id
    empties the count, and an item without an id counts only if nothing was reached. Items are read and joined once:
    the orders carry the mark whether a campaign reached them, and one shuffle by item id brings together what an
    item's units count and whether one of them was reached.
    """
    before, after = PRODUCT_COUNTS
    counts = {before: NET_OF_CANCEL, after: AFTER_RETURN}
    placed = _placed_between(orders, start, end)
    near = between_ends(items, "fk_sales_order", placed, "id_sales_order")
    numbers = reached_orders(web_orders, web_campaigns, confdata, pattern).withColumnRenamed("order_nr", "reached_nr")
    listed = _distinct_rows(placed)
    marked = listed.join(numbers, listed.order_nr == numbers.reached_nr, "left")
    by_order = once_per_key(
        marked,
        "id_sales_order",
        F.count(F.lit(1)).alias("order_rows"),
        F.max(flag(F.col("reached_nr").isNotNull())).alias("reached"),
    )
    units = ordered_units(near, by_order, counts, marks=("reached",))

    # One row per item id, with the counts of its skus and whether the campaign reached them. Items without an id are
    # never equal, so they stay apart by sku.
    item = F.col("id_sales_order_item")
    hits = {n: flag((F.col("reached") == 1) & (F.col(n) > 0)) for n in counts}
    per_item = units.groupBy(item, F.when(item.isNull(), F.col("productsku")).alias("unnamed")).agg(
        *(F.max(hit).alias(f"hit_{n}") for n, hit in hits.items()),
        F.collect_list(F.struct("productsku", *counts)).alias("skus"),
    )
    entries = per_item.select(item.isNull().alias("unnamed"), *(f"hit_{n}" for n in counts), F.inline("skus"))
    per_sku = entries.groupBy("productsku").agg(
        *(F.sum(F.when(~F.col("unnamed") & (F.col(f"hit_{n}") == 0), F.col(n)).otherwise(0)).alias(f"free_{n}") for n in counts),
        *(F.sum(F.when(F.col("unnamed"), F.col(n)).otherwise(0)).alias(f"unnamed_{n}") for n in counts),
        *(F.max(f"hit_{n}").alias(f"any_{n}") for n in counts),
        *(F.max(F.when(F.col("unnamed"), F.col(f"hit_{n}")).otherwise(0)).alias(f"null_{n}") for n in counts),
    )
    # Nothing is negative. Asking for all columns keeps them, so that the ends come from the same shuffles as the rest.
    # They are joined, not a scalar subquery: adaptive execution plans a subquery apart from the rest and would then
    # run the join of items and orders again.
    per_sku = per_sku.filter(functools.reduce(lambda x, y: x & y, (F.col(c) >= 0 for c in per_sku.columns[1:])))
    ends = per_sku.agg(*(F.max(f"{kind}_{n}").alias(f"{kind}where_{n}") for n in counts for kind in ("any", "null")))
    totals = per_sku.crossJoin(F.broadcast(ends)).select(
        "productsku",
        *(
            F.when(F.col(f"nullwhere_{n}") == 1, F.lit(0))
            .when(F.col(f"anywhere_{n}") == 1, F.col(f"free_{n}"))
            .otherwise(F.col(f"free_{n}") + F.col(f"unnamed_{n}"))
            .alias(n)
            for n in counts
        ),
    )
    return _product_rate(totals.filter((F.col(before) > 0) | (F.col(after) > 0)))


def campaign_return_rate(
    items: DataFrame,
    orders: DataFrame,
    web_orders: DataFrame,
    web_campaigns: DataFrame,
    confdata: DataFrame,
    start: datetime,
    end: datetime,
    pattern: str = PATTERN,
) -> DataFrame:
    """Per simple sku (in column ``productsku``), for orders of [start, end] a campaign reached."""
    counts = dict(zip(PRODUCT_COUNTS, (NET_OF_CANCEL, AFTER_RETURN)))
    placed = _placed_between(orders, start, end)
    near = between_ends(items, "fk_sales_order", placed, "id_sales_order")
    reached = _reached_items(near, placed, web_orders, web_campaigns, confdata, pattern, counts)
    units = reached.groupBy(*UNIT_KEY).agg(*(F.max(n).alias(n) for n in counts))
    return _product_rate(units.groupBy(F.col("sku").alias("productsku")).agg(*sums(PRODUCT_COUNTS)))


def abandoned_campaign_totals(
    items: DataFrame,
    orders: DataFrame,
    product: DataFrame,
    web_orders: DataFrame,
    web_visitors: DataFrame,
    web_campaigns: DataFrame,
    confdata: DataFrame,
    as_of: datetime | None = None,
    lookback: Lookback = PERIOD,
    pattern: str = PATTERN,
) -> DataFrame:
    """One row: orders, items, customers and revenue of campaign orders at three stages."""
    entries = _first_entries(
        items, orders, product, web_orders, web_visitors, web_campaigns, confdata, as_of, lookback, pattern
    )
    return _with_total_rates(entries.agg(*_total_sums()))


def abandoned_totals_by_config(
    items: DataFrame,
    orders: DataFrame,
    product: DataFrame,
    web_orders: DataFrame,
    web_visitors: DataFrame,
    web_campaigns: DataFrame,
    confdata: DataFrame,
    as_of: datetime | None = None,
    lookback: Lookback = PERIOD,
    pattern: str = PATTERN,
) -> DataFrame:
    """The same totals per config sku, highest item return rate first."""
    entries = _first_entries(
        items, orders, product, web_orders, web_visitors, web_campaigns, confdata, as_of, lookback, pattern
    )
    per_sku = entries.groupBy("sku").agg(*_total_sums())
    simple, config = _current_catalogue(product, as_of)
    # A sku listed more than once belongs to its first simple row's first config row.
    first_config = (
        simple.join(config, simple.parent_id == config.config_id)
        .groupBy("sku")
        .agg(F.min(F.struct("simple_id", "config_id", "productsku")).alias("first"))
        .select("sku", "first.productsku")
    )
    names = [c for c in per_sku.columns if c != "sku"]
    totals = per_sku.join(first_config, "sku").groupBy("productsku").agg(*sums(names))
    return _with_total_rates(totals, "productsku").orderBy(
        F.desc_nulls_first("return_rate_item_based"), "productsku"
    )


def _placed_between(orders: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return orders.filter(between(orders, "created_at", start, end))


def _distinct_rows(orders: DataFrame) -> DataFrame:
    return orders.select("id_sales_order", "order_nr", "created_at").distinct()


def _reached_items(items, placed, web_orders, web_campaigns, confdata, pattern, counts) -> DataFrame:
    numbers = reached_orders(web_orders, web_campaigns, confdata, pattern)
    reached = once_per_key(placed.join(numbers, "order_nr", "left_semi"), "id_sales_order")
    flagged = flagged_items(likely_partners(items, "fk_sales_order", reached, "id_sales_order"), counts)
    return flagged.join(reached, flagged.fk_sales_order == reached.id_sales_order, "left_semi")


def _product_rate(totals: DataFrame) -> DataFrame:
    before, after = (F.col(n) for n in PRODUCT_COUNTS)
    return totals.select("productsku", before, after, difference_rate(before, after).alias("return_rate_product"))


def _current_catalogue(product: DataFrame, as_of: datetime | None) -> tuple[DataFrame, DataFrame]:
    moment = now() if as_of is None else timestamp(as_of)
    current = product.filter(F.col("dg_end_date") > moment)
    simple = current.filter(F.col("type_id") == "simple").select(
        "sku", "parent_id", F.col("entity_id").alias("simple_id")
    )
    config = current.filter(F.col("type_id") == "configurable").select(
        F.col("entity_id").alias("config_id"), F.col("sku").alias("productsku")
    )
    return simple, config


def _tracked_orders(web_orders, web_visitors, web_campaigns, confdata, pattern) -> DataFrame:
    """Order numbers with a complete session path, and whether a campaign on it matched.

    Only the matching row of a session, number or order is kept where there is one: its unmatched twin shares the
    order, item and customer and comes later in every ranking.
    """
    match = F.max("abandoned").alias("abandoned")
    codes = once_per_key(
        confdata.withColumn("abandoned", flag(mentions("campaign", pattern))), "datasourcevalue", match
    )
    visited = web_campaigns.join(codes, web_campaigns.campaign == codes.datasourcevalue).select("sid", "abandoned")
    sessions = once_per_key(visited, "sid", match).join(once_per_key(web_visitors, "sid"), "sid", "left_semi")
    numbers = web_orders.join(sessions, "sid").select(F.col("order_id").alias("order_nr"), "abandoned")
    return once_per_key(numbers, "order_nr", match)


def _first_entries(
    items, orders, product, web_orders, web_visitors, web_campaigns, confdata, as_of, lookback, pattern
) -> DataFrame:
    """First entry of each campaign item, marked when it also opens its order or customer.

    The rows are ordered by item id, then order id, campaign match first. One aggregation over
    three groupings finds the first row per item, per order and per customer; it combines on
    the map side, where a ranking window would put a hot customer into one task.
    """
    moment = now() if as_of is None else timestamp(as_of)
    sold = items.filter(
        (F.col("dg_end_date") > moment) & whole_days_after(items, "created_at", lookback)
    ).select("id_sales_order_item", "fk_sales_order", "sku", "dwh_shipment_state", "paid_price")
    simple, config = _current_catalogue(product, as_of)
    configs = once_per_key(config, "config_id")
    listed = once_per_key(simple.join(configs, simple.parent_id == configs.config_id, "left_semi"), "sku")

    tracked = _tracked_orders(web_orders, web_visitors, web_campaigns, confdata, pattern)
    placed = (
        orders.filter(F.col("dg_end_date") > moment)
        .select("id_sales_order", "order_nr", F.col("mage_customer_entity_id").alias("customer"))
        .join(tracked, "order_nr")
        .groupBy("id_sales_order", "order_nr", "customer")
        .agg(F.max("abandoned").alias("abandoned"))
    )
    # An inner join with distinct skus: a semi join would be pushed below the orders, and all items of the period
    # would be shuffled by sku before the orders have reduced them.
    rows = sold.join(placed, sold.fk_sales_order == placed.id_sales_order).join(listed, "sku")

    entry = F.struct(
        F.col("id_sales_order_item").alias("item"),
        F.col("fk_sales_order").alias("placed_in"),
        (1 - F.col("abandoned")).alias("unmatched"),
        "order_nr",
        "customer",
        "sku",
        "dwh_shipment_state",
        "paid_price",
    )
    keys = ["id_sales_order_item", "order_nr", "customer"]
    firsts = rows.groupingSets([[k] for k in keys], *keys).agg(
        F.grouping("id_sales_order_item").alias("no_item"),
        F.grouping("order_nr").alias("no_order"),
        F.grouping("customer").alias("no_customer"),
        F.min(entry).alias("entry"),
    )
    marked = firsts.groupBy("entry").agg(
        F.max(flag(F.col("no_item") == 0)).alias("opens_item"),
        F.max(flag(F.col("no_order") == 0)).alias("opens_order"),
        F.max(flag(F.col("no_customer") == 0)).alias("opens_customer"),
    )
    return marked.filter((F.col("opens_item") == 1) & (F.col("entry.unmatched") == 0)).select(
        "entry.sku", "entry.dwh_shipment_state", "entry.paid_price", "opens_order", "opens_customer"
    )


def _total_sums() -> list[Column]:
    counted = {suffix: flag(outside(states)) for suffix, states in STAGES.items()}
    return [
        *(F.sum(c * F.col("opens_order")).alias(f"orders{s}") for s, c in counted.items()),
        *(F.sum(c).alias(f"sold_items{s}") for s, c in counted.items()),
        *(F.sum(c * F.col("opens_customer")).alias(f"customers{s}") for s, c in counted.items()),
        *(
            F.sum(F.when(outside(states), F.col("paid_price")).otherwise(0 * F.col("paid_price"))).alias(f"rev{s}")
            for s, states in STAGES.items()
        ),
    ]


def _with_total_rates(totals: DataFrame, *keys: str) -> DataFrame:
    names = [c for c in totals.columns if c not in keys and not c.startswith("rev")]
    money = [F.col(f"rev{s}").cast("decimal(24,2)").alias(f"rev{s}") for s in STAGES]
    return totals.select(
        *keys,
        *names,
        *money,
        rounded_difference_rate(F.col("sold_items_bef_return"), F.col("sold_items"), 3).alias(
            "return_rate_item_based"
        ),
        rounded_difference_rate(F.col("rev_bef_return"), F.col("rev"), 3, MONEY).alias("return_rate_rev_based"),
    )
