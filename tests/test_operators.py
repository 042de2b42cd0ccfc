"""Hand-made cases: one small table per rule."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from collected import rows
from pyspark.sql import functions as F

from returnlens.functions.periods import Lookback
from returnlens.operators import campaigns, forecast, replenishment, returns, sales, star
from returnlens.operators.replenishment import Observation
from returnlens.plans import forecasts
from returnlens.plans.replenishment import replenishment_report, replenishment_report_v2

OPEN, CLOSED = datetime(9999, 12, 31), datetime(1999, 1, 1)
DAY = datetime(2001, 6, 1)
NEWEST = datetime(2001, 8, 1, 7)
LATE = {"id_sales_order": 0, "order_nr": "N0", "created_at": NEWEST, "dg_end_date": OPEN}


def item(number, state="item_delivered", order=1, sku="A-0", name="n", **other):
    base = {
        "id_sales_order_item": number,
        "fk_sales_order": order,
        "sku": sku,
        "name": name,
        "dwh_shipment_state": state,
        "created_at": DAY,
        "dg_end_date": OPEN,
        "paid_price": Decimal("2.00"),
    }
    return base | other


def order(number, created=DAY, **other):
    return {"id_sales_order": number, "order_nr": f"N{number}", "created_at": created, "dg_end_date": OPEN} | other


@pytest.fixture
def orders(make):
    return make("sales_order", [LATE, order(1)])


def by_sku(items, orders):
    return rows(returns.return_rate_by_sku(items, orders))


def test_history_rows_of_an_item_count_once_per_set(make, orders):
    items = make("sales_order_item", [item(1), item(1, dg_end_date=CLOSED), item(1, "item_returned")])
    assert by_sku(items, orders) == [("A-0", 1, 1, 0.0)]


def test_a_returned_row_next_to_a_delivered_one_counts_after_returns(make, orders):
    items = make("sales_order_item", [item(1, "item_returned"), item(2, "item_returned"), item(2)])
    assert by_sku(items, orders) == [("A-0", 2, 1, 0.5)]


def test_rejected_items_make_the_old_rate_negative(make, orders):
    items = make("sales_order_item", [item(1), item(2, "item_rejected")])
    assert by_sku(items, orders) == [("A-0", 1, 2, -1.0)]


def test_items_without_a_counting_state_give_no_group(make, orders):
    items = make("sales_order_item", [item(1, "item_invalid"), item(2, "item_canceled"), item(3, None)])
    assert by_sku(items, orders) == []


def test_an_order_listed_twice_doubles_its_items(make):
    doubled = make("sales_order", [LATE, order(1), order(1, DAY + timedelta(days=1))])
    items = make("sales_order_item", [item(1), item(1, dg_end_date=CLOSED)])
    assert by_sku(items, doubled) == [("A-0", 2, 2, 0.0)]


def test_orders_on_the_period_bounds_are_outside(make):
    low, high = NEWEST - timedelta(days=78), NEWEST - timedelta(days=30)
    second = timedelta(seconds=1)
    placed = make(
        "sales_order", [LATE, order(1, low), order(2, low + second), order(3, high - second), order(4, high)]
    )
    items = make("sales_order_item", [item(n, order=n, sku=f"S{n}") for n in (1, 2, 3, 4)])
    assert [r[0] for r in by_sku(items, placed)] == ["S2", "S3"]


def test_config_sku_without_prefix_is_one_null_group(make, orders):
    items = make("sales_order_item", [item(1, sku="nodash"), item(2, sku="-x"), item(3, sku="A-1")])
    assert rows(returns.return_rate_by_config_sku(items, orders)) == [(None, 2, 2, 0.0), ("A", 1, 1, 0.0)]


def test_brand_takes_every_catalogue_row_and_keeps_unmatched_items(make, orders):
    items = make("sales_order_item", [item(1), item(2, sku="Z-1")])
    product = make("product", [{"sku": "A", "brand": "x"}, {"sku": "A", "brand": "x"}, {"sku": "A", "brand": None}])
    assert rows(returns.return_rate_by_brand(items, orders, product)) == [(None, 2, 2, 0.0), ("x", 2, 2, 0.0)]


def test_brand_floor_counts_items_before_returns(make, orders):
    items = make("sales_order_item", [item(n, "item_returned" if n == 0 else "item_delivered") for n in range(3)])
    product = make("product", [{"sku": "A", "brand": "x"}])
    kept = returns.brand_return_cancel_rates(items, orders, product, minimum=3)
    assert rows(kept) == [("x", 3, 2, 0.33, 3, 3, 0.0)]
    assert rows(returns.brand_return_cancel_rates(items, orders, product, minimum=4)) == []


def test_exchanged_items_count_as_canceled(make, orders):
    items = make("sales_order_item", [item(1), item(2, "item_exchanged")])
    product = make("product", [{"sku": "A", "brand": "x"}])
    found = returns.config_return_cancel_rates(items, orders, product)
    assert rows(found) == [("A", "x", 2, 1, 0.5, 2, 1, 0.5)]


def test_config_brand_forecast_levels(make, orders):
    items = make(
        "sales_order_item",
        [item(n, "item_returned" if n < 2 else "item_delivered", sku="A-0") for n in range(8)]
        + [item(100 + n, sku="B-0") for n in range(2)]
        + [item(200, sku="C-0"), item(300, sku="D-0")],
    )
    product = make(
        "product",
        [{"sku": "A", "brand": "x"}, {"sku": "B", "brand": "x"}, {"sku": "C", "brand": "y"}, {"sku": "D"}],
    )
    found = forecasts.config_brand_forecast(items, orders, product, all_return_rate=0.555, all_cancel_rate=0.1)
    assert rows(found) == [
        ("A", "x", 0.25, 0.1),
        ("B", "x", 0.2, 0.1),
        ("C", "y", 0.56, 0.1),
        ("D", None, 0.56, 0.1),
    ]


def test_simple_counts(make):
    items = make("sales_order_item", [item(1), item(1, "item_returned"), item(2, "item_rejected"), item(3, None)])
    assert rows(sales.count_sales_before_returns(items)) == [(1,)]
    assert rows(sales.sum_sales_before_returns(items)) == [(1,)]
    assert rows(sales.count_sales_after_returns(items)) == [(2,)]
    nothing = make("sales_order_item", [])
    assert rows(sales.count_sales_before_returns(nothing)) == [(0,)]
    assert rows(sales.sum_sales_before_returns(nothing)) == [(None,)]


def test_listing_keeps_unsold_products_and_items_without_an_order(make, orders):
    product = make("product", [{"sku": "A-0", "entity_id": 1}, {"sku": "B", "entity_id": 2}, {"entity_id": 3}])
    items = make("sales_order_item", [item(1), item(2, order=99), item(3, sku=None)])
    found = sales.product_order_listing(product, items, orders)
    assert rows(found, "entity_id", "item_sku", "created_at") == [
        (1, "A-0", None),
        (1, "A-0", DAY),
        (2, None, None),
        (3, None, None),
    ]


def test_parent_listing_keeps_rows_without_a_parent(make):
    product = make("product", [{"sku": "A-0", "entity_id": 1, "parent_id": 9}, {"sku": "A", "entity_id": 9}])
    assert rows(sales.product_parent_listing(product)) == [
        (1, 9, 9, None, "A-0", "A"),
        (9, None, None, None, "A", None),
    ]


def test_tagged_sales_multiply_by_order_and_catalogue_rows(make):
    product = make("product", [{"sku": "A-0", "parent_id": 9}] * 2 + [{"sku": "B-0"}])
    placed = make("sales_order", [order(1), order(1, dg_end_date=CLOSED)])
    items = make("sales_order_item", [item(1), item(1, "item_returned"), item(2, order=99), item(3, sku="B-0")])
    assert rows(sales.sold_articles_tagged(product, items, placed)) == [("A-0", 10, 6)]


def web(make, **tables):
    kept = {"web_orders": [], "web_campaigns": [], "web_confdata": []} | tables
    return [make(name, kept[name]) for name in ("web_orders", "web_campaigns", "web_confdata")]


CODES = [
    {"datasourcevalue": "c1", "campaign": "x abandoned y", "category_4th_level": "Mail Abandoned"},
    {"datasourcevalue": "c2", "campaign": "other", "category_4th_level": "other"},
]


def test_order_list_takes_each_order_once_and_ignores_unknown_numbers(make, orders):
    items = make("sales_order_item", [item(1), item(2, "item_canceled"), item(3, "item_invalid"), item(4, order=0)])
    listed = make("order_list", [{"order_nr": "N1"}, {"order_nr": "N1"}, {"order_nr": "none"}, {}])
    assert rows(campaigns.order_list_return_rate(items, orders, listed)) == [("A", 2, 1, 0.5)]


def test_campaign_rate_takes_an_item_once_for_several_sessions(make, orders):
    tables = web(
        make,
        web_orders=[{"order_id": "N1", "sid": s} for s in (1, 1, 2)],
        web_campaigns=[{"sid": 1, "campaign": "c1"}, {"sid": 2, "campaign": "c1"}, {"sid": 2, "campaign": "c2"}],
        web_confdata=CODES + CODES,
    )
    items = make("sales_order_item", [item(1), item(2, "item_returned")])
    found = campaigns.campaign_return_rate(items, orders, *tables, DAY, DAY)
    assert rows(found) == [("A-0", 2, 1, 0.5)]
    assert rows(campaigns.non_campaign_return_rate(items, orders, *tables, DAY, DAY)) == []


def test_the_date_range_ends_at_the_given_instant(make):
    end = datetime(2001, 6, 30)
    placed = make("sales_order", [order(1, end), order(2, end + timedelta(seconds=1))])
    items = make("sales_order_item", [item(n, order=n, sku=f"S{n}-0") for n in (1, 2)])
    found = campaigns.non_campaign_return_rate(items, placed, *web(make), datetime(2001, 6, 1), end)
    assert rows(found, "productsku") == [("S1",)]


def test_a_reached_item_without_an_id_empties_the_count(make):
    placed = make("sales_order", [order(1), order(2)])
    tables = web(
        make,
        web_orders=[{"order_id": "N1", "sid": 1}],
        web_campaigns=[{"sid": 1, "campaign": "c1"}],
        web_confdata=CODES,
    )
    items = make("sales_order_item", [item(None), item(2, order=2)])
    found = campaigns.non_campaign_return_rate(items, placed, *tables, DAY, DAY)
    assert rows(found) == []


def test_an_item_without_an_id_counts_when_nothing_was_reached(make):
    placed = make("sales_order", [order(1), order(2)])
    items = make("sales_order_item", [item(None), item(2, order=2)])
    found = campaigns.non_campaign_return_rate(items, placed, *web(make), DAY, DAY)
    assert rows(found) == [("A", 2, 2, 0.0)]


def abandoned_tables(make, items, orders, web_orders, product=None):
    catalogue = product or [
        {"sku": "A-0", "type_id": "simple", "entity_id": 1, "parent_id": 9, "dg_end_date": OPEN},
        {"sku": "A", "type_id": "configurable", "entity_id": 9, "dg_end_date": OPEN},
    ]
    late = item(99, created_at=NEWEST, order=0)
    return [
        make("sales_order_item", [*items, late]),
        make("sales_order", orders),
        make("product", catalogue),
        make("web_orders", web_orders),
        make("web_visitors", [{"sid": s} for s in (1, 1, 2, 3)]),
        make("web_campaigns", [{"sid": 1, "campaign": "c1"}, {"sid": 2, "campaign": "c2"}, {"sid": 4, "campaign": "c1"}]),
        make("web_confdata", CODES),
    ]


def test_abandoned_totals_count_first_items_of_orders_and_customers(make):
    customer = {"mage_customer_entity_id": 5}
    tables = abandoned_tables(
        make,
        [item(1, order=1), item(2, "item_returned", order=1), item(3, order=2), item(4, order=3), item(5, order=4)],
        [order(n, **customer) for n in (1, 2, 3, 4)],
        # order 1 by a matching session, order 2 by another one, order 3 by both, order 4 by an unknown visitor
        [{"order_id": f"N{o}", "sid": s} for o, s in ((1, 1), (2, 2), (3, 1), (3, 2), (4, 4))],
    )
    found = campaigns.abandoned_campaign_totals(*tables, as_of=NEWEST).first().asDict()
    assert [found[f"orders{s}"] for s in ("_bef_cancel", "_bef_return", "")] == [2, 2, 2]
    assert [found[f"sold_items{s}"] for s in ("_bef_cancel", "_bef_return", "")] == [3, 3, 2]
    assert [found[f"customers{s}"] for s in ("_bef_cancel", "_bef_return", "")] == [1, 1, 1]
    assert [found[f"rev{s}"] for s in ("_bef_cancel", "_bef_return", "")] == [Decimal(6), Decimal(6), Decimal(4)]
    assert (found["return_rate_item_based"], found["return_rate_rev_based"]) == (0.333, 0.333)


def test_a_customer_who_came_first_without_the_campaign_is_not_counted(make):
    customer = {"mage_customer_entity_id": 5}
    tables = abandoned_tables(
        make,
        [item(1, order=1), item(2, order=2)],
        [order(1, **customer), order(2, **customer)],
        [{"order_id": "N1", "sid": 2}, {"order_id": "N2", "sid": 1}],
    )
    found = campaigns.abandoned_campaign_totals(*tables, as_of=NEWEST).first()
    assert (found.orders, found.sold_items, found.customers) == (1, 1, 0)


def test_abandoned_totals_without_items(make):
    tables = abandoned_tables(make, [], [order(1)], [])
    assert set(campaigns.abandoned_campaign_totals(*tables, as_of=NEWEST).first()) == {None}
    assert rows(campaigns.abandoned_totals_by_config(*tables, as_of=NEWEST)) == []


def test_closed_rows_are_left_out(make):
    tables = abandoned_tables(
        make, [item(1, dg_end_date=CLOSED), item(2)], [order(1)], [{"order_id": "N1", "sid": 1}]
    )
    assert campaigns.abandoned_campaign_totals(*tables, as_of=NEWEST).first().sold_items == 1


AS_OF = datetime(2001, 8, 2, 9)
SEEN = Observation(as_of=AS_OF)


def simple(sku, activated=None, created=AS_OF, **other):
    base = {
        "sku": sku,
        "type_id": "simple",
        "status": 1,
        "inventory_type": "Own Warehouse",
        "activated_at": activated,
        "created_at": created,
        "dg_end_date": OPEN,
    }
    return base | other


def ago(**gap):
    return AS_OF - timedelta(**gap)


def test_days_active(make):
    product = make(
        "product",
        [
            simple("old", ago(days=40)),
            simple("young", ago(days=2, hours=12)),
            simple("guess", None, ago(days=7)),
            simple("guess over", None, ago(days=7, hours=12)),
            simple("hidden", ago(days=3), status=0),
            simple("foreign", ago(days=3), inventory_type="Marketplace"),
            simple("unknown", ago(days=3), inventory_type=None),
            simple("closed", ago(days=3), dg_end_date=CLOSED),
            simple("config", ago(days=3), type_id="configurable"),
        ],
    )
    found = replenishment.days_active(product, SEEN)
    assert rows(found, "sku", "days_active_in_obs_period") == [("guess", 21), ("guess over", 10), ("old", 10), ("young", 3)]


def stock_row(sku, quantity, **gap):
    return {"sku": sku, "quantity": quantity, "stock_date": ago(**gap), "dg_end_date": OPEN}


def test_replenishment_report(make):
    product = make(
        "product",
        [simple(s, ago(days=40)) for s in ("sold", "idle", "none", "twice")] + [simple("fresh", ago(days=1))],
    )
    stock = make(
        "stock",
        [stock_row("sold", 6, days=1), stock_row("sold", 0, days=2), stock_row("sold", 0, days=3)]
        + [stock_row("idle", 3, days=1), stock_row("none", 0, days=1)]
        + [stock_row("twice", 1, days=1), stock_row("twice", 2, days=1, hours=1)]
        + [stock_row("fresh", 0, days=4)],
    )
    items = make(
        "sales_order_item",
        [item(n, sku="sold", created_at=ago(days=10, hours=11)) for n in range(2)]
        + [item(3, sku="sold", created_at=ago(days=10, hours=12)), item(4, "item_canceled", sku="sold", created_at=AS_OF)]
        + [item(5, sku="fresh", created_at=AS_OF), item(6, sku="none", created_at=AS_OF)],
    )
    assert rows(replenishment_report(product, stock, items, SEEN)) == [
        ("fresh", None, None, 1, 0, None, None),
        ("idle", 0.0, 3, 0, 10, 999.0, 0.0),
        ("none", 0.11, 0, 1, 9, 0.0, None),
        ("sold", 0.25, 6, 2, 8, 24.0, 0.333),
        ("twice", 0.0, 1, 0, 10, 999.0, 0.0),
        ("twice", 0.0, 2, 0, 10, 999.0, 0.0),
    ]


def test_venture_report_takes_unknown_inventory_and_history(make):
    product = make("product", [simple("a", ago(days=40), inventory_type=None, dg_end_date=CLOSED)])
    items = make("sales_order_item", [item(1, sku="a", created_at=AS_OF, dg_end_date=CLOSED)])
    stock = make("stock", [stock_row("a", 4, days=1)])
    assert rows(replenishment_report(product, stock, items, SEEN)) == []
    assert rows(replenishment_report_v2(product, stock, items, SEEN)) == [("a", 0.1, 4, 1, 10, 40.0, 0.25)]


def star_tables(make, facts, products, dates=range(0, 101)):
    first = date(2000, 1, 1)
    return [
        make("fct_sales", facts),
        make("dim_dates", [{"date_id": d, "iso_date": f"{first + timedelta(days=d):%Y.%m.%d}"} for d in dates]),
        make("dim_articles", [{"article_id": n, "product_id": n} for n in (1, 2, 3)]),
        make("dim_products", products),
    ]


def fact(day, article, before, after):
    return {"date_id": day, "article_id": article, "sold_articles_bef_return": before, "sold_articles": after}


def dim(number, sku, group, text, start=date(1990, 1, 1), end=date(9999, 12, 31)):
    return {
        "product_id": number,
        "sku": sku,
        "targetgroup": group,
        "description": text,
        "valid_from": start,
        "valid_to": end,
    }


PRODUCTS = [dim(1, "p", "t1", "d1"), dim(2, "q", "t1", "d2"), dim(3, "r", "t2", "d2")]


def test_star_period_includes_its_first_day_only(make):
    facts = [fact(100, 1, 0, 0)] + [fact(d, 1, 1, 1) for d in (21, 22, 69, 70, 71)]
    assert rows(star.star_sku_sales(*star_tables(make, facts, PRODUCTS))) == [("p", 2, 2)]


def test_star_forecast_levels(make):
    facts = [fact(100, 1, 0, 0), fact(50, 1, 8, 6), fact(50, 2, 2, 1), fact(50, 3, 4, 1)]
    found = forecasts.star_return_forecast(*star_tables(make, facts, PRODUCTS))
    # p by itself, q by t1 = 3 of 10, r (4 sold, t2 as few) by d2 = 4 of 6
    assert rows(found) == [("p", "t1", "d1", 0.25), ("q", "t1", "d2", 0.3), ("r", "t2", "d2", 0.67)]


def test_star_attributes_are_those_valid_at_the_end_of_the_period(make):
    end = date(2000, 1, 1) + timedelta(days=70)
    products = [
        dim(1, "p", "old", "d", end=end - timedelta(days=1)),
        dim(1, "p", "new", "d", start=end, end=end),
        dim(1, "p", "next", "d", start=end + timedelta(days=1)),
    ]
    facts = [fact(100, 1, 0, 0), fact(50, 1, 1, 1)]
    assert rows(star.star_sku_attributes(*star_tables(make, facts, products))) == [("p", "new", "d", 3, 3)]
    without = [d for d in range(101) if d != 70]
    assert rows(star.star_sku_attributes(*star_tables(make, facts, products, without))) == []


def test_missing_targetgroup_never_matches(make):
    facts = [fact(100, 1, 0, 0), fact(50, 1, 9, 9)]
    tables = star_tables(make, facts, [dim(1, "p", None, "d")])
    assert rows(star.star_targetgroup_rates(*tables)) == [(None, 9, 9, 0.0)]
    assert rows(forecasts.star_return_forecast(*tables)) == []


def catalogue(*simples, configs=("A", "B")):
    parents = {c: 100 + n for n, c in enumerate(configs)}
    rows_ = [{"sku": c, "type_id": "configurable", "entity_id": n, "brand": "cfg"} for c, n in parents.items()]
    return rows_ + [
        {"sku": s, "type_id": "simple", "entity_id": n, "parent_id": parents[s.split("-")[0]], "brand": b}
        for n, (s, b) in enumerate(simples)
    ]


PERIOD = Lookback(150, 30, NEWEST)


def test_duplicate_catalogue_rows_do_not_inflate_the_config_level(make):
    product = make("product", catalogue(("A-0", "x"), ("A-0", "x")))
    items = make("sales_order_item", [item(1), item(2, "item_returned")])
    found = forecast.config_level_rates(items, product, "v", PERIOD)
    assert rows(found) == [("v", "A", "x", 2, 0, 1, 0.5)]
    # ... but they do multiply the returns of the total
    assert rows(forecast.total_level_rates(items, product, "v", PERIOD)) == [("v", 2, 1.0, 0.0)]


def test_a_config_of_two_brands_shares_its_cancels_and_returns(make):
    product = make("product", catalogue(("A-0", "x"), ("A-1", None)))
    items = make(
        "sales_order_item",
        [item(1), item(2, "item_canceled"), item(3, sku="A-1"), item(4, "item_rejected", sku="A-1")],
    )
    found = forecast.config_level_rates(items, product, "v", PERIOD)
    assert rows(found) == [("v", "A", "unspecified", 2, 1, 1, 1.0), ("v", "A", "x", 2, 1, 1, 1.0)]


def test_everything_canceled(make):
    product = make("product", catalogue(("A-0", "x")))
    items = make("sales_order_item", [item(1, "item_canceled")])
    assert rows(forecast.config_level_rates(items, product, "v", PERIOD))[0][-1] == 0.0
    assert rows(forecast.brand_level_rates(items, product, "v", PERIOD)) == [("v", "x", 1, 0.0)]
    assert rows(forecast.total_level_rates(items, product, "v", PERIOD)) == [("v", 1, None, 1.0)]


def test_items_outside_the_catalogue_count_in_the_total_only(make):
    product = make("product", catalogue(("A-0", "x")))
    items = make("sales_order_item", [item(1), item(2, "item_returned", sku="Z"), item(3, sku=None)])
    assert rows(forecast.total_level_rates(items, product, "v", PERIOD)) == [("v", 3, 0.0, 0.0)]
    assert rows(forecast.brand_level_rates(items, product, "v", PERIOD)) == [("v", "x", 1, 0.0)]


def test_forecast_levels(make):
    product = make("product", catalogue(("A-0", "x"), ("B-0", "x"), ("B-1", None)))
    items = make(
        "sales_order_item",
        [item(n, "item_returned" if n < 6 else "item_delivered") for n in range(30)]
        + [item(100, sku="B-0"), item(101, "item_returned", sku="B-1"), item(102, "item_canceled", sku="B-1")],
    )
    found = forecasts.return_cancel_forecast(items, product, "v", PERIOD)
    # A by itself 6/30, B of x by brand 6/31, B of no brand by total 7/32; cancels 1/33
    assert rows(found) == [
        ("A", "x", "v", 30, 0.2, 0.03),
        ("B", "unspecified", "v", 2, 0.22, 0.03),
        ("B", "x", "v", 1, 0.19, 0.03),
    ]


def test_nothing_sold_gives_no_forecast(make):
    product = make("product", catalogue(("A-0", "x")))
    items = make("sales_order_item", [item(1, "item_invalid")])
    assert rows(forecast.total_level_rates(items, product, "v", PERIOD)) == []
    assert rows(forecasts.return_cancel_forecast(items, product, "v", PERIOD)) == []


def test_every_forecast_is_the_rate_of_one_level(spark):
    from returnlens.sources.sample import SampleTables

    sample = SampleTables(spark, "/root/testdata/sf0.01")
    items, product = sample.table("sales_order_item"), sample.table("product")
    found = forecasts.return_cancel_forecast(items, product, "shop", minimum=8)
    config = forecast.config_level_rates(items, product, "shop").select("config_sku", "brand", "return_rate_config_lvl")
    brand = forecast.brand_level_rates(items, product, "shop").select("brand", "return_rate_brand_lvl")
    total = forecast.total_level_rates(items, product, "shop").first().return_rate_total_lvl
    levels = found.join(config, ["config_sku", "brand"]).join(brand, "brand")
    chosen = F.col("return_rate_forecast")
    outside = levels.filter(
        (chosen != F.col("return_rate_config_lvl")) & (chosen != F.col("return_rate_brand_lvl")) & (chosen != total)
    )
    assert outside.count() == 0
    assert found.filter(F.col("sold_items_bfr_cancel_config") >= 8).count() > 0
