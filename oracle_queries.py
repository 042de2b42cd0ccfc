"""DuckDB statements that give the same rows as the registered Spark queries.

The input tables are common table expressions over the test data (FIXTURES.md). The queries are
written the direct way: items are deduplicated by grouping and joined row by row, where the Spark
side carries multiplicities, ranges and minima instead.
"""

from __future__ import annotations

AS_OF = "timestamp '2001-08-02 09:00:00'"
OPEN_END = "timestamp '9999-12-31 00:00:00'"
CLOSED_END = "timestamp '1999-01-01 00:00:00'"
CREATED = "timestamp '2001-07-28 00:00:00'"


def simple_sku(key: str) -> str:
    return f"concat('C', {key} - {key} % 4, '-', {key} % 4)"


ITEM_ID = (
    "l_orderkey * 10000000 + (l_linenumber * 1000003 + l_partkey * 7919 + l_suppkey * 104729 "
    "+ cast(l_quantity as bigint)) % 10000000"
)

TABLES = {
    "sales_order": f"""
        select o_orderkey as id_sales_order, concat('N', o_orderkey) as order_nr,
               o_custkey as mage_customer_entity_id,
               o_orderdate + (o_orderkey % 24) * interval '1' hour as created_at,
               case when o_orderkey % 50 = 0 then {CLOSED_END} else {OPEN_END} end as dg_end_date
        from orders""",
    "order_list": "select concat('N', o_orderkey) as order_nr from orders where o_orderpriority = '1-URGENT'",
    "base_item": f"""
        select {ITEM_ID} as id_sales_order_item, l_orderkey as fk_sales_order,
               {simple_sku('l_partkey')} as sku, p_name as name,
               cast(l_extendedprice as decimal(12,2)) as paid_price,
               case when l_linenumber = 7 and l_returnflag = 'A' then 'item_invalid'
                    when l_returnflag = 'N' and l_linenumber in (1, 2) then 'item_canceled'
                    when l_returnflag = 'R' and l_linestatus = 'F' and l_linenumber <= 4 then 'item_returned'
                    when l_returnflag = 'R' and l_linenumber = 5 then 'item_exchanged'
                    when l_returnflag = 'R' and l_linenumber = 6 then 'item_rejected'
                    else 'item_delivered' end as dwh_shipment_state,
               o_orderdate + (o_orderkey % 24) * interval '1' hour as created_at,
               {OPEN_END} as dg_end_date
        from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey""",
    "sales_order_item": f"""
        select * from base_item
        union all
        select * replace ('item_delivered' as dwh_shipment_state, {CLOSED_END} as dg_end_date)
        from base_item where fk_sales_order % 50 = 1""",
    "product": f"""
        select {simple_sku('p_partkey')} as sku, 'simple' as type_id, p_partkey as entity_id,
               1000000000 + p_partkey - p_partkey % 4 as parent_id,
               case when p_partkey % 97 = 0 then null when p_partkey % 500 = 1 then 'Brand#RARE'
                    else p_brand end as brand,
               case when copy = 1 or p_partkey % 10 = 0 then 0 else 1 end as status,
               case when copy = 1 then 'Own Warehouse' when p_size % 7 = 0 then null
                    when p_size % 5 = 0 then 'Marketplace' else 'Own Warehouse' end as inventory_type,
               case when copy = 1 then {CREATED} else {CREATED} - p_size * interval '12' hour end as created_at,
               case when copy = 1 or p_partkey % 6 = 0 then null
                    else timestamp '2001-08-01 06:00:00' - p_size * interval '10' hour end as activated_at,
               case when copy = 1 and p_partkey % 2 = 1 then {CLOSED_END} else {OPEN_END} end as dg_end_date
        from part join (values (0), (1)) as copies(copy) on copy = 0 or p_partkey % 53 = 0
        union all
        select concat('C', config), 'configurable', 1000000000 + config, null, brand, 1, 'Own Warehouse',
               {CREATED}, null, {OPEN_END}
        from (select p_partkey - p_partkey % 4 as config, arg_min(p_brand, p_partkey) as brand
              from part group by 1)""",
    "stock": f"""
        select {simple_sku('p_partkey')} as sku, stock_date,
               (p_partkey * 7 + day(stock_date) * 3) % 11 as quantity, {OPEN_END} as dg_end_date
        from part, unnest(generate_series(timestamp '2001-07-02', timestamp '2001-08-01',
                                          interval '1' day)) as days(stock_date)""",
    "web_orders": """
        select concat('N', o_orderkey) as order_id, o_orderkey as sid from orders
        union all select concat('N', o_orderkey), o_orderkey * 2 from orders""",
    "web_visitors": "select event_id as sid from events",
    "web_campaigns": """
        select event_id as sid, concat('src_', event_type) as campaign from events
        union all select event_id, 'src_error2' from events where event_id % 4 = 0""",
    "web_confdata": """
        select distinct concat('src_', event_type) as datasourcevalue,
               case when event_type = 'error' then 'CRM_Abandoned_Cart'
                    else concat('CRM_', event_type) end as campaign,
               case when event_type = 'error' then 'Mail abandoned basket' else 'Other' end as category_4th_level
        from events
        union all
        select distinct 'src_error2', 'crm_abandoned_cart_2', 'mail ABANDONED basket 2'
        from events where event_type = 'error'""",
    "dim_dates": """
        select datediff('day', date '1990-01-01', cast(day as date)) as date_id,
               strftime(day, '%Y.%m.%d') as iso_date
        from (select unnest(generate_series(min(o_orderdate), max(o_orderdate), interval '1' day)) as day
              from orders)""",
    "dim_articles": """
        select p_partkey * 2 as article_id, p_partkey * 2 as product_id from part
        union all select p_partkey * 2 + 1, p_partkey * 2 + 1 from part""",
    "dim_products": f"""
        select p_partkey * 2 as product_id, {simple_sku('p_partkey')} as sku, p_brand as targetgroup,
               p_type as description, date '1990-01-01' as valid_from, date '1999-12-31' as valid_to
        from part
        union all
        select p_partkey * 2 + 1, {simple_sku('p_partkey')},
               case when p_partkey % 500 = 1 then 'Brand#RARE' else p_brand end, p_type,
               date '2000-01-01', date '9999-12-31'
        from part""",
    "fct_sales": """
        select datediff('day', date '1990-01-01', cast(o_orderdate as date)) as date_id,
               l_partkey * 2 + case when o_orderdate >= timestamp '2000-01-01' then 1 else 0 end as article_id,
               1 as sold_articles_bef_return,
               case when l_returnflag = 'R' then 0 else 1 end as sold_articles
        from lineitem join orders on l_orderkey = o_orderkey""",
}

NEEDS = {"sales_order_item": ("base_item",)}

BEFORE_REJ = "('item_invalid', 'item_canceled', 'item_rejected')"
AFTER_OLD = "('item_invalid', 'item_canceled', 'item_returned', 'item_exchanged')"
GROSS = "('item_invalid')"
NET = "('item_invalid', 'item_canceled')"
AFTER = "('item_invalid', 'item_canceled', 'item_returned', 'item_rejected', 'item_exchanged')"
AFTER_EXCH = "('item_invalid', 'item_canceled', 'item_exchanged')"
SENT_BACK = "('item_returned', 'item_exchanged', 'item_rejected')"

PREFIX = "case when instr(sku, '-') > 1 then substr(sku, 1, instr(sku, '-') - 1) end"


def with_tables(tables: str, body: str, *steps: tuple[str, str]) -> str:
    names: list[str] = []
    for name in tables.split():
        names += [n for n in (*NEEDS.get(name, ()), name) if n not in names]
    parts = [(n, TABLES[n]) for n in names] + list(steps)
    return "with " + ",\n".join(f"{n} as ({text})" for n, text in parts) + "\n" + body


def num(text: str) -> str:
    return f"cast({text} as double)"


def rounded(part: str, whole: str, digits: int) -> str:
    """part / whole, halves away from zero, in whole numbers; NULL when whole is 0."""
    scale = 10**digits
    exact = f"(2 * {scale} * abs(cast({part} as hugeint)) + abs(cast({whole} as hugeint)))"
    steps = f"{exact} // (2 * abs(cast(nullif({whole}, 0) as hugeint)))"
    return f"(sign({part}) * sign({whole}) * ({steps}) / cast({scale} as double))"


def difference(before: str, after: str, digits: int | None = None) -> str:
    if digits is None:
        share = f"{num(f'{before} - {after}')} / {num(f'nullif({before}, 0)')}"
    else:
        share = rounded(f"({before} - {after})", before, digits)
    return f"case when {before} = 0 then 0.0::double else {share} end"


def big(expr: str, name: str) -> str:
    return f"cast({expr} as bigint) as {name}"


# One row per distinct item, 1 where at least one of its rows is outside the set.
def unit_step(counts: dict[str, str], key: str = "", source: str = "sales_order_item") -> tuple[str, str]:
    flags = ", ".join(f"max(case when dwh_shipment_state not in {s} then 1 else 0 end) as {n}" for n, s in counts.items())
    any_flag = " or ".join(f"dwh_shipment_state not in {s}" for s in counts.values())
    return (
        "units",
        f"""select id_sales_order_item, sku, fk_sales_order, name, {PREFIX} as productsku{key}, {flags}
            from {source} where {any_flag} group by all""",
    )


def in_period(start: int = 78, end: int = 30) -> tuple[str, str]:
    return (
        "placed",
        f"""select id_sales_order from sales_order, (select max(created_at) as newest from sales_order)
            where created_at > newest - interval '{start}' day and created_at < newest - interval '{end}' day""",
    )


ORDERED = "units join placed on fk_sales_order = id_sales_order"


def return_rate(key: str, source: str = ORDERED, tables: str = "sales_order sales_order_item") -> str:
    body = f"""
        select {key}, {big('sum(sbr)', 'sold_articles_bef_return')}, {big('sum(sar)', 'sold_articles')},
               {difference('sum(sbr)', 'sum(sar)')} as return_rate_description
        from {source} group by {key}"""
    return with_tables(tables, body, unit_step({"sbr": BEFORE_REJ, "sar": AFTER_OLD}), in_period())


FOUR = {"sbr": BEFORE_REJ, "sar": AFTER, "sbc": GROSS, "sac": AFTER_EXCH}
BRANDED = f"{ORDERED} left join (select sku as catalog_sku, brand from product) on catalog_sku = productsku"


def four_counts(keys: str, plural: str, singular: str, digits: int | None = None) -> str:
    return f"""
        select {keys}, {big('sum(sbr)', f'sold_{plural}_bef_return')}, {big('sum(sar)', f'sold_{plural}_aft_return')},
               {difference('sum(sbr)', 'sum(sar)', digits)} as return_rate_{singular},
               {big('sum(sbc)', f'sold_{plural}_bef_cancellation')},
               {big('sum(sac)', f'sold_{plural}_aft_cancellation')},
               {difference('sum(sbc)', 'sum(sac)', digits)} as cancellation_rate_{singular}
        from {BRANDED} group by {keys}"""


def brand_rates(minimum: int, start: int = 78) -> str:
    body = four_counts("brand", "brands", "brand", 2) + f" having sum(sbr) >= {minimum}"
    return with_tables("sales_order sales_order_item product", body, unit_step(FOUR), in_period(start))


def config_brand_forecast() -> str:
    counts = (
        "counts",
        f"select productsku, brand, sum(sbr) as own_b, sum(sar) as own_a from {BRANDED} group by productsku, brand",
    )
    brands = ("brands", f"select brand as b, sum(sbr) as all_b, sum(sar) as all_a from {BRANDED} group by brand")
    body = f"""
        select productsku as sku, brand,
               case when own_b >= 8 then {difference('own_b', 'own_a', 2)}
                    when own_b < 8 and all_b >= 8 then {difference('all_b', 'all_a', 2)}
                    else 1.0::double end as return_rate_forecast,
               1.0::double as cancellation_rate_forecast
        from counts left join brands on brand = b"""
    return with_tables(
        "sales_order sales_order_item product", body, unit_step(FOUR), in_period(), counts, brands
    )


def product_rate(key: str, source: str) -> str:
    return f"""
        select {key} as productsku, {big('sum(sbr)', 'sold_products_bef_return')},
               {big('sum(sar)', 'sold_products_aft_return')},
               {difference('sum(sbr)', 'sum(sar)')} as return_rate_product
        from {source} group by {key}"""


ORDER_ITEMS = (
    "order_items",
    """select i.*, o.order_nr, o.created_at as ordered_at
       from sales_order_item i join sales_order o on i.fk_sales_order = o.id_sales_order""",
)
REACHED = (
    "reached",
    """select id_sales_order_item, dwh_shipment_state from order_items
       join web_orders w on w.order_id = order_nr join web_campaigns c on c.sid = w.sid
       join web_confdata d on d.datasourcevalue = c.campaign
       where upper(category_4th_level) like '%ABANDONED%'
         and ordered_at between timestamp '2000-08-01' and timestamp '2000-08-{last}'""",
)


def non_campaign() -> str:
    flags = {"sbr": NET, "sar": AFTER}
    columns = ", ".join(
        f"""max(case when dwh_shipment_state not in {s} and id_sales_order_item not in
                (select id_sales_order_item from reached where dwh_shipment_state not in {s}) then 1 else 0 end) as {n}"""
        for n, s in flags.items()
    )
    units = (
        "units",
        f"""select id_sales_order_item, order_nr, ordered_at, sku, fk_sales_order, name, {PREFIX} as productsku, {columns}
            from order_items where ordered_at between timestamp '2000-08-01' and timestamp '2000-08-31' group by all""",
    )
    reached = (REACHED[0], REACHED[1].format(last="31"))
    return with_tables(
        "sales_order sales_order_item web_orders web_campaigns web_confdata",
        product_rate("productsku", "units where sbr + sar > 0"),
        ORDER_ITEMS,
        reached,
        units,
    )


def campaign() -> str:
    reached = (
        "reached",
        """select i.* exclude (created_at) from order_items i
           join web_orders w on w.order_id = order_nr join web_campaigns c on c.sid = w.sid
           join web_confdata d on d.datasourcevalue = c.campaign
           where upper(category_4th_level) like '%ABANDONED%'
             and ordered_at between timestamp '2000-08-01' and timestamp '2000-08-30'""",
    )
    return with_tables(
        "sales_order sales_order_item web_orders web_campaigns web_confdata",
        product_rate("sku", "units"),
        ORDER_ITEMS,
        reached,
        unit_step({"sbr": NET, "sar": AFTER}, source="reached"),
    )


def order_list() -> str:
    listed = ("listed", "select * from order_items where order_nr in (select order_nr from order_list)")
    units = unit_step({"sbr": GROSS, "sar": AFTER}, ", order_nr, ordered_at", "listed")
    return with_tables(
        "sales_order sales_order_item order_list", product_rate("productsku", "units"), ORDER_ITEMS, listed, units
    )


def abandoned(by_config: bool) -> str:
    rows = (
        "rows_found",
        f"""select distinct i.id_sales_order_item as id, i.fk_sales_order as fk, i.sku, i.dwh_shipment_state as state,
                   i.paid_price, o.order_nr, o.mage_customer_entity_id as customer,
                   case when upper(d.campaign) like '%ABANDONED%' then 0 else 1 end as unmatched,
                   w.sid, c.campaign as code, s.entity_id as simple_id, k.entity_id as config_id, k.sku as productsku
            from sales_order_item i
            join sales_order o on i.fk_sales_order = o.id_sales_order and o.dg_end_date > {AS_OF}
            join product s on s.sku = i.sku and s.type_id = 'simple' and s.dg_end_date > {AS_OF}
            join product k on k.entity_id = s.parent_id and k.type_id = 'configurable' and k.dg_end_date > {AS_OF}
            join web_orders w on w.order_id = o.order_nr
            join web_visitors v on v.sid = w.sid
            join web_campaigns c on c.sid = v.sid
            join web_confdata d on d.datasourcevalue = c.campaign,
            (select max(created_at) as newest from sales_order_item)
            where i.dg_end_date > {AS_OF} and date_trunc('day', i.created_at) < newest - interval '30' day
              and date_trunc('day', i.created_at) > newest - interval '150' day""",
    )
    # Ties only differ in their path to the campaign and in the catalogue rows: those come last.
    tied = "fk unmatched order_nr customer sku state paid_price sid code simple_id config_id productsku"
    ties = ", ".join(f"{column} nulls first" for column in tied.split())
    ranked = (
        "ranked",
        f"""select *, row_number() over (partition by id order by {ties}) as in_item,
                   row_number() over (partition by order_nr order by id nulls first, {ties}) as in_order,
                   row_number() over (partition by customer order by id nulls first, {ties}) as in_customer
            from rows_found""",
    )
    stages = {"_bef_cancel": GROSS, "_bef_return": NET, "": AFTER}

    def kept(states: str) -> str:
        return f"state not in {states}"

    sums = (
        [big(f"sum(case when in_order = 1 and {kept(s)} then 1 else 0 end)", f"orders{n}") for n, s in stages.items()]
        + [big(f"sum(case when {kept(s)} then 1 else 0 end)", f"sold_items{n}") for n, s in stages.items()]
        + [
            big(f"sum(case when in_customer = 1 and {kept(s)} then 1 else 0 end)", f"customers{n}")
            for n, s in stages.items()
        ]
        + [
            f"cast(sum(case when {kept(s)} then paid_price else 0 end) as decimal(24,2)) as rev{n}"
            for n, s in stages.items()
        ]
    )
    key, group = ("productsku, ", " group by productsku") if by_config else ("", "")
    totals = ("totals", f"select {key}{', '.join(sums)} from ranked where unmatched = 0 and in_item = 1{group}")
    body = f"""
        select *, {difference('sold_items_bef_return', 'sold_items', 3)} as return_rate_item_based,
               {difference('(100 * rev_bef_return)', '(100 * rev)', 3)} as return_rate_rev_based
        from totals{' order by return_rate_item_based desc nulls first, productsku' if by_config else ''}"""
    return with_tables(
        "sales_order sales_order_item product web_orders web_visitors web_campaigns web_confdata",
        body,
        rows,
        ranked,
        totals,
    )


def age(column: str, extra: int = 0) -> str:
    seconds = f"(epoch({AS_OF}) - epoch({column}))"
    return f"round({seconds} / 86400.0 + {extra}, 0)"


def replenishment(part: str, own_tables: bool = False) -> str:
    current = "true" if own_tables else f"dg_end_date > {AS_OF}"
    inventory = "inventory_type = 'Own Warehouse'" + (" or inventory_type is null" if own_tables else "")
    guess = age("created_at", 14)
    active = (
        "active",
        f"""select sku, cast(case when activated_at is not null then least({age('activated_at')}, 10)
                                  when {guess} <= 21 then {guess} else 10 end as bigint) as days_active_in_obs_period,
                   activated_at, created_at
            from product where {current} and status = 1 and type_id = 'simple' and ({inventory})""",
    )
    empty = (
        "empty",
        f"""select sku, count(stock_date) as days_without_stock from stock
            where {current} and quantity = 0 and {age('stock_date')} <= 10 group by sku""",
    )
    visible = (
        "visible",
        """select a.sku, cast(case when days_without_stock is null then 10
                                   else days_active_in_obs_period - days_without_stock end as bigint) as visibility_period
           from active a left join empty e on a.sku = e.sku""",
    )
    sold = (
        "sold",
        f"""select sku, count(id_sales_order_item) as sold_items_before_return from sales_order_item
            where {current} and {age('created_at')} <= 10 and dwh_shipment_state not in {NET} group by sku""",
    )
    on_hand = (
        "on_hand",
        f"""select sku, stock_date, cast(sum(quantity) as bigint) as amount_on_stock from stock
            where {current} and {age('stock_date')} = 1 group by sku, stock_date""",
    )
    report = (
        "report",
        f"""select sku, {rounded('s', 'v', 2)} as sales_rate, amount_on_stock, s as sold_items_before_return,
                   v as visibility_period,
                   case when v = 0 then null when s = 0 then 999.0::double
                        else {rounded('(amount_on_stock * v)', 's', 1)} end as inventory_days,
                   {rounded('s', 'amount_on_stock', 3)} as sell_through_rate_item_based
            from (select v.sku, visibility_period as v, coalesce(sold_items_before_return, 0) as s, amount_on_stock
                  from visible v left join sold on v.sku = sold.sku left join on_hand on v.sku = on_hand.sku)""",
    )
    needed = {
        "active": (active,),
        "empty": (empty,),
        "visible": (active, empty, visible),
        "sold": (sold,),
        "on_hand": (on_hand,),
        "report": (active, empty, visible, sold, on_hand, report),
    }[part]
    return with_tables("sales_order_item product stock", f"select * from {part}", *needed)


def star(part: str, start: int = 78) -> str:
    sold = (
        "sold",
        f"""select sku as product_sku, targetgroup, description, sold_articles_bef_return, sold_articles
            from fct_sales join dim_dates using (date_id) join dim_articles using (article_id)
            join dim_products using (product_id), (select max(date_id) as newest from fct_sales)
            where date_id between newest - {start} and newest - 31""",
    )

    def level(key: str) -> str:
        return f"""select {key}, {big('sum(sold_articles_bef_return)', 'sold_articles_bef_return')},
                          {big('sum(sold_articles)', 'sold_articles')} from sold group by {key}"""

    skus = ("skus", level("product_sku"))
    attributes = (
        "attributes",
        """select product_sku, targetgroup, description, sold_articles_bef_return, sold_articles
           from skus join dim_products on product_sku = sku
           where (select strptime(iso_date, '%Y.%m.%d')::date from dim_dates
                  where date_id = (select max(date_id) - 30 from fct_sales)) between valid_from and valid_to""",
    )

    def rated(key: str) -> tuple[str, str]:
        rate = difference("sold_articles_bef_return", "sold_articles")
        return (f"{key}s", f"select *, {rate} as return_rate_{key} from ({level(key)})")

    forecast = (
        "forecast",
        f"""select a.product_sku, a.targetgroup, a.description,
                   case when a.sold_articles_bef_return >= 8
                          then {difference('a.sold_articles_bef_return', 'a.sold_articles', 2)}
                        when t.sold_articles_bef_return >= 8
                          then {difference('t.sold_articles_bef_return', 't.sold_articles', 2)}
                        else {difference('d.sold_articles_bef_return', 'd.sold_articles', 2)}
                   end as return_rate_forecast
            from attributes a join targetgroups t on a.targetgroup = t.targetgroup
            join descriptions d on a.description = d.description""",
    )
    targetgroups, descriptions = rated("targetgroup"), rated("description")
    steps = {
        "skus": (sold, skus),
        "attributes": (sold, skus, attributes),
        "targetgroups": (sold, targetgroups),
        "descriptions": (sold, descriptions),
        "forecast": (sold, skus, attributes, targetgroups, descriptions, forecast),
    }[part]
    return with_tables("fct_sales dim_dates dim_articles dim_products", f"select * from {part}", *steps)


def forecast(part: str, minimum: int = 30) -> str:
    config_map = (
        "config_map",
        """select distinct s.sku, c.sku as config_sku, s.brand from product s
           join product c on s.parent_id = c.entity_id
           where s.type_id = 'simple' and c.type_id = 'configurable'""",
    )
    sold = (
        "sold",
        """select * from sales_order_item, (select max(created_at) as newest from sales_order_item)
           where date_trunc('day', created_at) < newest - interval '30' day
             and date_trunc('day', created_at) >= newest - interval '150' day
             and dwh_shipment_state not in ('item_invalid')""",
    )
    kept = "count(id_sales_order_item)"
    canceled = "count(id_sales_order_item) filter (where dwh_shipment_state = 'item_canceled')"
    returned = f"count(id_sales_order_item) filter (where dwh_shipment_state in {SENT_BACK})"

    def rate(part_: str, whole: str) -> str:
        return f"case when {whole} = 0 then 0.0::double else {rounded(part_, whole, 2)} end"

    config_sums = (
        "config_sums",
        f"""select config_sku as c, {canceled} as canceled_items, {returned} as returned_items
            from sold join config_map on sold.sku = config_map.sku group by 1""",
    )
    config = (
        "config_level",
        f"""select 'shop' as venture, config_sku, brand, n as sold_items_before_cancellation, canceled_items,
                   returned_items, {rate('returned_items', '(n - canceled_items)')} as return_rate_config_lvl
            from (select config_sku, p.brand, n, coalesce(canceled_items, 0) as canceled_items,
                         coalesce(returned_items, 0) as returned_items
                  from (select config_sku, coalesce(brand, 'unspecified') as brand, {kept} as n
                        from sold join config_map on sold.sku = config_map.sku group by 1, 2) p
                  left join config_sums on config_sku = c)""",
    )
    brand = (
        "brand_level",
        f"""select 'shop' as venture, brand, n as sold_items_before_cancellation,
                   {rate('r', '(n - c)')} as return_rate_brand_lvl
            from (select coalesce(brand, 'unspecified') as brand, {kept} as n, {canceled} as c, {returned} as r
                  from sold join (select distinct sku, brand from product) p on sold.sku = p.sku
                  group by 1)""",
    )
    total = (
        "total_level",
        f"""select 'shop' as venture, n as sold_items_before_cancellation,
                   {rate('r', '(n - c)')} as return_rate_total_lvl, {rate('c', 'n')} as cancel_rate_total_lvl
            from (select 'shop' as v, {kept} as n, {canceled} as c from sold group by v),
                 (select {returned} as r from sold join product on sold.sku = product.sku)""",
    )
    chosen = (
        "chosen",
        f"""select config_sku, c.brand, c.venture, c.sold_items_before_cancellation as sold_items_bfr_cancel_config,
                   case when c.sold_items_before_cancellation >= {minimum} then return_rate_config_lvl
                        when b.sold_items_before_cancellation >= {minimum} then return_rate_brand_lvl
                        else return_rate_total_lvl end as return_rate_forecast,
                   cancel_rate_total_lvl as cancel_rate_forecast
            from config_level c join brand_level b on c.brand = b.brand join total_level t on c.venture = t.venture""",
    )
    steps = {
        "config_map": (config_map,),
        "config_level": (config_map, sold, config_sums, config),
        "brand_level": (sold, brand),
        "total_level": (sold, total),
        "chosen": (config_map, sold, config_sums, config, brand, total, chosen),
    }[part]
    return with_tables("sales_order_item product", f"select * from {part}", *steps)


def all_queries() -> dict[str, str]:
    items = "sales_order_item"
    return {
        "count_sales_before_returns": with_tables(
            items,
            f"""select count(distinct id_sales_order_item) as dc_id_sales_order_item from sales_order_item
                where dwh_shipment_state not in {BEFORE_REJ}""",
        ),
        "sum_sales_before_returns": with_tables(
            items,
            f"""select {big('sum(n)', 'sales_bef_rev')} from (
                  select 1 as n from sales_order_item where dwh_shipment_state not in {BEFORE_REJ}
                  group by id_sales_order_item)""",
        ),
        "count_sales_after_returns": with_tables(
            items,
            f"""select count(distinct id_sales_order_item) as sold_articles from sales_order_item
                where dwh_shipment_state not in {AFTER_OLD}""",
        ),
        "product_order_listing": with_tables(
            "sales_order sales_order_item product",
            """select parent_id, entity_id, sku as product_sku, type_id, item_sku, ordered_at as created_at
               from product left join (
                 select i.sku as item_sku, o.created_at as ordered_at
                 from sales_order_item i left join sales_order o on i.fk_sales_order = o.id_sales_order
               ) on item_sku = sku""",
        ),
        "product_parent_listing": with_tables(
            "product",
            """select c.entity_id, c.parent_id, p.entity_id as parent_entity_id, p.parent_id as parent_parent_id,
                      c.sku, p.sku as parent_sku
               from product c left join product p on c.parent_id = p.entity_id""",
        ),
        "sold_articles_tagged": with_tables(
            "sales_order sales_order_item product",
            f"""select p.sku,
                       count(*) filter (where dwh_shipment_state not in {BEFORE_REJ}) as sold_articles_bef_return,
                       count(*) filter (where dwh_shipment_state not in {AFTER_OLD}) as sold_articles
                from product p join sales_order_item i on i.sku = p.sku
                left join sales_order o on o.id_sales_order = i.fk_sales_order
                where p.parent_id is not null
                  and (dwh_shipment_state not in {BEFORE_REJ} or dwh_shipment_state not in {AFTER_OLD})
                group by p.sku""",
        ),
        "return_rate_by_name": return_rate("name"),
        "return_rate_by_sku": return_rate("sku"),
        "return_rate_by_config_sku": return_rate("productsku"),
        "return_rate_by_brand": return_rate("brand", BRANDED, "sales_order sales_order_item product"),
        "brand_return_cancel_rates": brand_rates(100),
        "brand_return_cancel_rates_min20": brand_rates(20),
        "brand_return_cancel_rates_year": brand_rates(100, 400),
        "config_return_cancel_rates": with_tables(
            "sales_order sales_order_item product",
            four_counts("productsku, brand", "products", "product"),
            unit_step(FOUR),
            in_period(),
        ),
        "brand_rates_unfiltered": with_tables(
            "sales_order sales_order_item product",
            four_counts("brand", "brands", "brand"),
            unit_step(FOUR),
            in_period(),
        ),
        "config_brand_forecast": config_brand_forecast(),
        "abandoned_campaign_totals": abandoned(by_config=False),
        "abandoned_totals_by_config": abandoned(by_config=True),
        "order_list_return_rate": order_list(),
        "non_campaign_return_rate": non_campaign(),
        "campaign_return_rate": campaign(),
        "days_active": replenishment("active"),
        "days_without_stock": replenishment("empty"),
        "visibility_period": replenishment("visible"),
        "sales_in_observation": replenishment("sold"),
        "stock_on_hand": replenishment("on_hand"),
        "replenishment_report": replenishment("report"),
        "replenishment_report_v2": replenishment("report", own_tables=True),
        "star_sku_sales": star("skus"),
        "star_sku_attributes": star("attributes"),
        "star_targetgroup_rates": star("targetgroups"),
        "star_description_rates": star("descriptions"),
        "star_return_forecast": star("forecast"),
        "star_return_forecast_year": star("forecast", 400),
        "catalog_config_map": forecast("config_map"),
        "config_level_rates": forecast("config_level"),
        "brand_level_rates": forecast("brand_level"),
        "total_level_rates": forecast("total_level"),
        "return_cancel_forecast": forecast("chosen"),
        "return_cancel_forecast_min8": forecast("chosen", 8),
        "write_forecast_table": forecast("chosen"),
    }
