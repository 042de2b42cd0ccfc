"""The input tables derived from the shared TPC-H-like test data (see FIXTURES.md).

Every table is a projection of whole test tables, with rows added by ``explode`` where history,
duplicates or several sessions are wanted. Nothing is sampled or ranked, so the derivation
scales and stays balanced with the data.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returnlens.sources.ventures import declared

VENTURE = "shop"
AS_OF = datetime(2001, 8, 2, 9)
MONTH = (datetime(2000, 8, 1), datetime(2000, 8, 31))

OPEN_END = "timestamp_ntz '9999-12-31 00:00:00'"
CLOSED_END = "timestamp_ntz '1999-01-01 00:00:00'"

ORDER_TIME = "o_orderdate + make_dt_interval(0, cast(o_orderkey % 24 as int))"
ITEM_ID = (
    "l_orderkey * 10000000 + (l_linenumber * 1000003 + l_partkey * 7919 + l_suppkey * 104729 "
    "+ cast(l_quantity as bigint)) % 10000000"
)
ITEM_STATE = """
    case when l_linenumber = 7 and l_returnflag = 'A' then 'item_invalid'
         when l_returnflag = 'N' and l_linenumber in (1, 2) then 'item_canceled'
         when l_returnflag = 'R' and l_linestatus = 'F' and l_linenumber <= 4 then 'item_returned'
         when l_returnflag = 'R' and l_linenumber = 5 then 'item_exchanged'
         when l_returnflag = 'R' and l_linenumber = 6 then 'item_rejected'
         else 'item_delivered' end"""


# Columns used of the shared test tables. Stating them spares a schema lookup per read.
RAW = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_returnflag string, l_linestatus string"
    ),
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
    "events": "event_id bigint, event_type string",
}


def simple_sku(key: str) -> str:
    return f"concat('C', {key} - {key} % 4, '-', {key} % 4)"


@dataclass(frozen=True)
class SampleTables:
    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return declared(getattr(self, f"_{name}")(), name)

    def _raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(RAW[name]).parquet(f"{self.folder}/{name}.parquet")

    def _sales_order(self) -> DataFrame:
        return self._raw("orders").selectExpr(
            "o_orderkey as id_sales_order",
            "concat('N', o_orderkey) as order_nr",
            "o_custkey as mage_customer_entity_id",
            f"{ORDER_TIME} as created_at",
            f"case when o_orderkey % 50 = 0 then {CLOSED_END} else {OPEN_END} end as dg_end_date",
        )

    def _order_list(self) -> DataFrame:
        urgent = self._raw("orders").filter("o_orderpriority = '1-URGENT'")
        return urgent.selectExpr("concat('N', o_orderkey) as order_nr")

    def _sales_order_item(self) -> DataFrame:
        orders = self._raw("orders").selectExpr("o_orderkey", f"{ORDER_TIME} as created_at")
        part = self._raw("part").select("p_partkey", F.col("p_name").alias("name"))
        items = self._raw("lineitem").selectExpr(
            "*", "explode(case when l_orderkey % 50 = 1 then array(0, 1) else array(0) end) as history"
        )
        items = items.selectExpr(
            f"{ITEM_ID} as id_sales_order_item",
            "l_orderkey as fk_sales_order",
            "l_partkey",
            f"{simple_sku('l_partkey')} as sku",
            "cast(l_extendedprice as decimal(12,2)) as paid_price",
            f"case when history = 1 then 'item_delivered' else {ITEM_STATE} end as dwh_shipment_state",
            f"case when history = 1 then {CLOSED_END} else {OPEN_END} end as dg_end_date",
        )
        return items.join(orders, items.fk_sales_order == orders.o_orderkey).join(
            part, items.l_partkey == part.p_partkey
        )

    def _product(self) -> DataFrame:
        created = "timestamp_ntz '2001-07-28 00:00:00'"
        first = f"""named_struct(
            'status', case when p_partkey % 10 = 0 then 0 else 1 end,
            'inventory_type', case when p_size % 7 = 0 then null when p_size % 5 = 0 then 'Marketplace'
                                   else 'Own Warehouse' end,
            'created_at', {created} - make_dt_interval(0, p_size * 12),
            'activated_at', case when p_partkey % 6 = 0 then null
                                 else timestamp_ntz '2001-08-01 06:00:00' - make_dt_interval(0, p_size * 10) end,
            'dg_end_date', {OPEN_END})"""
        copy = f"""named_struct(
            'status', 0, 'inventory_type', 'Own Warehouse', 'created_at', {created},
            'activated_at', cast(null as timestamp_ntz),
            'dg_end_date', case when p_partkey % 2 = 1 then {CLOSED_END} else {OPEN_END} end)"""
        part = self._raw("part")
        simple = part.selectExpr(
            f"{simple_sku('p_partkey')} as sku",
            "'simple' as type_id",
            "p_partkey as entity_id",
            "1000000000 + p_partkey - p_partkey % 4 as parent_id",
            "case when p_partkey % 97 = 0 then null when p_partkey % 500 = 1 then 'Brand#RARE' else p_brand end"
            " as brand",
            f"inline(case when p_partkey % 53 = 0 then array({first}, {copy}) else array({first}) end)",
        )
        config = (
            part.groupBy(F.expr("p_partkey - p_partkey % 4").alias("config"))
            .agg(F.min_by("p_brand", "p_partkey").alias("brand"))
            .selectExpr(
                "concat('C', config) as sku",
                "'configurable' as type_id",
                "1000000000 + config as entity_id",
                "cast(null as bigint) as parent_id",
                "brand",
                "1 as status",
                "'Own Warehouse' as inventory_type",
                f"{created} as created_at",
                "cast(null as timestamp_ntz) as activated_at",
                f"{OPEN_END} as dg_end_date",
            )
        )
        return simple.unionByName(config)

    def _stock(self) -> DataFrame:
        month = "sequence(timestamp_ntz '2001-07-02 00:00:00', timestamp_ntz '2001-08-01 00:00:00', interval 1 day)"
        daily = self._raw("part").selectExpr(
            "p_partkey", f"{simple_sku('p_partkey')} as sku", f"explode({month}) as stock_date"
        )
        return daily.selectExpr(
            "sku",
            "stock_date",
            "(p_partkey * 7 + day(stock_date) * 3) % 11 as quantity",
            f"{OPEN_END} as dg_end_date",
        )

    def _web_orders(self) -> DataFrame:
        return self._raw("orders").selectExpr(
            "concat('N', o_orderkey) as order_id", "explode(array(o_orderkey, o_orderkey * 2)) as sid"
        )

    def _web_visitors(self) -> DataFrame:
        return self._raw("events").selectExpr("event_id as sid")

    def _web_campaigns(self) -> DataFrame:
        own = "concat('src_', event_type)"
        return self._raw("events").selectExpr(
            "event_id as sid",
            f"explode(case when event_id % 4 = 0 then array({own}, 'src_error2') else array({own}) end) as campaign",
        )

    def _web_confdata(self) -> DataFrame:
        columns = ("datasourcevalue", "campaign", "category_4th_level")

        def row(*values: str) -> str:
            return "named_struct(" + ", ".join(f"'{c}', {v}" for c, v in zip(columns, values)) + ")"

        mail = row("'src_error'", "'CRM_Abandoned_Cart'", "'Mail abandoned basket'")
        second = row("'src_error2'", "'crm_abandoned_cart_2'", "'mail ABANDONED basket 2'")
        other = row("concat('src_', event_type)", "concat('CRM_', event_type)", "'Other'")
        types = self._raw("events").select("event_type").distinct()
        return types.selectExpr(
            f"inline(case when event_type = 'error' then array({mail}, {second}) else array({other}) end)"
        )

    def _dim_dates(self) -> DataFrame:
        ends = self._raw("orders").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
        calendar = ends.selectExpr("explode(sequence(cast(first as date), cast(last as date))) as day")
        return calendar.selectExpr(
            "datediff(day, date '1990-01-01') as date_id", "date_format(day, 'yyyy.MM.dd') as iso_date"
        )

    def _dim_articles(self) -> DataFrame:
        return self._raw("part").selectExpr("explode(array(p_partkey * 2, p_partkey * 2 + 1)) as article_id").selectExpr(
            "article_id", "article_id as product_id"
        )

    def _dim_products(self) -> DataFrame:
        old = """named_struct('product_id', p_partkey * 2, 'targetgroup', p_brand,
            'valid_from', date '1990-01-01', 'valid_to', date '1999-12-31')"""
        new = """named_struct('product_id', p_partkey * 2 + 1,
            'targetgroup', case when p_partkey % 500 = 1 then 'Brand#RARE' else p_brand end,
            'valid_from', date '2000-01-01', 'valid_to', date '9999-12-31')"""
        return self._raw("part").selectExpr(
            f"{simple_sku('p_partkey')} as sku", "p_type as description", f"inline(array({old}, {new}))"
        )

    def _fct_sales(self) -> DataFrame:
        orders = self._raw("orders").select("o_orderkey", "o_orderdate")
        lines = self._raw("lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
        return lines.join(orders, lines.l_orderkey == orders.o_orderkey).selectExpr(
            "datediff(o_orderdate, date '1990-01-01') as date_id",
            "l_partkey * 2 + case when o_orderdate >= timestamp_ntz '2000-01-01 00:00:00' then 1 else 0 end"
            " as article_id",
            "1 as sold_articles_bef_return",
            "case when l_returnflag = 'R' then 0 else 1 end as sold_articles",
        )
