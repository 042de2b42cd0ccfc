from __future__ import annotations

from datetime import datetime

import pytest
from collected import rows
from pyspark.errors import AnalysisException

import __spark_entry__ as entry
from returnlens.operators.sales import count_sales_before_returns
from returnlens.session import SETTINGS, configure, shared_dir
from returnlens.sources.sample import SampleTables
from returnlens.sources.schemas import SCHEMAS
from returnlens.sources.sinks import write_forecast_files, write_forecast_table
from returnlens.sources.ventures import Venture

FORECAST = (
    "config_sku string, brand string, venture string, sold_items_bfr_cancel_config bigint, "
    "return_rate_forecast double, cancel_rate_forecast double"
)


def test_venture_folder(spark, make, tmp_path):
    make("product", [{"sku": "A-0", "brand": ""}, {"sku": "", "brand": "x"}]).write.parquet(f"{tmp_path}/shop/product")
    product = Venture(spark, "shop", str(tmp_path)).table("product")
    assert rows(product, "sku", "brand") == [(None, "x"), ("A-0", None)]


def test_venture_schema(spark, make):
    spark.sql("create schema shop_a")
    make("stock", [{"sku": "a", "quantity": 1}]).write.saveAsTable("shop_a.stock")
    assert rows(Venture(spark, "shop_a").table("stock"), "sku", "quantity") == [("a", 1)]


def test_columns_of_other_types_are_cast(spark, tmp_path):
    spark.sql("select 1 as sid, 'c' as campaign, 'unused' as extra").write.parquet(f"{tmp_path}/shop/web_campaigns")
    spark.sql("create schema shop_b")
    spark.read.parquet(f"{tmp_path}/shop/web_campaigns").write.saveAsTable("shop_b.web_campaigns")
    table = Venture(spark, "shop_b").table("web_campaigns")
    assert table.dtypes == [("sid", "bigint"), ("campaign", "string")]


@pytest.mark.parametrize("name", SCHEMAS)
def test_sample_tables_have_the_declared_columns(spark, name):
    table = SampleTables(spark, "/root/testdata/sf0.001").table(name)
    declared = spark.createDataFrame([], SCHEMAS[name])
    assert table.dtypes == declared.dtypes
    assert table.count() > 0


def test_forecast_table_is_never_replaced(spark):
    forecast = spark.createDataFrame([("A", "x", "shop", 1, 0.5, 0.1)], FORECAST)
    name = write_forecast_table(forecast, "shop")
    assert name == "shop_RTN_CNCL_FC"
    assert rows(spark.table(name)) == rows(forecast)
    with pytest.raises(AnalysisException):
        write_forecast_table(forecast, "shop")


def test_forecast_files_are_never_replaced(spark, tmp_path):
    forecast = spark.createDataFrame([("A", "x", "shop", 1, 0.5, 0.1)], FORECAST)
    path = write_forecast_files(forecast, "shop", str(tmp_path))
    assert rows(spark.read.parquet(path)) == rows(forecast)
    with pytest.raises(AnalysisException):
        write_forecast_files(forecast, "shop", str(tmp_path))


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_settings_are_applied(spark):
    assert {key: spark.conf.get(key) for key in SETTINGS} == SETTINGS


def test_no_rule_is_switched_off(spark, conf):
    rules = "spark.sql.optimizer.excludedRules"
    conf(spark__sql__optimizer__excludedRules="a.b.Rule")
    entry.queries()["return_cancel_forecast"](spark, "/root/testdata/sf0.001").collect()
    assert spark.conf.get(rules) == "a.b.Rule"


def test_shuffles_are_sized_for_what_is_shuffled_but_never_lowered(spark, conf):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    conf(spark__sql__adaptive__coalescePartitions__initialPartitionNum="1")
    configure(spark, shuffled_bytes=10)
    assert spark.conf.get(key) == "1"
    # 100 TB read, of which a period's columns are a twentieth.
    configure(spark, shuffled_bytes=5 * 10**12)
    assert int(spark.conf.get(key)) == 9314


def test_stored_names_of_tables(spark, make, tmp_path):
    make("stock", [{"sku": "a", "quantity": 2}]).write.parquet(f"{tmp_path}/shop/raw_stock")
    make("stock", [{"sku": "b"}]).write.parquet(f"{tmp_path}/elsewhere")
    by_name = Venture(spark, "shop", str(tmp_path), {"stock": "raw_stock"})
    by_path = Venture(spark, "shop", str(tmp_path), {"stock": f"{tmp_path}/elsewhere"})
    assert rows(by_name.table("stock"), "sku") == [("a",)] and rows(by_path.table("stock"), "sku") == [("b",)]
    spark.sql("create schema shop_c")
    spark.sql("create schema layer")
    make("stock", [{"sku": "c"}]).write.saveAsTable("shop_c.raw_stock")
    make("stock", [{"sku": "d"}]).write.saveAsTable("layer.stock")
    assert rows(Venture(spark, "shop_c", stored={"stock": "raw_stock"}).table("stock"), "sku") == [("c",)]
    assert rows(Venture(spark, "shop_c", stored={"stock": "layer.stock"}).table("stock"), "sku") == [("d",)]


def test_replenishment_report_over_stored_names(spark, tmp_path):
    needed = ("product", "stock", "sales_order_item")
    sample = SampleTables(spark, "/root/testdata/sf0.001")
    for name in needed:
        sample.table(name).write.parquet(f"{tmp_path}/shop/raw_{name}")
    shop = Venture(spark, "shop", str(tmp_path), {name: f"raw_{name}" for name in needed})
    registered = entry.REGISTRY["replenishment_report_v2"]
    assert rows(registered.run(shop.table)) == rows(registered.run(sample.table))


def test_blank_texts_are_missing(spark, make, tmp_path):
    make("sales_order", [{"order_nr": ""}]).write.parquet(f"{tmp_path}/shop/sales_order")
    items = [{"id_sales_order_item": i, "name": "", "dwh_shipment_state": s} for i, s in enumerate(("", "item_shipped"))]
    make("sales_order_item", items).write.parquet(f"{tmp_path}/shop/sales_order_item")
    shop = Venture(spark, "shop", str(tmp_path))
    assert rows(shop.table("sales_order"), "order_nr") == [(None,)]
    assert rows(shop.table("sales_order_item"), "name") == [(None,), (None,)]
    assert rows(count_sales_before_returns(shop.table("sales_order_item"))) == [(1,)]


def test_forecast_table_in_a_schema_and_folder(spark, tmp_path):
    forecast = spark.createDataFrame([("A", "x", "shop", 1, 0.5, 0.1)], FORECAST)
    spark.sql("create schema forecasts")
    name = write_forecast_table(forecast, "shop", "forecasts", str(tmp_path))
    assert name == "forecasts.shop_RTN_CNCL_FC" and rows(spark.table(name)) == rows(forecast)
    assert rows(spark.read.parquet(f"{tmp_path}/shop_RTN_CNCL_FC")) == rows(forecast)
    with pytest.raises(AnalysisException):
        write_forecast_table(forecast, "shop", "forecasts", str(tmp_path))


def test_sample_item_ids_are_unique(spark):
    items = SampleTables(spark, "/root/testdata/sf0.01").table("sales_order_item")
    current = items.filter(items.dg_end_date == datetime(9999, 12, 31))
    assert current.count() == current.select("id_sales_order_item").distinct().count()


def test_a_failed_run_leaves_no_table(spark, tmp_path):
    spark.sql(f"create schema failing location '{tmp_path}/schema'")
    broken = spark.range(10).selectExpr("id", "if(id < 9, id, raise_error('no more rows')) as n")
    for folder in (None, str(tmp_path)):
        with pytest.raises(Exception, match="no more rows"):
            write_forecast_table(broken, "shop", "failing", folder)
        assert spark.sql("show tables in failing").count() == 0
    whole = spark.range(3)
    assert spark.table(write_forecast_table(whole, "shop", "failing")).count() == 3
    spark.sql("drop schema failing cascade")


def test_the_registered_query_leaves_no_schema(spark):
    before = spark.sql("show schemas").count()
    rows = entry.queries()["write_forecast_table"](spark, "/root/testdata/sf0.001")
    assert spark.sql("show schemas").count() == before
    assert rows.count() == entry.entry(spark).count()
