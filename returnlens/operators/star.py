"""Sales and return rates on the star schema: fact sales with dates, articles and products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnlens.functions.periods import Lookback, date_id_bounds
from returnlens.functions.rates import difference_rate
from returnlens.functions.skew import known, once_per_key, row_counts

PERIOD = Lookback(start=78, end=30)
SOLD = ("sold_articles_bef_return", "sold_articles")


def product_sales(
    fct_sales: DataFrame,
    dim_dates: DataFrame,
    dim_articles: DataFrame,
    dim_products: DataFrame,
    lookback: Lookback = PERIOD,
) -> DataFrame:
    """Sold articles of the period per (sku, targetgroup, description).

    The fact is reduced to one row per article before it meets a dimension; a dimension that
    lists a key several times multiplies through its row count. All three rate levels read this
    one result, and since each needs both sums Spark runs it once and reuses its exchange.
    """
    first, after_last = date_id_bounds(fct_sales, lookback)
    in_period = (F.col("date_id") >= first) & (F.col("date_id") < after_last)
    # One row per date id of the period: never more than start - end rows.
    dates = F.broadcast(row_counts(dim_dates.filter(in_period), "date_id"))
    sold = fct_sales.filter(in_period).join(dates, "date_id")
    per_article = once_per_key(sold, "article_id", *_sums(F.col("copies")))

    articles = row_counts(dim_articles, "article_id", "product_id")
    per_product = once_per_key(per_article.join(articles, "article_id"), "product_id", *_sums(F.col("copies")))

    products = row_counts(dim_products, "product_id", "sku", "targetgroup", "description")
    return (
        per_product.join(products, "product_id")
        .groupBy("sku", "targetgroup", "description")
        .agg(*_sums(F.col("copies")))
    )


def star_sku_sales(
    fct_sales: DataFrame,
    dim_dates: DataFrame,
    dim_articles: DataFrame,
    dim_products: DataFrame,
    lookback: Lookback = PERIOD,
) -> DataFrame:
    sales = product_sales(fct_sales, dim_dates, dim_articles, dim_products, lookback)
    return sales.groupBy(F.col("sku").alias("product_sku")).agg(*_sums())


def star_sku_attributes(
    fct_sales: DataFrame,
    dim_dates: DataFrame,
    dim_articles: DataFrame,
    dim_products: DataFrame,
    lookback: Lookback = PERIOD,
) -> DataFrame:
    """Sku sales with the targetgroup and description valid at the end of the period."""
    sales = product_sales(fct_sales, dim_dates, dim_articles, dim_products, lookback)
    return with_attributes(level_sales(sales, "sku"), fct_sales, dim_dates, dim_products, lookback)


def star_targetgroup_rates(
    fct_sales: DataFrame,
    dim_dates: DataFrame,
    dim_articles: DataFrame,
    dim_products: DataFrame,
    lookback: Lookback = PERIOD,
) -> DataFrame:
    return _rates(product_sales(fct_sales, dim_dates, dim_articles, dim_products, lookback), "targetgroup")


def star_description_rates(
    fct_sales: DataFrame,
    dim_dates: DataFrame,
    dim_articles: DataFrame,
    dim_products: DataFrame,
    lookback: Lookback = PERIOD,
) -> DataFrame:
    return _rates(product_sales(fct_sales, dim_dates, dim_articles, dim_products, lookback), "description")


def level_sales(sales: DataFrame, level: str) -> DataFrame:
    """Both sums per value of one level, '' for a missing value: the form to join to."""
    return once_per_key(sales.withColumn(level, known(level)), level, *_sums())


def _rates(sales: DataFrame, level: str) -> DataFrame:
    before, after = (F.col(n) for n in SOLD)
    return sales.groupBy(level).agg(*_sums()).withColumn(f"return_rate_{level}", difference_rate(before, after))


def with_attributes(
    sku_sales: DataFrame,
    fct_sales: DataFrame,
    dim_dates: DataFrame,
    dim_products: DataFrame,
    lookback: Lookback = PERIOD,
) -> DataFrame:
    """Point-in-time join: one calendar date picks the valid dimension rows, then sku = sku.

    Without a calendar row for that date nothing is valid and the result is empty.
    """
    _, end_id = date_id_bounds(fct_sales, lookback)
    end_date = (
        dim_dates.filter(F.col("date_id") == end_id)
        .agg(F.max(F.to_date("iso_date", "yyyy.MM.dd")).alias("end_date"))
        .scalar()
    )
    valid = dim_products.filter((F.col("valid_from") <= end_date) & (F.col("valid_to") >= end_date)).select(
        F.col("sku").alias("product_sku"), "targetgroup", "description"
    )
    sold = sku_sales.withColumnRenamed("sku", "product_sku")
    return sold.join(valid, "product_sku").select("product_sku", "targetgroup", "description", *SOLD)


def _sums(weight: Column | None = None) -> list[Column]:
    return [F.sum(F.col(n) if weight is None else F.col(n) * weight).alias(n) for n in SOLD]
