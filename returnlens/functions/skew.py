"""Joins that stay balanced when one key holds a large share of the rows.

Both sides of a join are aggregated to one row per key wherever the result allows it. Where one
side must keep its rows (items, sessions, catalogue rows), the other side comes from
``once_per_key``: then both sides are shuffled directly under the join, which is the shape in
which adaptive execution cuts a hot partition into pieces of the advisory size. Rows are never
paired copy by copy; a side that occurs several times carries its number instead.

Apart from a few sides that are bounded by construction, no join is forced to broadcast: Spark
compares the measured size with ``spark.sql.autoBroadcastJoinThreshold`` and shuffles beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once_per_key(table: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    """One row per key, combined before the shuffle.

    An aggregate grouped by the key alone would be joined in place, without a shuffle of its own,
    and the other side's hot partition would stay whole. Grouping by the key and its hash gives
    the same rows but leaves them partitioned by more than the key.
    """
    hashed = table.withColumn("_hash", F.xxhash64(key))
    if not aggregates:
        return hashed.select(key, "_hash").distinct().select(key)
    return hashed.groupBy(key, "_hash").agg(*aggregates).drop("_hash")


def known(key: str | Column) -> Column:
    """The key with '' for NULL, for a result that several joins share.

    Tables hold no '' (it is read as NULL), so such a row matches nothing, as a NULL would. But
    a key that cannot be NULL gets no IS NOT NULL filter pushed below the shared result, hence
    all its uses stay the same plan and Spark runs the shuffle beneath them once.
    """
    return F.coalesce(key, F.lit(""))


def missing_blank(column: str) -> Column:
    """A text column that is read with its blanks, with NULL for them, where it is returned."""
    return F.nullif(column, F.lit("")).alias(column)


def row_counts(table: DataFrame, *keys: str) -> DataFrame:
    """One row per combination of keys with the number of rows it stands for."""
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))


def order_rows(orders: DataFrame) -> DataFrame:
    """Each order id with its number of rows: an order listed several times multiplies its items."""
    return once_per_key(orders, "id_sales_order", F.count(F.lit(1)).alias("order_rows"))
