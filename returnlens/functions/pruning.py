"""Skipping rows before a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


BITS = 22  # of a position; the bit set has 2^22 of them, 512 KB, whatever the number of keys
WORD_BITS = 64


def likely_partners(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose ``column`` is probably one of the keys; no partner of an equi join is lost.

    The keys set three bits each in a bit set of fixed size, which the rows are tested against as they leave their
    scan, before any shuffle. Of other rows fewer than one in 10^6 pass beside 10,000 keys and 0.7 % beside 300,000; a
    set that is full tests in vain, but right. ``keys`` should be the very table the rows are joined with, so
    that both uses share its shuffle.
    """
    spark = keys.sparkSession
    set_bits = (
        keys.filter(F.col(key).isNotNull())
        .select(F.explode(F.array(*_positions(key))).alias("position"))
        .groupBy(F.shiftright("position", 6).alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(position % {WORD_BITS} as int))")).alias("bits"))
    )
    # Every word once, in order: a plain array, in which a position is found without a search.
    blank = spark.range((1 << BITS) // WORD_BITS).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = (
        set_bits.unionByName(blank)
        .groupBy("word")
        .agg(F.bit_or("bits").alias("bits"))
        .agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"))
        .select(F.col("words.bits"))
        .scalar()
    )
    tests = [
        F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), (p % WORD_BITS).cast("int")) == 1
        for p in _positions(column)
    ]
    # Spark would copy a test of the column itself to the other side of the join, which then is no longer the plan
    # whose shuffle the bit set shares. It does not see that a number with no further bits is the same.
    return rows.filter(tests[0] & tests[1] & tests[2]).withColumn(column, F.col(column).bitwiseOR(F.lit(0)))


def _positions(key: str) -> list[Column]:
    """Three positions out of one hash."""
    mixed = F.xxhash64(key)
    return [F.shiftrightunsigned(mixed, shift).bitwiseAND(F.lit((1 << BITS) - 1)) for shift in (0, BITS, 64 - BITS)]


def between_ends(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose ``column`` lies between the smallest and the largest of the keys.

    No partner of an equi join is lost. Ids are given out in order of time, so the orders of a
    period are a small range of ids: as a filter known before the scan starts, the range skips
    the other row groups, and their rows are never shuffled. Where ids do not follow time it
    only costs the minimum and maximum.
    """
    # Both values ask for both ends, so that their aggregations are alike and run once.
    # The coalesce keeps Spark from merging them into one struct, which no scan takes as a filter.
    first, last = (keys.agg(end(F.min(key), F.max(key))).coalesce(1).scalar() for end in (F.least, F.greatest))
    return rows.filter(F.col(column).between(first, last))
