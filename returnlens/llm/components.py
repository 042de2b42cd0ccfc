"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnlens.functions.skew import once_per_key
from returnlens.session import shared_dir


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Every linked node with its component, the smallest node it reaches: columns ``node``, ``component``.

    Each round links all larger neighbours of a node to its smallest neighbour, then the smaller ones (large star,
    small star); the links end as one star per component after a logarithmic number of rounds. Each round's links are
    a reliable checkpoint, so no lineage grows and lost executors cost one round at most. A hub's links are spread
    over tasks: its minimum is combined before the shuffle, and the join has one row per node on the other side.
    Links of a node to itself and links with a NULL end are left out.
    """
    spark = links.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    edges = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
        .checkpoint()
    )
    state = None
    while True:
        found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == state or not found[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        state = tuple(found)
        edges = _small_star(_large_star(edges)).checkpoint()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = once_per_key(both, "u", F.min("v").alias("m")).select(
        F.col("u").alias("centre"), F.least("u", "m").alias("m")
    )
    larger = both.filter("v > u").join(least, F.col("u") == F.col("centre"))
    return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = once_per_key(edges, "u", F.min("v").alias("m")).select(F.col("u").alias("centre"), "m")
    linked = edges.join(least, F.col("u") == F.col("centre")).filter("v != m")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select(F.col("centre").alias("u"), F.col("m").alias("v"))
    ).distinct()
