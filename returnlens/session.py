"""Session settings the analyses rely on, and the shared folder for written data."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot order, sku or session makes one join partition huge. AQE cuts such a
    # partition into pieces; "force" lets it do so even when a later aggregation
    # then needs a shuffle of its own.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Joining all items to a month of orders: hash the small shuffled side (measured, per
    # partition) instead of sorting the items.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
}


# Bytes of one shuffle partition of the widest exchange. Adaptive execution merges the partitions of smaller ones.
PARTITION_BYTES = 512 * 1024 * 1024


def configure(spark: SparkSession, shuffled_bytes: int | None = None) -> SparkSession:
    """Apply the settings; with ``shuffled_bytes`` also size the shuffles for the widest exchange.

    That is what arrives in the widest exchange after filters, column pruning and map-side combining, far less than
    what is read. The settings stay on the session; no optimizer rule is switched off. The number of shuffle
    partitions the session already has is never lowered.
    """
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    if shuffled_bytes is not None:
        wanted = math.ceil(shuffled_bytes / PARTITION_BYTES)
        if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(wanted))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only where that is unset (single-machine tests) a local folder is used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="returnlens-")
