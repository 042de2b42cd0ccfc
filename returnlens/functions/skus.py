"""Config sku of a simple sku."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def config_prefix(sku: str | Column) -> Column:
    """The part of the sku before its first dash.

    NULL when there is no dash or nothing stands before it.
    """
    sku = F.col(sku) if isinstance(sku, str) else sku
    return F.when(F.instr(sku, "-") > 1, F.substring_index(sku, "-", 1))
