"""Writing a forecast as a new table. An existing one is never replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame


def forecast_table_name(venture: str) -> str:
    return f"{venture}_RTN_CNCL_FC"


def write_forecast_table(
    forecast: DataFrame, venture: str, schema: str | None = None, folder: str | None = None
) -> str:
    """Create the venture's forecast table at once, in ``folder`` if one is given; fails when it exists.

    The table is known to the catalog only when all its rows are written, so a run that fails leaves none.
    """
    name = forecast_table_name(venture)
    qualified = f"{schema}.{name}" if schema else name
    writer = forecast.writeTo(qualified).using("parquet")
    if folder:
        writer = writer.option("path", f"{folder.rstrip('/')}/{name}")
    writer.create()
    return qualified


def write_forecast_files(forecast: DataFrame, venture: str, folder: str) -> str:
    """The same as a Parquet folder below ``folder``."""
    path = f"{folder.rstrip('/')}/{forecast_table_name(venture)}"
    forecast.write.mode("errorifexists").parquet(path)
    return path
