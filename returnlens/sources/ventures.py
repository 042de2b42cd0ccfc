"""Tables of one business unit ("venture"), as Parquet folders or catalog tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returnlens.functions.periods import day_column
from returnlens.sources.schemas import SCHEMAS, blank_is_null


@dataclass(frozen=True)
class Venture:
    """``root`` holds one folder per venture; without it the venture is a catalog schema.

    ``stored`` gives the stored name of a table where it differs from the logical one; a name with a dot (in a
    catalog) or a slash (in folders) is complete in itself.
    """

    spark: SparkSession
    name: str
    root: str | None = None
    stored: Mapping[str, str] = field(default_factory=dict)

    def table(self, table: str) -> DataFrame:
        stored = self.stored.get(table, table)
        if self.root is None:
            rows = self.spark.table(stored if "." in stored else f"{self.name}.{stored}")
        else:
            path = stored if "/" in stored else f"{self.root.rstrip('/')}/{self.name}/{stored}"
            rows = self.spark.read.schema(SCHEMAS[table]).parquet(path)
        return declared(rows, table)


def declared(rows: DataFrame, table: str) -> DataFrame:
    """The table's declared columns and types, empty strings read as missing values.

    Columns already of the declared type stay bare, so their filters reach the scan. Day columns
    (see ``functions.periods``) are kept where the table has them.
    """
    columns = []
    for name, kind in (part.split(" ") for part in SCHEMAS[table].split(", ")):
        column = F.col(name)
        if rows.schema[name].dataType.simpleString() != kind:
            column = column.cast(kind)
        columns.append((F.nullif(column, F.lit("")) if blank_is_null(table, name, kind) else column).alias(name))
        if day_column(name) in rows.columns:
            columns.append(F.col(day_column(name)))
    return rows.select(*columns)
