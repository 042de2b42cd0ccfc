from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from returnlens.session import configure  # noqa: E402
from returnlens.sources.schemas import SCHEMAS  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def make(spark):
    """Build a table of the declared schema from dicts; left-out columns are NULL."""

    def build(name: str, rows: list[dict]):
        columns = [part.split(" ")[0] for part in SCHEMAS[name].split(", ")]
        assert all(set(row) <= set(columns) for row in rows)
        return spark.createDataFrame([tuple(row.get(c) for c in columns) for row in rows], SCHEMAS[name])

    return build


@pytest.fixture
def conf(spark):
    """Set session options for one test."""
    changed = {}

    def change(**options):
        for key, value in options.items():
            key = key.replace("__", ".")
            changed.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield change
    for key, value in changed.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)
