from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from returnlens.llm.shared import ship_package  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def package_on_workers(spark):
    ship_package(spark, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def texts(spark):
    """Rows of id and text, spread over partitions, with columns whose names the operators use inside."""

    def build(rows):
        schema = "doc_id long, text string, key long, class string, fp string, line string, kept string, score string"
        full = [(*row, None, "x", "y", "z", "no", "high") for row in rows]
        return spark.createDataFrame(full, schema).repartition(3, "text")

    return build
