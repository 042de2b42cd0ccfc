"""The entry module with and without the optional operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

LIST = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def test_entry_works_without_the_optional_operators(tmp_path):
    root = Path(entry.__file__).parent
    left_out = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(root / "returnlens", tmp_path / "returnlens", ignore=left_out)
    for name in ("__spark_entry__.py", "oracle_queries.py"):
        shutil.copy(root / name, tmp_path)
    done = subprocess.run([sys.executable, "-c", LIST], cwd=tmp_path, capture_output=True, text=True, check=True)
    names, statements = (line.split() for line in done.stdout.splitlines())
    assert set(names) == set(statements) == {*entry.REGISTRY, "write_forecast_table"}
