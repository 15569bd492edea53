from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert set(s) <= set(q) and len(q) > 150; print(len(q))"
    env = os.environ | {"PYTHONPATH": str(ROOT)}
    assert subprocess.run([sys.executable, "-c", code], cwd="/", env=env, capture_output=True, text=True, check=True).stdout.strip().isdigit()


def test_nothing_else_imports_the_training_data_operators():
    for path in ROOT.glob("framelake/**/*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "framelake.llm import" not in path.read_text() and "import framelake.llm" not in path.read_text()


def test_flagship(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.columns == ["place", "frame", "bin", "n"]
    if Path("/root/testdata/sf0.001").is_dir():
        assert rows.count() > 0
