"""The driver contract where the training-data folders are not there."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from spotweave.plans.queries import QUERIES

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [["spotweave/llm", "tests/llm"], ["spotweave/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_spatial_queries_need_no_training_data_folders(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        target = tmp_path / "copy" / name
        shutil.rmtree(target) if target.is_dir() else target.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert got.returncode == 0, got.stderr
    names, sql = (line.split() for line in got.stdout.splitlines()[-2:])
    assert set(QUERIES) <= set(names) and set(sql) <= set(names) and "pipeline" not in names
