"""The engine stands without the training-data subpackage, its tests and the pipeline."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAID = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert callable(e.entry) and set(s) <= set(q); print(sorted(q))"


@pytest.mark.parametrize("gone", [("marlspark/llm", "tests/llm"), ("marlspark/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without_folders(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for g in gone:
        shutil.rmtree(copy / g) if (copy / g).is_dir() else (copy / g).unlink(missing_ok=True)
    said = subprocess.run([sys.executable, "-B", "-c", SAID], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert "r15_hybrid_search" in said.stdout and "pipeline" not in said.stdout
    assert ("op1_" in said.stdout) == os.path.isdir(copy / "marlspark/llm")
