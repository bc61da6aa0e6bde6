"""The entry module works with and without the training-data subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_llm(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 30 and set(o) <= set(q) and 'pipeline' not in q, q"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_sql_belongs_to_queries():
    sys.path.insert(0, ROOT)
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
