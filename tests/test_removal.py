"""The library without its training-data part: everything else imports and the other queries stay."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]


def test_rest_works_without_the_removable_part(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); print('fine', len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert done.returncode == 0 and "fine" in done.stdout, done.stderr


def test_nothing_else_imports_it():
    for path in (ROOT / "quillspark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "quillspark.llm" not in path.read_text(), path
