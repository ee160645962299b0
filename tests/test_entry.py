"""The driver contract, also without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("gone", [(), ("lorebase/llm", "tests/llm"), ("lorebase/llm", "tests/llm", "corpus_pipeline.py")])
def test_queries_can_be_read(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.pyc", "*.md", "*.json", "*.txt", "spark-warehouse", "artifacts"))
    for name in gone:
        if (copy / name).exists():
            shutil.rmtree(copy / name) if (copy / name).is_dir() else (copy / name).unlink()
    if not (copy / "lorebase/llm").exists():
        gone = gone or ("lorebase/llm",)
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert set(s) <= set(q), set(s) - set(q); print(len(q), 'pipeline' in q, any(x.startswith('op1_') for x in q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})
    assert done.returncode == 0, done.stderr[-2000:]
    count, pipeline, op = done.stdout.split()
    assert int(count) > 60 and (pipeline, op) == (("False", "False") if gone else ("True", "True"))
