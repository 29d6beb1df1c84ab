import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert "base_table" in q and "base_table" in o and set(o) <= set(q)
print(sorted(n for n in q if n.startswith("op") or n == "pipeline"))
"""


@pytest.mark.parametrize("gone", [("tidemark/llm", "tests/llm"), ("tidemark/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without_parts(tmp_path, gone):
    """Whatever is deleted of the training-data part, the other queries are there."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.md"))
    for name in gone:
        if (copy / name).is_dir():
            shutil.rmtree(copy / name)
        else:
            (copy / name).unlink(missing_ok=True)
    got = subprocess.run([sys.executable, "-c", CODE], cwd=copy, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
    if "tidemark/llm" in gone:
        assert got.stdout.strip() == "[]"
