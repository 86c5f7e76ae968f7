"""The entry points with and without the corpus operators."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LIST = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


@pytest.mark.parametrize("gone", [("tidecount/llm",), ("tidecount/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",), ()])
def test_entry_without_parts(tmp_path, gone):
    if not (ROOT / "tidecount" / "llm").exists():
        gone = ()
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    out = subprocess.run([sys.executable, "-c", LIST], cwd=copy, capture_output=True, text=True, check=True).stdout
    queries, sql = json.loads(out.strip().splitlines()[-1])
    assert "dau_exact" in queries and "dau_exact" in sql and not set(sql) - set(queries)
    if "tidecount/llm" in gone:
        assert "pipeline" not in queries and not [q for q in queries if q.startswith("op1")]
