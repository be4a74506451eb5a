"""The entry module imports whatever is left of the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("without", [(), ("shelfline/llm", "tests/llm"), ("shelfline/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_import_without_the_training_data_operators(tmp_path, without):
    copy = tmp_path / "copy"
    skipped = {str(REPO / name) for name in without} | {str(REPO / ".git")}
    shutil.copytree(REPO, copy, ignore=lambda folder, names: [n for n in names if f"{folder}/{n}" in skipped or n == "__pycache__"])
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"], cwd=copy, capture_output=True, text=True, check=True)
    queries, oracles = (line.split() for line in said.stdout.splitlines()[-2:])
    assert set(oracles) <= set(queries) and "drilldown_region" in oracles
    llm = (copy / "shelfline/llm").exists()
    assert any(q.startswith("op") and q[2].isdigit() for q in queries) == llm
    assert ("pipeline" in queries) == (llm and (copy / "corpus_pipeline.py").exists())
