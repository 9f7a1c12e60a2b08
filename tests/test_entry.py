"""The driver contract, with and without the training-data folders."""

import json
import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def names(folder):
    out = subprocess.run([sys.executable, "-c", ASK], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True)
    return json.loads(out.stdout.splitlines()[-1])


@pytest.mark.parametrize("gone", [("tallystone/llm", "tests/llm"), ("tallystone/llm", "tests/llm", "corpus_pipeline.py")])
def test_queries_without_the_training_data_folders(tmp_path, gone):
    copy = tmp_path / "tree"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    left, sql = names(copy)
    assert len(left) > 140 and set(sql) <= set(left)
    assert not any(n == "pipeline" or n.startswith("op") for n in left)
