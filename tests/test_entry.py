"""The entry point without the folders that may be deleted."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op1') for n in q), set(e.oracle_sql()) <= set(q))"


@pytest.mark.parametrize("gone", [("cohortgrid/llm", "tests/llm"), ("cohortgrid/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_training_data_folders(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda d, names: [n for n in names if n.startswith(".") or n in ("__pycache__", "spark-warehouse")
                                                         or os.path.relpath(os.path.join(d, n), ROOT) in gone])
    for name in gone:
        assert not (copy / name).exists()
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(copy)})
    assert out.returncode == 0, out.stderr
    count, pipeline, op, keys = out.stdout.split()
    assert int(count) > 100 and (pipeline, op, keys) == ("False", "False", "True")


def test_a_broken_pipeline_is_not_hidden(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    if not (copy / "cohortgrid" / "llm").exists():
        pytest.skip("nothing to break")
    (copy / "corpus_pipeline.py").write_text("import no_such_module\n")
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(copy)})
    assert out.returncode != 0 and "no_such_module" in out.stderr
