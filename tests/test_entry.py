import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()), any(n.startswith('op') for n in e.queries()))"


@pytest.mark.parametrize("gone", [("relaycore/llm", "tests/llm"), ("relaycore/llm", "tests/llm", "corpus_pipeline.py")])
def test_the_rest_works_without_the_optional_folders(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for name in gone:
        path = copy / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    said = subprocess.run([sys.executable, "-B", "-c", COUNT], cwd=copy, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    count, known, llm = said.stdout.split()
    assert int(count) >= 45 and known == "True" and llm == "False"
