"""The library stands without the operators of the training-data pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_and_tests_without_the_folders(tmp_path):
    left_out = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache", ".hypothesis")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=left_out)
    for keep_pipeline in (True, False):
        if not keep_pipeline:
            (tmp_path / "copy" / "corpus_pipeline.py").unlink()
        code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), [q for q in e.queries() if q.startswith('op')])"
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
        counts = done.stdout.split()
        assert counts[0] == counts[1] and counts[2] == "[]"
    done = subprocess.run(
        [sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stdout + done.stderr
