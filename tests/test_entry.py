"""The driver contract holds without the corpus operations."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_the_corpus_folders(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "*.json"))
    assert (copy / "corpus_pipeline.py").exists() == (ROOT / "corpus_pipeline.py").exists()
    code = ("import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); "
            "assert 'X04_type_iqr_flags' in q and set(o) <= set(q); "
            "assert 'pipeline' not in q and not any(n.startswith('op') for n in q)")
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
