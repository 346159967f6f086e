"""The entry module without the corpus folders: all other queries stay."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent
#: The child sees its own folder only, whatever the caller's path.
ENV = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
ASK = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


@pytest.mark.parametrize("gone", [("tidemark/llm", "tests/llm"), ("tidemark/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_queries_without_the_corpus_folders(tmp_path, gone):
    copy = tmp_path / "repo"
    copy.mkdir()
    for name in ("tidemark", "tests", "corpus_pipeline.py", "__spark_entry__.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, copy / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, copy / name)
    for name in gone:
        if (copy / name).is_dir():
            shutil.rmtree(copy / name)
        else:
            (copy / name).unlink(missing_ok=True)
    got = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=copy, capture_output=True, text=True, timeout=120, env=ENV)
    assert got.returncode == 0, got.stderr
    core = {n for m in entry.MODULES for n in __import__(m, fromlist=["QUERIES"]).QUERIES}
    assert core <= set(got.stdout.split())
    assert "pipeline" not in got.stdout.split()


def test_other_import_errors_are_not_swallowed(tmp_path):
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module")
    got = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=tmp_path, capture_output=True, text=True, timeout=120, env=ENV)
    assert "no_such_module" in got.stderr
