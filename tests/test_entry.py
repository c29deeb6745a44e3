"""The driver's contract, also without the corpus operators."""

import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parents[1]


def test_entry_without_the_corpus_operators(tmp_path):
    for with_pipeline in (False, True):
        copy = tmp_path / f"copy{with_pipeline}"
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if with_pipeline else ["corpus_pipeline.py"])))
        code = "import __spark_entry__ as e; q = e.queries(); assert 'feed_top' in q and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q)"
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and len(e.oracle_sql()) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
