"""The entry module's contract, with and without the corpus subpackage."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_every_query_has_sql_or_says_why_not():
    import __spark_entry__ as e

    names, sql = set(e.queries()), set(e.oracle_sql())
    assert sql <= names
    assert all(re.match(r"op\d+_|pipeline$", n) for n in names - sql)


def test_the_engine_stands_without_the_corpus_operators(tmp_path):
    for p in ("__spark_entry__.py", "quillstone"):
        (shutil.copytree if (REPO / p).is_dir() else shutil.copy)(REPO / p, tmp_path / p)
    shutil.rmtree(tmp_path / "quillstone" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert e.queries() and set(e.queries()) == set(e.oracle_sql()); assert not [n for n in e.queries() if n.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_else_imports_the_corpus_operators():
    for f in (REPO / "quillstone").rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text(), f
