"""The driver's contract, with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_corpus_operators(tmp_path):
    for name in os.listdir(HERE):
        if name in ("__spark_entry__.py", "tessera"):
            (shutil.copytree if os.path.isdir(f"{HERE}/{name}") else shutil.copy)(f"{HERE}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "tessera/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
