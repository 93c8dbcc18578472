"""The entry file with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), any(k.startswith('op') or k == 'pipeline' for k in q))"


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    for pipeline in (True, False):  # the pipeline's file may stay behind
        if not pipeline:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        done = subprocess.run([sys.executable, "-c", SAY], capture_output=True, text=True, cwd=copy, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, timeout=120)
        assert done.returncode == 0, done.stderr
        queries, sql, corpus = done.stdout.split()
        assert int(queries) == int(sql) >= 33 and corpus == "False"
