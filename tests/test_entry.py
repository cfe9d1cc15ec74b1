"""The entry works without the optional training-data parts."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_optional_parts(tmp_path):
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__")
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert not [k for k in q if k.startswith('op')  and '_' in k and k[2:].split('_')[0].isdigit()]; assert 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(copy)})
    assert done.returncode == 0, done.stderr[-800:]
    assert int(done.stdout.split()[-1]) > 140
