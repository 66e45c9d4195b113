"""The entry module works without the corpus subpackage and the pipeline."""
import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CHECK = ("import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); "
         "print(len(q) > 90 and set(s) <= set(q), any(k.startswith('op') for k in q), 'pipeline' in q)")


def run(folder):
    return subprocess.run([sys.executable, "-c", CHECK], cwd=folder, capture_output=True, text=True, timeout=120,
                          env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}).stdout.split()


def test_a_copy_without_them(tmp_path):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/meshwork", tmp_path / "meshwork", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    assert run(tmp_path) == ["True", "False", "False"]
    # what is left of a deleted folder is no package with queries
    (tmp_path / "meshwork" / "llm" / "__pycache__").mkdir(parents=True)
    assert run(tmp_path) == ["True", "False", "False"]
