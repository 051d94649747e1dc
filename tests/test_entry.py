import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q)"


def listed(root):
    out = subprocess.run([sys.executable, "-c", LIST], cwd=root, capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": root})
    n, ops, pipeline = out.stdout.split()
    return int(n), int(ops), pipeline == "True"


def test_entry_without_the_optional_part(tmp_path):
    """The other queries stand on their own; no session is needed to list them."""
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/wirelens", tmp_path / "wirelens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    n, ops, pipeline = listed(str(tmp_path))
    assert (ops, pipeline) == (0, False)
    assert n >= 60
    whole = listed(ROOT)
    assert whole[0] >= n


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
