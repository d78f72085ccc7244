"""The library works with the training-data package deleted, or there but not importable."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import os
import __spark_entry__ as e
from pyspark.sql import SparkSession
q, o = e.queries(), e.oracle_sql()
assert not [k for k in q if k.startswith("op") and k[2].isdigit() or k == "pipeline"], sorted(q)
assert len(q) >= 80 and set(o) <= set(q)
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", os.getcwd() + "/wh").getOrCreate()
assert q["latest_any_date"](s, "/root/testdata/sf0.001").count() == 1
"""


@pytest.mark.parametrize("how", ["deleted", "broken"])
def test_without_training_package(tmp_path, how):
    shutil.copytree(f"{ROOT}/pledgelens", tmp_path / "pledgelens", ignore=shutil.ignore_patterns("__pycache__", *(["llm"] if how == "deleted" else [])))
    for f in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{f}"):
            shutil.copy(f"{ROOT}/{f}", tmp_path)
    if how == "broken" and (tmp_path / "pledgelens/llm").exists():
        (tmp_path / "pledgelens/llm/common.py").write_text("import a_module_that_is_not_there\n")
    env = {**os.environ, "PYTHONPATH": f"{tmp_path}:{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
