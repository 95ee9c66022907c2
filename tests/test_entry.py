"""The entry module without the optional subpackage, as it is left when its folders are deleted."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries(), any(n.startswith('op1_') for n in e.queries()))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_rest_without_the_subpackage(tmp_path, pipeline):
    shutil.copytree(os.path.join(ROOT, "emberlog"), tmp_path / "emberlog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *["corpus_pipeline.py"] * pipeline):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    n, twins, has_pipeline, has_operators = out.stdout.split()
    assert int(n) == int(twins) > 100 and (has_pipeline, has_operators) == ("False", "False")
