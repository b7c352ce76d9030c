import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from quarrystone.plans import catalog

ROOT = Path(__file__).resolve().parents[1]
SAYS = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_imports_without_the_training_data_operators(tmp_path, pipeline):
    shutil.copytree(ROOT / "quarrystone", tmp_path / "quarrystone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *["corpus_pipeline.py"] * pipeline]:
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    said = subprocess.run([sys.executable, "-c", SAYS], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert json.loads(said.stdout.splitlines()[-1]) == [sorted(catalog.QUERIES), sorted(catalog.ORACLE_SQL)]
