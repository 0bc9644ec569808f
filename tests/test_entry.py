"""The entry point with the corpus operators deleted, with and without the pipeline file."""

import os
import shutil
import subprocess
import sys

import pytest

from conftest import ROOT

SAYS = "import __spark_entry__ as e, perigee.plans as p; q, o = e.queries(), e.oracle_sql(); print(q.keys() == p.queries().keys(), o.keys() == p.oracle_sql().keys(), callable(e.entry))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_corpus_operators(tmp_path, pipeline):
    for name in ("perigee", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif (ROOT / name).exists() and (pipeline or name != "corpus_pipeline.py"):
            shutil.copy(ROOT / name, tmp_path / name)
    got = subprocess.run([sys.executable, "-c", SAYS], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert got.stdout.split() == ["True", "True", "True"], got.stderr
