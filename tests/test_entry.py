from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__
import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_works_without_the_text_operators(tmp_path, pipeline):
    """Both folders gone, with and without the pipeline's file: queries are listed and one of them runs."""
    shutil.copytree(ROOT / "tessella", tmp_path / "tessella", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *["corpus_pipeline.py"] * pipeline):
        shutil.copy(ROOT / name, tmp_path)
    code = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
q = e.queries()
assert 'grid_dots' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q)
assert e.oracle_sql().keys() <= q.keys()
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()
assert q['luminance'](spark, '/root/testdata/sf0.001').count() == 64 * 48
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith(("SPARK", "PYSPARK"))}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=300)
