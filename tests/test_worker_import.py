"""Python code run by Spark (executor workers, the stateful operator's
driver-side runner) must work when the driver runs from another folder."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").getOrCreate()
import __spark_entry__ as E
for key in ("stock_deduct_rows", "stock_deduct_stream"):
    print("ROWS", key, E.queries()[key](spark, {SF!r}).count())
"""


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_python_worker_key_from_foreign_cwd(tmp_path):
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True,
                         text=True, timeout=600)
    assert "ROWS stock_deduct_rows 5942" in out.stdout, out.stderr[-2000:]
    assert "ROWS stock_deduct_stream 5942" in out.stdout, out.stderr[-2000:]
