"""bench.py prints exactly one JSON line with the fields the driver reads."""

import json
import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_bench_prints_one_json_line(tmp_path):
    env = dict(os.environ, BENCH_SF_DIR=SF, BENCH_ONLY="store_always_open,table_counts",
               BENCH_WARM="one", BENCH_CPUS="2")
    out = subprocess.run([sys.executable, os.path.join(REPO, "bench.py")], cwd=tmp_path,
                         env=env, capture_output=True, text=True, timeout=600)
    lines = [ln for ln in out.stdout.splitlines() if ln.strip()]
    assert len(lines) == 1, out.stdout + out.stderr[-2000:]
    d = json.loads(lines[0])
    assert d["unit"] == "sec" and d["sf"] == 0.001 and d["metric"]
    assert set(d["queries"]) == {"etl_domain_tables", "store_always_open", "table_counts"}
    assert abs(d["value"] - sum(d["queries"].values())) < 0.01
