"""Queries with Python in their tasks run from any folder: workers need not find the package."""

import os
import subprocess
import sys
from pathlib import Path

REPO = str(Path(__file__).resolve().parents[1])
SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
import __spark_entry__ as contract
from featureforge.session import local_session
spark = local_session("anywhere", 2)
for name in ("m1_fit_ols", "a8_corr_matrix"):
    assert contract.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("both ran")
"""


def test_other_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "both ran" in done.stdout, done.stderr[-3000:]
