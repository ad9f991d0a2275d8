"""The entry works from any folder: Python functions reach the workers."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = f"""
import sys
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as entry
from mailsift.session import local_session
spark = local_session("2", shuffle_partitions=2)
print("ROWS", entry.queries()["simhash_fingerprints"](spark, "/root/testdata/sf0.001").count())
"""


def test_query_with_a_python_function_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 200" in done.stdout, done.stderr[-2000:]
