import os
import subprocess
import sys
from pathlib import Path

CODE = """
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
print("ROWS", e.entry(spark).count(), *[e.queries()[n](spark, {data!r}).count() for n in ("footer_files", "footer_source", "plan_parts")])
"""


def test_workers_find_the_code_from_any_folder(tmp_path):
    root = str(Path(__file__).resolve().parents[1])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=root, data="/root/testdata/sf0.001")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=170)
    assert "ROWS 6 1 1 2" in done.stdout, done.stderr[-2000:]
