import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp}").getOrCreate()
for name in {names!r}:
    e.queries()[name](s, "/root/testdata/sf0.001").count()
print("all done")
"""


def test_workers_need_no_package(tmp_path):
    """Functions travel by value: queries run where Python workers can't import the package."""
    names = ["op1_quality_classifier", "op2_pii", "op3_tiff", "op4_chat", "op5_warc", "op6_bpe", "op7_simhash", "nearest_neighbours", "pairwise_complete", "redundancy_clusters", "pileup_majority"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT, tmp=tmp_path, names=names)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all done" in out.stdout, out.stderr[-2000:]
