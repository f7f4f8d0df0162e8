"""The ranked search needs no more memory where a task has more documents."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
from pyspark.sql import SparkSession, functions as F
from tessera.llm.ranked_search import ranked

spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.sql.shuffle.partitions", "4").config("spark.sql.warehouse.dir", sys.argv[1]).getOrCreate()
words = F.transform(F.sequence(F.lit(1), F.lit(700)), lambda i: F.hex(F.pmod(F.xxhash64("id", i), F.lit(60000))))
docs = spark.range(0, 40000, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", words).alias("text"))
items = spark.createDataFrame([(1, "A1B 2C3D 77"), (2, "nowhere")], "item_id long, text string")
rows = ranked(items, docs).collect()
assert [(r["item_id"], r["rank"]) for r in rows] == [(1, k) for k in range(1, 11)], rows
"""


def test_one_task_with_many_segments_fits_a_small_heap(tmp_path):
    """Some 190 MB of text, 45 segments, in one task with 450 MB of heap."""
    env = os.environ | {"PYTHONPATH": str(ROOT), "PYSPARK_PYTHON": sys.executable, "PYSPARK_SUBMIT_ARGS": "--driver-memory 450m pyspark-shell", "SPARK_LOCAL_IP": "127.0.0.1"}
    run = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
