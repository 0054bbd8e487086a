"""Operators run where the workers have no copy of the package."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])  # the driver's path only
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config(
    "spark.checkpoint.dir", sys.argv[2]).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")

def seen(batches):
    import importlib.util
    for b in batches:
        assert importlib.util.find_spec("carelog") is None, "workers see the package"
        yield b
assert spark.range(4).mapInArrow(seen, "id long").count() == 4
from carelog.llm import hard_negatives, lm_score, minhash
words = [f"w{k % 13} and w{k % 7} of the same" for k in range(60)]
docs = spark.createDataFrame([(k, w * (1 + k % 3)) for k, w in enumerate(words)], "doc_id long, text string")
assert lm_score.lm_scores(docs).where("score < 0").count() == 60
assert minhash.near_duplicates(docs).count() == 60
rows = [(k, [float(k % 7) / 9, 0.5, -0.25], k % 3) for k in range(0, 200, 4)]
vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
assert hard_negatives.hard_negatives(vectors).count() > 0
print("done")
"""


def test_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT, REPO, str(tmp_path / "shared")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0 and "done" in out.stdout, out.stderr[-3000:]
