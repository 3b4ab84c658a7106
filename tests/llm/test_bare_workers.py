"""Operators on executors that have no copy of the package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
JOB = """
import sys
sys.path.insert(0, {root!r})  # the driver's path only
from pyspark.sql import functions as F
from widesift.session import build_session
spark = build_session("bare", "local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": {folder!r}, "spark.ui.showConsoleProgress": "false"}})
try:
    spark.range(1).select(F.udf(lambda i: __import__("widesift").__name__)("id")).collect()
    sys.exit("the workers can import the package, so that this shows nothing")
except Exception as error:
    assert "No module named" in str(error)
from widesift.llm import catalog
for name in {names!r}:
    rows = catalog.QUERIES[name](spark, {folder!r} + "/in").collect()
    print(name, len(rows))
"""
NAMES = ["op1_packing", "op2_token_counts", "op3_vectors", "op8_language", "op9_contamination", "op10_simhash", "op11_lines", "op12_spelling", "op13_whitening"]


def test_workers_without_the_package(spark, tmp_path):
    texts = [f"house tree words again {i % 7} " * 4 for i in range(30)]
    spark.createDataFrame([(i, t, "en" if i % 2 else "de") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/in/documents.parquet")
    spark.createDataFrame([(1, texts[0])], "item_id long, text string").write.parquet(f"{tmp_path}/in/benchmark.parquet")
    spark.createDataFrame([(i, [1.0, i * 0.1, 0.5 - i % 3], i % 2) for i in range(20)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/in/embeddings.parquet")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", JOB.format(root=ROOT, folder=str(tmp_path), names=NAMES)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    found = dict(line.split() for line in done.stdout.splitlines() if line.startswith("op"))
    assert list(found) == NAMES and found["op8_language"] == "30" and found["op13_whitening"] != "0"
