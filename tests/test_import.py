"""The entry module imports anywhere, and model calls run where the workers lack this package."""

import os
import subprocess
import sys

from pyspark.ml.feature import StopWordsRemover

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import glob, importlib.util, sys
glob.glob = lambda *a, **k: []          # no jar folder to be found
spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1] + "/__spark_entry__.py")
e = importlib.util.module_from_spec(spec)
spec.loader.exec_module(e)
assert len(e.oracle_sql()) > 50
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
rows = e.queries()["batch_inference"](spark, "/root/testdata/sf0.001").collect()
assert rows, "no rows"
print("ok", len(rows))
"""


def test_stop_words_are_sparks(spark):
    from threadmill.operators.topics import ENGLISH_STOP_WORDS
    assert list(ENGLISH_STOP_WORDS) == StopWordsRemover.loadDefaultStopWords("english")


def test_entry_runs_in_an_empty_folder(scratch):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS")}
    run = subprocess.run([sys.executable, "-c", SCRIPT, ROOT], cwd=scratch, env=env,
                         capture_output=True, text=True, timeout=300)
    assert run.returncode == 0 and "ok" in run.stdout, run.stderr[-3000:]
