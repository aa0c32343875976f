"""What an action shuffled does not outlive it where a session asks for that."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

SCRIPT = """
import sys
from pathlib import Path
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from palisade.storage import free_shuffles, materialize

top = sys.argv[1]
spark = SparkSession.builder.master("local[2]").config(map={
    "spark.ui.enabled": "false", "spark.local.dir": f"{top}/local", "spark.checkpoint.dir": f"{top}/kept", "spark.driver.host": "127.0.0.1",
    "spark.driver.bindAddress": "127.0.0.1", "spark.sql.shuffle.partitions": "4"}).getOrCreate()
left = lambda: len([*Path(f"{top}/local").rglob("shuffle_*.data")])
free_shuffles(spark)
counted = spark.range(10000).groupBy((F.col("id") % 97).alias("k")).agg(F.count("*").alias("n"))
stored = materialize(counted.repartition(3, "n"), "counted")
print("left", left(), stored.count(), len(counted.collect()), len(counted.collect()), left())
"""


def test_shuffles_go_with_their_action(tmp_path):
    """The shuffles of stored steps do not lie on the disk together (F1, F5); an action may still be run twice."""
    run = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], cwd=ROOT, capture_output=True, text=True, timeout=180)
    assert run.stdout.split()[-6:] == ["left", "0", "97", "97", "97", "0"], run.stderr[-2000:]
