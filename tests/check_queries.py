"""python tests/check_queries.py [sf_dir] [name ...]: compare every registered query with its SQL."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tests.compare import connect, differences  # noqa: E402

if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con, sqls, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        started, n = time.time(), -1
        try:
            df = fn(spark, sf_dir)
            n = df.count()
            problems = differences(df, con, sqls[name]) if name in sqls else []
        except Exception as e:  # noqa: BLE001
            problems = [f"{type(e).__name__}: {str(e)[:700]}"]
        bad += bool(problems)
        kind = "" if name in sqls else "(rows only)"
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - started:.1f}s {n} rows {kind}", *problems, sep="\n     ", flush=True)
    print("failures:", bad)
