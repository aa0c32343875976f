"""Wall time of the headline queries. Prints one JSON line.

Every query is timed cold: the stored tables are forgotten first, so a query pays for everything it
depends on. Results are fully computed and discarded.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from palisade.plans.queries import REGISTRY  # noqa: E402
from palisade.plans.tables import forget  # noqa: E402

HEADLINE = (
    "normalize_events", "node_merge", "edge_fold", "edge_weights", "edge_weights_pit", "window_stats",
    "node_temporal_features", "rule_scores", "pagerank", "clustering_coefficient", "node_features",
    "sage_embeddings", "edge_scores", "attack_paths", "containment_rules", "alert_build",
    "embedding_drift", "drift_check", "stream_edge_state", "pagerank_bulk", "clustering_bulk",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    REGISTRY["edge_fold"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        forget()
        started = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"), "events": events,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
