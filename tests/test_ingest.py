"""Typed input, messages that are no events, repeated ids, late rows, re-runs, and sessions on other machines."""

import datetime
import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from palisade.config import DEFAULT
from palisade.operators import graph, telemetry, windows
from palisade.plans import detection
from palisade.streaming import jobs

AS_OF = "2030-01-01 00:00:00"


@pytest.fixture
def new_york(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def times(spark, raw):
    got = telemetry.normalize(raw, F.timestamp_micros(F.lit(1_893_456_000_000_000)))
    return [r["us"] for r in got.select(F.unix_micros("ts").alias("us")).collect()]


def test_points_in_time_keep_their_type(spark, new_york):
    want = 1_704_110_400_500_000
    for sql in (
        "timestamp'2024-01-01 12:00:00.5Z'", "timestamp_ntz'2024-01-01 12:00:00.5'", "1704110400.5D", "1704110400.5BD",
        "'1704110400.5'", "'1.7041104005E9'", "'2024-01-01T12:00:00.5Z'",
    ):
        raw = spark.sql(f"SELECT 'a' AS source_node, {sql} AS timestamp")
        assert times(spark, raw) == [want], sql
        assert times(spark, telemetry.union_sources(raw, raw)) == [want] * 2, sql
    assert times(spark, spark.sql("SELECT 1704110400L AS timestamp")) == [1_704_110_400_000_000]
    assert times(spark, spark.sql("SELECT date'2024-01-02' AS timestamp")) == [1_704_153_600_000_000]
    assert times(spark, spark.sql("SELECT 'NaN'::double AS timestamp")) == [1_893_456_000_000_000]


def test_whole_numbers_by_type(spark):
    as_of = F.lit(AS_OF).cast("timestamp")
    for sql, port in (("443.0D", 443), ("443.7D", 443), ("443.0BD", 443), ("443", 443), ("' 443 '", 443)):
        assert telemetry.normalize(spark.sql(f"SELECT {sql} AS dst_port"), as_of).first()["port"] == port
    for sql in ("'443.0'", "'12.5'", "'NaN'::double", "'x'"):
        raw = spark.sql(f"SELECT {sql} AS dst_port")
        assert telemetry.rejects(raw, as_of).first()["reject_reason"] == "port", sql


def test_messages_that_are_no_events(spark, tmp_path):
    texts = ["", "  ", None, "{}", "[]", "{", '{"other": 1}', '{"source_node": "a", "port": 443.0, "timestamp": 1704110400.5}',
             '{"source_node": "a", "port": "443.0"}']
    messages = spark.createDataFrame([(t,) for t in texts], "value string")
    parsed = telemetry.parse_messages(messages).collect()
    assert [r["_bad"] is None for r in parsed] == [False] * 7 + [True, True]
    raw = telemetry.parse_messages(messages).where("_bad IS NULL").drop("_bad")
    as_of = F.lit(AS_OF).cast("timestamp")
    (good,) = telemetry.normalize(raw, as_of).collect()
    assert good["port"] == 443 and good["ts"] == datetime.datetime(2024, 1, 1, 12, 0, 0, 500000)
    assert telemetry.rejects(raw, as_of).count() == 1


def test_series_with_repeated_and_empty_ids(spark):
    minute = 60_000_000
    rows = spark.createDataFrame(
        [("a", "", 0, 10), ("a", "", minute, 20), ("a", "", 2 * minute, 30), ("a", "", 2 * minute, 30), ("b", "x", 0, 1)],
        "k string, event_id string, at bigint, value bigint")
    got = windows.trailing_series(rows, ["k"], {"w": DEFAULT.current_us}).orderBy("k", "at").collect()
    assert [(r["k"], r["w_count"], r["w_mean"]) for r in got] == [("a", 1, 10.0), ("a", 2, 15.0), ("a", 4, 22.5), ("a", 4, 22.5), ("b", 1, 1.0)]


def _events(spark, rows):
    full = [(str(i), datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s), a, b, ip, "10.0.0.9", "network_flow", "TCP", 443, 1, "", "", True)
            for i, (s, a, b, ip) in enumerate(rows)]
    from palisade import schemas

    return spark.createDataFrame(full, schemas.TELEMETRY)


def test_late_rows_name_a_node_as_in_batch(spark, tmp_path):
    first, late = _events(spark, [(100, "n", "db-1", "late-ip")]), _events(spark, [(5, "n", "db-1", "early-ip")])
    for i, part in enumerate((first, late)):
        jobs._put(graph.merge_nodes(part), f"{tmp_path}/nodes", i)
    both = sorted(map(tuple, graph.merge_nodes(first.unionByName(late)).collect()))
    assert sorted(map(tuple, jobs.merged_nodes(spark, f"{tmp_path}/nodes").select(*graph.merge_nodes(first).columns).collect())) == both
    assert [r["ip_address"] for r in jobs.merged_nodes(spark, f"{tmp_path}/nodes").where("node_id = 'n'").collect()] == ["early-ip"]


def test_rows_behind_a_closed_window_are_counted_as_dropped(spark, tmp_path):
    day = 86_400
    parts = [_events(spark, [(0, "a", "b", "x"), (10 * day, "a", "b", "x")]), _events(spark, [(5, "a", "b", "x"), (10 * day + 5, "a", "b", "x")])]
    for part in parts:
        part.write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{tmp_path}/in")
        jobs.drain(jobs.sliding_counts(stream, f"{tmp_path}/out", f"{tmp_path}/ck"))
    found = jobs.sliding_balance(spark.read.parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck")
    got = [(r["arrived"], r["emitted"], r["open"], r["dropped"]) for r in found.orderBy("start").collect()]
    assert got == [(2, 1, 0, 1)] * 4 + [(2, 0, 2, 0)] * 4  # a row lies in four windows


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    part = _events(spark, [(0, "a", "b", "x"), (1, "a", "b", "x")])
    for _ in range(2):
        jobs._put(graph.fold_edges(part), f"{tmp_path}/edges", 0)
    (edge,) = jobs.merged_edges(spark, f"{tmp_path}/edges").collect()
    assert edge["event_count"] == 2


def test_a_stream_that_dies_before_its_commit_counts_once(spark, tmp_path):
    tel = _events(spark, [(0, "a", "db-1", "x"), (1, "b", "db-1", "y"), (2, "a", "db-1", "x")])
    tel.write.parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema(tel.schema).parquet(f"{tmp_path}/in")
        jobs.drain(jobs.detect_stream(stream, f"{tmp_path}/state", f"{tmp_path}/ck"))
        kept = detection.merged_tables(spark, f"{tmp_path}/state")["edges"].read()
        edges = sorted(map(tuple, kept.select("src", "dst", "event_count").collect()))
        return edges, sorted(map(str, spark.read.parquet(f"{tmp_path}/state/alerts").collect()))

    before = run()
    commits = sorted(p for p in Path(tmp_path, "ck/commits").iterdir() if p.name.isdigit())
    commits[-1].unlink()
    Path(tmp_path, "ck/commits", f".{commits[-1].name}.crc").unlink(missing_ok=True)
    assert run() == before
    assert before[0] == [("a", "db-1", 2), ("b", "db-1", 1)] and len(before[1]) == 1


def test_from_another_folder_with_a_shared_folder(tmp_path):
    """The package reaches the workers by itself, and stored tables go to spark.checkpoint.dir."""
    root = Path(__file__).resolve().parent.parent
    script = f"""
import sys, json; sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
    .config("spark.driver.bindAddress", "127.0.0.1").config("spark.driver.host", "127.0.0.1")
    .config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate())
import __spark_entry__ as entry
from palisade import storage
n = entry.queries()["embedding_drift"](spark, "/root/testdata/sf0.001").count()
storage.materialize(spark.range(3), "three")
print("DONE", json.dumps([n, storage.shared_root(spark)]))
"""
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "DONE" in done.stdout, done.stderr[-2000:]
    n, where = json.loads(done.stdout.rpartition("DONE")[2])
    assert n > 0 and where.startswith(f"file://{tmp_path}/shared")
    assert list(Path(tmp_path, "shared").rglob("three-*/*.parquet"))
