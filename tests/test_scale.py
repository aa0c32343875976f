"""Plans and table forms that keep large graphs within limits."""

import threading

import pytest
from pyspark import StorageLevel
from pyspark.sql import functions as F

from palisade.config import DEFAULT, Settings
from palisade.operators import centrality, features, graph
from palisade.operators.skew import hubs, renamed
from palisade.plans.tables import PASSES, Tables


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("cfg", [DEFAULT, Settings(hot_min_rows=20)])
def test_a_round_of_pagerank_moves_no_edges(spark, no_broadcast, cfg):
    edges = spark.range(600).select(
        F.concat(F.lit("n"), F.col("id") % 7).alias("src"), F.concat(F.lit("m"), F.col("id") % 90).alias("dst")
    ).distinct().localCheckpoint()
    hot = renamed(hubs(edges, cfg).src, "src", "node_id")
    assert (hot is None) == (cfg == DEFAULT)
    links = centrality._links(edges, hot).persist(StorageLevel.MEMORY_AND_DISK)
    ranks = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("out_degree"), F.lit(1.0).alias("rank")).localCheckpoint()
    found = centrality._inflow(ranks, links, hot)
    got = {r.node_id: r.inflow for r in found.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()  # the final one
    above = plan.split("InMemoryTableScan")[0].splitlines()
    join = next(i for i, line in enumerate(above) if "SortMergeJoin" in line)
    assert not [line for line in above[join:] if "Exchange" in line or "Sort [" in line], plan
    shares = {r.node_id: r.rank / r.out_degree for r in ranks.collect()}
    want = {}
    for r in edges.collect():
        want[r.dst] = want.get(r.dst, 0.0) + shares[r.src]
    links.unpersist()
    assert got == pytest.approx(want)


def test_bulk_edges_with_null_and_repeated_keys(spark, tmp_path):
    spark.createDataFrame([(1, 7), (1, 7), (2, None), (None, 9)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(
        [(1, 3, 5), (1, 3, 5), (1, None, 5), (2, 3, 5), (2, 3, None), (2, None, None), (None, 1, 1)],
        "l_orderkey bigint, l_suppkey bigint, l_partkey bigint",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(map(tuple, Tables(spark, str(tmp_path)).bulk_edges.collect()), key=str)
    want = {
        ("c-7", "s-3"), ("s-3", "p-5"), ("c-7", "p-5"), ("c-7", None), (None, "p-5"), (None, "s-3"), ("s-3", None), (None, None),
    }
    assert got == sorted(want, key=str)


def test_features_are_assembled_from_stored_blocks(spark, no_broadcast):
    """The last stage only joins; its tasks hold no buffers of the aggregations over edges and rows."""
    t = Tables(spark, "/root/testdata/sf0.001")
    activity = graph.node_windows(t.tel)
    made = features.assemble(t.nodes, t.weighted, activity, t.as_of)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan, plan
    assert made.count() == t.nodes.count()


def test_folds_of_passes_run_at_the_same_time(spark, monkeypatch):
    """The rule passes wait for each other, their folds do not: each waits here until all have begun."""
    began = threading.Barrier(PASSES)

    def fold(seen):
        began.wait(60)
        return fold_edges(seen)

    fold_edges = graph.fold_edges
    monkeypatch.setattr(graph, "fold_edges", fold)
    t = Tables(spark, "/root/testdata/sf0.001")
    assert t.pass_scores.select("as_of").distinct().count() == PASSES
