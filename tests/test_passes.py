"""Full detection passes with state, and the shape of the plans."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from palisade.operators import contain, embed, graph
from palisade.plans import detection
from palisade.plans.tables import tables
from palisade.storage import materialize, new_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def passes(spark):
    t = tables(spark, SF)
    state = new_path(spark, "passes")
    for n in range(2):
        detection.run_pass(t.tel, t.as_of_pass(2 + n), state, n, embed.formula_layers())
    return t, state


def test_second_pass_equals_the_single_tables_but_for_drift(spark, passes):
    t, state = passes
    again = detection.read_passes(spark, state, "scores").where("pass_no = 1")
    one = {(r.src, r.dst): r for r in t.scores.collect()}
    two = {(r.src, r.dst): r for r in again.collect()}
    assert one.keys() == two.keys()
    assert all(one[k].d_t == pytest.approx(two[k].d_t) and one[k].d_g == pytest.approx(two[k].d_g) for k in one)
    assert any(two[k].d_b > one[k].d_b for k in one)


def test_outputs(spark, passes):
    _, state = passes
    alerts = detection.read_passes(spark, state, "alerts")
    assert alerts.count() == 2 and alerts.select("alert_id").distinct().count() == 2
    rules, actions = (detection.read_passes(spark, state, n) for n in ("firewall_rules", "actions"))
    assert contain.rollback_rules(rules, actions).count() == 0
    checks = detection.check_drift(spark, state, F.lit(None).cast("timestamp"))
    assert checks.count() == 0


def test_rerun_of_a_pass_changes_nothing(spark, passes):
    t, state = passes
    before = sorted(map(str, detection.read_passes(spark, state, "scores").where("pass_no = 1").drop("details").collect()))
    detection.run_pass(t.tel, t.as_of_pass(3), state, 1, embed.formula_layers())
    after = sorted(map(str, detection.read_passes(spark, state, "scores").where("pass_no = 1").drop("details").collect()))
    assert before == after


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_cross_joins(spark, name):
    if name.startswith("stream_") or name == "detection_passes":
        pytest.skip("runs a job; its parts are covered by the batch queries")
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_folds_combine_before_the_shuffle_and_read_few_columns(spark):
    t = tables(spark, SF)
    text = plan(graph.fold_edges(t.tel))
    assert "partial_count" in text and "partial_max" in text
    read = re.search(r"ReadSchema: struct<([^>]*)", text).group(1)
    assert "event_id" not in read
    text = plan(graph.lookup_node(t.nodes, "db-0"))
    assert "EqualTo(node_id,db-0)" in text


def test_python_only_where_it_is_matrix_work(spark):
    t = tables(spark, SF)
    for df in (t.weighted, graph.weigh_edges(t.edges, t.windows, t.nodes), graph.pair_windows(t.tel)):
        assert "Python" not in plan(df) and "Arrow" not in plan(df)


def test_what_is_broadcast_is_judged_by_its_rows(spark):
    """A stored table whose file is below the broadcast limit, but whose rows are not, does not go through the driver (F8, F9, F15)."""
    entry.queries()["graph_stats"](spark, SF)
    rows = spark.range(1_000_000, numPartitions=1)
    side = materialize(rows.select("id", (F.col("id") % 7).alias("kind"), F.lit("workload").alias("node_type")), "side")
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    assert sum(f.stat().st_size for name in side.inputFiles() for f in [Path(name.removeprefix("file:"))]) < 10 << 20
    both = materialize(rows.unionByName(rows), "both").join(side, "id")
    assert "BroadcastHashJoin" not in both._jdf.queryExecution().sparkPlan().toString()
