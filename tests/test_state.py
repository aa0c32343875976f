"""Merged state, time cells, and passes over increments."""

import re

import pytest
from pyspark.sql import functions as F

from palisade import state as S
from palisade.config import DAY_US, HOUR_US, MINUTE_US
from palisade.operators import embed, graph, panes, windows
from palisade.plans import detection
from palisade.plans.tables import tables
from palisade.storage import new_path

SF = "/root/testdata/sf0.001"


def total(parts):
    return parts.groupBy("k").agg(F.sum("n").alias("n"))


def merged(spark):
    return S.Merged(spark, new_path(spark, "merged"), ["k"], total)


def content(df):
    return sorted(map(tuple, df.collect()))


def test_batches_add_up_and_levels_stay_small(spark):
    table, wanted = merged(spark), {}
    for batch in range(20):
        rows = [(f"k{i}", batch) for i in range(batch % 5 + 1)]
        for k, n in rows:
            wanted[k] = wanted.get(k, 0) + n
        table.add(spark.createDataFrame(rows, "k string, n long"), batch)
        parts = table.manifest()["parts"]
        assert all(sum(p["level"] == level for p in parts) < S.FAN for level in range(4))
        assert len(S.listed(spark, f"{table.path}/parts")) <= 2 * S.FAN * 3
    assert content(table.read()) == sorted(wanted.items())
    some = spark.createDataFrame([("k1",), ("k4",), ("none",)], "k string")
    assert content(table.read(some)) == [(k, wanted[k]) for k in ("k1", "k4")]


def test_a_batch_that_runs_again_counts_once(spark, monkeypatch):
    table = merged(spark)
    for batch in range(3):
        table.add(spark.createDataFrame([("a", 10**batch)], "k string, n long"), batch)
    assert content(table.read()) == [("a", 111)]
    table.add(spark.createDataFrame([("a", 500)], "k string, n long"), 2)
    assert content(table.read()) == [("a", 511)]
    # A batch killed between its files and its manifest, here one that also folds a level, leaves the table as it was.
    monkeypatch.setattr(S, "write_text", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        table.add(spark.createDataFrame([("a", 7000)], "k string, n long"), 3)
    assert content(table.read()) == [("a", 511)]
    monkeypatch.undo()
    table.add(spark.createDataFrame([("a", 7000)], "k string, n long"), 3)
    assert content(table.read()) == [("a", 7511)]
    assert len(S.listed(spark, f"{table.path}/parts")) == 4  # three old parts for a re-run, and the folded one


@pytest.mark.parametrize("last", [0, 1, MINUTE_US, HOUR_US, 3 * DAY_US + 17, 3 * DAY_US + HOUR_US])
def test_cells_give_the_windows_of_rows(spark, last):
    """Windows that begin on and beside full minutes and hours, before and after 1970."""
    spans = {"current": 5 * MINUTE_US, "short": DAY_US, "long": 7 * DAY_US}
    edges = [0, 1, 59, MINUTE_US - 1, MINUTE_US, MINUTE_US + 1, HOUR_US, HOUR_US + 1, *spans.values()]
    ats = {last - span - d for span in spans.values() for d in edges} | {last - span + d for span in spans.values() for d in edges} | {last}
    rows = [(k, f"e{i}", at, (i * 7919) % 1000 - 300) for k in ("a", "b") for i, at in enumerate(sorted(ats)) if at <= last and (k == "a" or i % 3)]
    df = spark.createDataFrame(rows + [("c", "only", last, 5)], "k string, event_id string, at long, value long")
    kept = panes.merge(panes.cells(df.where("value < 300"), ["k"]).unionByName(panes.cells(df.where("value >= 300"), ["k"])), ["k"])
    found = panes.from_cells(kept, df, ["k"], spans, deviation=True)
    wanted = windows.trailing_at_last(df, ["k"], spans, deviation=True)
    for a, b in zip(content(found.select(wanted.columns)), content(wanted), strict=True):
        assert a == pytest.approx(b)


@pytest.fixture(scope="module")
def increments(spark):
    """Three increments, the second with late rows, against passes over everything."""
    t = tables(spark, SF)
    state, whole = new_path(spark, "increments"), new_path(spark, "whole")
    late = F.pmod(F.xxhash64("event_id"), F.lit(9)) == 0
    slices = [
        t.tel.where((F.col("ts") <= t.as_of_pass(2)) & ~late),
        t.tel.where((F.col("ts") > t.as_of_pass(2)) | late),
        t.tel.where("false"),
    ]
    layers = embed.formula_layers()
    for n, rows in enumerate(slices):
        detection.run_increment(rows, state, n, layers, as_of=None if n < 2 else t.as_of + F.make_dt_interval(hours=F.lit(3)))
    detection.run_pass(slices[0], slices[0].agg(F.max("ts")).scalar(), whole, 0, layers)
    detection.run_pass(t.tel, t.as_of, whole, 1, layers)
    detection.run_pass(t.tel, t.as_of + F.make_dt_interval(hours=F.lit(3)), whole, 2, layers)
    return t, state, whole


def rounded(df):
    """Rows as text, with six places of every fraction."""
    places = lambda m: f"{float(m.group()):.6f}"
    return sorted(re.sub(r"\d+\.\d+(e-\d+)?", places, str(r)) for r in df.select(sorted(df.columns)).collect())


@pytest.mark.parametrize("name", ["nodes", "edges", "rules", "degree_baseline", "compromised", "paths", "actions", "firewall_rules", "alerts", "alert_nodes"])
def test_increments_equal_whole_passes(spark, increments, name):
    _, state, whole = increments
    a, b = (detection.read_passes(spark, where, name) for where in (state, whole))
    assert rounded(a.select(b.columns)) == rounded(b)


def test_scores_of_increments(spark, increments):
    _, state, whole = increments
    key = ["pass_no", "src", "dst"]
    a, b = (detection.read_passes(spark, where, "scores").select(*key, "d_b", "d_t", "d_g", "total_score") for where in (state, whole))
    assert a.count() == b.count() == a.join(b, key).count()
    both = a.join(b.withColumnsRenamed({c: f"w_{c}" for c in ("d_b", "d_t", "d_g", "total_score")}), key)
    for c in ("d_b", "d_t", "d_g", "total_score"):
        assert both.agg(F.max(F.abs(F.col(c) - F.col(f"w_{c}")))).first()[0] < 1e-6


def test_an_increment_that_runs_again_changes_nothing(spark, increments):
    t, state, _ = increments
    before = rounded(detection.read_passes(spark, state, "edges").where("pass_no = 2"))
    detection.run_increment(t.tel.where("false"), state, 2, embed.formula_layers(), as_of=t.as_of + F.make_dt_interval(hours=F.lit(3)))
    assert rounded(detection.read_passes(spark, state, "edges").where("pass_no = 2")) == before


def test_decisions_are_stored(spark, increments):
    t, state, _ = increments
    alert = detection.alerts(spark, state).first().alert_id
    for _ in range(2):
        detection.acknowledge(spark, state, alert)
    seen = {r.alert_id: r.acknowledged for r in detection.alerts(spark, state).collect()}
    assert seen[alert] and sum(seen.values()) == 1
    action = detection.actions(spark, state).first().action_id
    detection.roll_back(spark, state, action)
    done = {r.action_id: r.rollback_applied for r in detection.actions(spark, state).collect()}
    assert done[action] and sum(done.values()) == 1
    assert detection.rules_in_force(spark, state, t.as_of).where(F.col("action_id") == action).count() == 0


def test_drift_checks_of_passes_are_gated_and_start_shadow_mode(spark):
    t = tables(spark, SF)
    state = new_path(spark, "drifting")
    day = lambda n: t.as_of + F.make_dt_interval(days=F.lit(n))
    shifted = t.history_shifted
    for n, at in enumerate((0, 3, 8)):
        shifted.write.mode("overwrite").parquet(f"{state}/score_history/pass_no={n}")
        detection._check_drift_once_due(spark, day(at), state, n, detection.DEFAULT)
    checks = detection.read_passes(spark, state, "drift_checks")
    assert {r.pass_no for r in checks.collect()} <= {0, 2} and checks.where("pass_no = 0").count() == 3
    assert "pass_no=1" not in S.listed(spark, f"{state}/drift_checks") and "pass_no=2" in S.listed(spark, f"{state}/drift_checks")
    assert detection.shadow(spark, state, day(1)).first().in_shadow_mode
    detection.promote(spark, state, day(20))
    assert not detection.shadow(spark, state, day(21)).first().in_shadow_mode


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_each_fold_moves_rows_once(spark):
    """Cells, merged edges and the read of a single part need no second pass over their rows (F2 to F6)."""
    rows = spark.createDataFrame([("a", "b", i * 7_000_000, i) for i in range(50)], "src string, dst string, at long, value long")
    found = panes.cells(rows, ["src", "dst"])
    assert exchanges(found) == 1 and found.count() == 6
    part = graph.fold_edges(tables(spark, SF).tel).localCheckpoint()
    twice = graph.merge_edges(part.unionByName(part))
    assert exchanges(twice) == 1
    lists = lambda df: sorted((r.src, r.dst, tuple(r.protocols)) for r in df.collect())
    assert lists(twice) == lists(part)
    empty = part.limit(1).withColumn("protocols", F.array().cast("array<string>"))
    assert graph.merge_edges(empty).first().protocols == []
    table = merged(spark)
    table.add(spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long"), 0)
    assert exchanges(table.read()) == 0 and content(table.read()) == [("a", 1), ("b", 2)]
