"""The five-node graph and other cases worked out by hand."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade import schemas
from palisade.functions import scalar as X
from palisade.operators import contain, detect, drift, embed, graph, paths, soc, telemetry, windows

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def at(**delta):
    return F.lit(T0 + dt.timedelta(**delta))


def events(spark, rows):
    """rows: (source, destination, seconds after T0[, port[, bytes[, process]]])"""
    full = []
    for i, row in enumerate(rows):
        src, dst, sec, port, size, process = (*row, *(443, 1024, "")[len(row) - 3:])
        full.append((str(i), T0 + dt.timedelta(seconds=sec), src, dst, "", "", "network_flow", "TCP", port, size, "", process, True))
    return spark.createDataFrame(full, schemas.TELEMETRY)


@pytest.fixture(scope="module")
def five(spark):
    tel = events(spark, [("wl-001", "wl-002", 0), ("wl-001", "wl-003", 0), ("wl-002", "db-001", 0), ("usr-001", "wl-001", 0), ("wl-003", "db-001", 0)])
    levels = [("wl-001", "workload", 1), ("wl-002", "workload", 1), ("wl-003", "workload", 2), ("usr-001", "user", 1), ("db-001", "asset", 4)]
    nodes = spark.createDataFrame(
        [(n, k, s, s == 4, "", 0, *[T0 if s >= l else None for l in (2, 3, 4)]) for n, k, s in levels], schemas.NODES
    )
    edges = graph.fold_edges(tel)
    return tel, nodes, graph.weigh_edges(edges, graph.pair_windows(tel), nodes).cache()


def by_key(df, *keys, value):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


def test_weights(five):
    w = by_key(five[2], "src", "dst", value="weight")
    assert w[("wl-001", "wl-002")] == pytest.approx(0.775)
    assert w[("wl-001", "wl-003")] == pytest.approx(0.85)
    assert w[("wl-002", "db-001")] == pytest.approx(1.0)
    assert sum(w.values()) == pytest.approx(4.4)


def test_decay_and_prune(five):
    edges = five[2]
    before = by_key(edges, "src", "dst", value="weight")
    after = by_key(graph.decay_edges(edges, at(hours=24)), "src", "dst", value="weight")
    assert all(after[k] == pytest.approx(before[k] * 0.0907179533) for k in before)
    early = by_key(graph.decay_edges(edges, at(hours=-5)), "src", "dst", value="weight")
    assert early == before
    assert [graph.stale_edges(edges, at(days=d)).count() for d in (1, 7, 8)] == [0, 0, 5]
    assert graph.prune_edges(edges, at(days=8)).count() == 0


def test_sensitive_and_lookups(five):
    _, nodes, edges = five
    assert [r.node_id for r in graph.sensitive_nodes(nodes).collect()] == ["db-001"]
    assert {r.node_id for r in graph.successors(edges, "wl-001").collect()} == {"wl-002", "wl-003"}
    assert {r.node_id for r in graph.predecessors(edges, "db-001").collect()} == {"wl-002", "wl-003"}
    assert graph.lookup_edge(edges, "db-001", "wl-001").count() == 0
    assert graph.lookup_node(nodes, "nobody").count() == 0


def test_path_and_containment(spark, five):
    _, nodes, edges = five
    starts = spark.createDataFrame([("wl-001",)], "node_id string")
    found = paths.attack_paths(edges, starts, nodes).cache()
    (p,) = found.collect()
    assert p.nodes == ["wl-001", "wl-003", "db-001"] and p.hop_count == 2
    assert p.probability == pytest.approx(0.85) and p.impact_score == pytest.approx(1.2)
    assert p.risk_score == pytest.approx(1.02) and p.risk_class == "AUTO_ISOLATE"
    assert p.undetected_probability == pytest.approx(0.0121)
    actions = contain.containment_actions(found, edges, at(hours=1)).cache()
    (a,) = actions.collect()
    assert a.business_impact == pytest.approx(1.85 / 4.4)
    assert a.action_type == "MANUAL_REVIEW" and not a.auto_applied and a.applied_at is None
    rules = contain.firewall_rules(found, starts, actions).cache()
    got = {(r.source, r.destination, r.priority) for r in rules.collect()}
    assert got == {("wl-001", "ANY", 10), ("wl-001", "wl-003", 20), ("wl-003", "db-001", 20)}
    assert {r.expires_at - r.created_at for r in rules.collect()} == {dt.timedelta(hours=24)}
    assert rules.first().reason.endswith("(risk=1.02)")
    assert contain.active_rules(rules, at(hours=24)).count() == 3
    assert contain.active_rules(rules, at(hours=25)).count() == 0
    assert contain.rollback_rules(rules, actions.select("action_id")).count() == 0
    assert contain.applied_rules(rules, actions).count() == 0


def test_business_impact_ignores_unknown_edges(spark, five):
    blocked = spark.createDataFrame([("wl-003", "db-001"), ("no", "edge")], "src string, dst string")
    assert contain.business_impact(blocked, five[2]).first().impact == pytest.approx(1 / 4.4)


def test_new_edge_rules(five):
    _, nodes, edges = five
    fresh = by_key(detect.rule_scores(edges, nodes, at(seconds=60)), "src", "dst", value="rule_score")
    assert fresh[("wl-002", "db-001")] == pytest.approx(0.7375)
    assert fresh[("wl-001", "wl-002")] == pytest.approx(0.196667, abs=1e-6)
    old = detect.rule_scores(edges, nodes, at(hours=2)).collect()
    assert not any(r.rule_triggered.startswith("R1") for r in old)


def test_tool_port_and_spike_rules(spark):
    tel = events(spark, [
        ("wl-1", "wl-2", 0, 443, 1, "c:/PsExec.exe"), ("wl-1", "wl-3", 0, 3389), ("wl-1", "wl-3", 1, 22),
        ("wl-1", "wl-4", 0, 22), ("wl-1", "wl-4", 1, 22), ("wl-1", "wl-4", 2, 22), ("db-1", "wl-3", 0, 22),
    ])
    edges, nodes = graph.fold_edges(tel), graph.merge_nodes(tel)
    base = spark.createDataFrame([("wl-1", 1.0)], "src string, baseline double")
    got = by_key(detect.rule_scores(edges, nodes, at(hours=2), base), "src", "dst", value="rule_triggered")
    assert got == {
        ("wl-1", "wl-2"): "R2:lateral_movement_tool", ("wl-1", "wl-3"): "R3:admin_port_22",
        ("wl-1", "wl-4"): "R4:degree_spike", ("db-1", "wl-3"): "",
    }


def test_degree_baseline_matches_edge_by_edge_updates(spark):
    rng = np.random.default_rng(3)
    baseline, slow = None, {}
    for _ in range(5):
        degrees = {f"s{i}": int(rng.integers(1, 9)) for i in range(6) if rng.random() < 0.8}
        rows = [(s, f"d{j}", d, bool(rng.random() < 0.7)) for s, d in degrees.items() for j in range(d)]
        fired = {}
        for s, _, d, reached in rows:
            if reached:
                b = slow.get(s, float(d))
                if b > 0 and d > 2.5 * b:
                    fired[s] = True
                else:
                    slow[s] = 0.9 * b + 0.1 * d
        scored = spark.createDataFrame(rows, "src string, dst string, out_degree bigint, reached_spike_rule boolean")
        state = detect.degree_pass(scored, baseline).collect()
        assert {r.src: r.baseline for r in state if r.baseline is not None} == pytest.approx(slow)
        assert all(r.spike for r in state if r.src in fired)
        kept = [(r.src, r.baseline) for r in state if r.baseline is not None]
        baseline = spark.createDataFrame(kept, "src string, baseline double")


def test_steady_edges(spark):
    every_minute = [("a", "b", 60 * i) for i in range(1440)]
    every_five = [("a", "c", 300 * i) for i in range(288)]
    w = graph.pair_windows(events(spark, every_minute + every_five))
    rows = {r.dst: r for r in w.collect()}
    assert (rows["b"].current_count, rows["b"].short_count) == (6, 1440)
    assert (rows["c"].current_count, rows["c"].short_count) == (2, 288)
    dev = by_key(graph.temporal_deviation(w), "dst", value="deviation")
    assert dev[("b",)] == pytest.approx(0.2) and dev[("c",)] == 1.0


def test_window_edge_self_loop_and_disorder(spark):
    tel = events(spark, [("a", "b", 300, 443, 30), ("a", "b", 0, 443, 10), ("x", "x", 5, 5432, 7)])
    rows = {(r.src, r.dst): r for r in graph.pair_windows(tel).collect()}
    assert rows[("a", "b")].current_count == 2 and rows[("a", "b")].current_mean == 20.0
    assert ("x", "x") in rows
    assert graph.fold_edges(tel).count() == 1
    act = {r.node_id: r for r in graph.node_windows(tel).collect()}
    assert act["x"].activity_count == 2 and act["x"].activity_std == 0.0
    assert act["a"].activity_std == pytest.approx(math.sqrt(200))
    nodes = {r.node_id: r for r in graph.merge_nodes(tel).collect()}
    assert nodes["x"].node_type == "workload" and nodes["x"].sensitivity == 4 and nodes["x"].is_critical
    assert nodes["x"].event_count == 0 and nodes["a"].event_count == 2


def test_sensitivity_only_rises_and_dates_back(spark):
    tel = events(spark, [("a", "wl-x", 0), ("b", "wl-x", 10, 22), ("a", "wl-y", 20), ("c", "wl-x", 30, 5432), ("c", "wl-x", 40)])
    nodes = graph.merge_nodes(tel)
    x = nodes.where("node_id = 'wl-x'").first()
    assert (x.node_type, x.sensitivity, x.since_3, x.since_4) == (
        "workload", 4, T0 + dt.timedelta(seconds=10), T0 + dt.timedelta(seconds=30)
    )
    w = graph.weigh_edges(graph.fold_edges(tel), graph.pair_windows(tel), nodes)
    s = by_key(w, "src", "dst", value="sensitivity_score")
    assert s[("a", "wl-x")] == 0.25 and s[("b", "wl-x")] == 0.75 and s[("c", "wl-x")] == 1.0


def test_point_in_time_frequency(spark):
    tel = events(spark, [("a", "b", 0), ("a", "b", 1), ("a", "c", 2), ("a", "b", 3), ("a", "b", 4)])
    got = by_key(graph.point_in_time_frequency(tel, graph.fold_edges(tel)), "dst", value="frequency_score")
    assert got == {("b",): 1.0, ("c",): 0.5}


def test_normalize(spark):
    raw = spark.createDataFrame(
        [
            ("1", "2024-01-01T12:00:00Z", "wl-1", None, "db-1", "tcp", "5432", "8192", "PSEXEC", "True"),
            ("2", "2024-1-1T1:2:3.5Z", "", "10.0.0.1", "", "UDP", None, None, None, "false"),
            ("3", "1704110400", "a", None, "b", None, "x", "1", None, None),
            ("4", "2024-01-01 12:00:00", "a", None, "b", None, "1", "1.5", None, None),
            ("5", "nonsense", "a", None, "b", None, " 7 ", "-1", None, "0"),
            ("6", "2024-13-01T12:00:00Z", "a", None, "b", None, None, None, None, ""),
            ("7", "1704110400.25", "a", None, "b", None, None, None, None, "denied"),
        ],
        "event_id string, timestamp string, source_node string, src_ip string, dst_node string, protocol string, "
        "port string, bytes string, process_name string, result string",
    )
    now = F.lit(dt.datetime(2030, 1, 1))
    good = {r.event_id: r for r in telemetry.normalize(raw, now).collect()}
    assert set(good) == {"1", "2", "5", "6", "7"}
    one = good["1"]
    assert (one.ts, one.protocol, one.port, one.bytes_transferred, one.process) == (T0, "TCP", 5432, 8192, "psexec")
    assert (good["2"].source_node, good["2"].destination_node, good["2"].source_ip) == ("10.0.0.1", "unknown-destination", "10.0.0.1")
    assert good["2"].ts == dt.datetime(2024, 1, 1, 1, 2, 3, 500000)
    assert good["5"].ts == good["6"].ts == dt.datetime(2030, 1, 1) and good["5"].port == 7
    assert good["7"].ts == T0 + dt.timedelta(milliseconds=250)
    assert {k: r.success for k, r in good.items()} == {"1": True, "2": False, "5": False, "6": False, "7": True}
    assert {r.event_id: r.reject_reason for r in telemetry.rejects(raw, now).collect()} == {"3": "port", "4": "bytes_transferred"}


def test_suspicious_process(spark):
    df = spark.createDataFrame([("psexec",), ("chrome",), ("bash",), ("psexec.exe",)], "process string")
    assert [r.process for r in df.where(X.is_suspicious_process(F.col("process"))).collect()] == ["psexec", "bash"]


def test_classes_and_severity(spark):
    df = spark.createDataFrame([(x,) for x in (0.9, 0.8, 0.65, 0.5, 0.21, 0.1)], "r double")
    got = [(r.c, r.s) for r in df.select(X.risk_class(F.col("r")).alias("c"), X.severity(F.col("r")).alias("s")).collect()]
    assert got == [
        ("AUTO_ISOLATE", "CRITICAL"), ("SOC_ALERT", "HIGH"), ("SOC_ALERT", "HIGH"), ("MONITOR", "MEDIUM"),
        ("MONITOR", "MEDIUM"), ("MONITOR", "LOW"),
    ]


def test_compromised(spark):
    shape = "src string, dst string, total_score double, is_flagged boolean"
    low = spark.createDataFrame([("b", "x", 0.8, True), ("a", "z", 0.8, True), ("c", "x", 0.5, False)], shape)
    assert [r.node_id for r in detect.compromised_nodes(low).collect()] == ["a"]
    high = spark.createDataFrame([("b", "x", 0.9, True), ("b", "y", 0.88, True), ("a", "z", 0.8, True), ("c", "q", 0.86, True)], shape)
    assert {r.node_id for r in detect.compromised_nodes(high).collect()} == {"b", "c"}
    assert detect.compromised_nodes(low.where("not is_flagged")).count() == 0


def test_psi(spark):
    same = [("s", e, float(v)) for v in range(500) for e in (True, False)]
    constant = [("c", e, 3.0) for _ in range(50) for e in (True, False)]
    outside = [("o", True, float(v)) for v in range(100)] + [("o", False, v + 1000.0) for v in range(100)]
    missing = [("m", True, float(v)) for v in range(30)]
    df = spark.createDataFrame(same + constant + outside + missing, "feature string, expected boolean, v double")
    got = by_key(drift.psi(df), "feature", value="psi")
    assert got[("s",)] == pytest.approx(0, abs=1e-12) and got[("c",)] == pytest.approx(0, abs=1e-12)
    assert got[("o",)] == pytest.approx(11.5128, abs=1e-3) and got[("m",)] == 0.0


def test_psi_matches_numpy(spark):
    rng = np.random.default_rng(5)
    e, a = np.round(rng.lognormal(0, 2, 3000), 1), np.round(rng.lognormal(0.5, 2, 2000), 1)
    cuts = np.percentile(e, np.linspace(0, 100, 11))
    cuts[0] -= 1e-9
    cuts[-1] += 1e-9
    p, q = np.histogram(e, cuts)[0] / len(e), np.histogram(a, cuts)[0] / len(a)
    p, q = np.where(p == 0, 1e-6, p), np.where(q == 0, 1e-6, q)
    df = spark.createDataFrame([("f", True, float(x)) for x in e] + [("f", False, float(x)) for x in a], "feature string, expected boolean, v double")
    assert drift.psi(df).first().psi == pytest.approx(float(((q - p) * np.log(q / p)).sum()))


def test_drift_gates(spark):
    rows = [(T0 - dt.timedelta(days=d), [float(d)], [1.0], [float(d % 3)]) for d in range(15) for _ in range(2)]
    h = spark.createDataFrame(rows, "ts timestamp, behavioral array<double>, temporal array<double>, structural array<double>")
    got = {r.feature_group: r.status for r in drift.drift_check(h, at()).collect()}
    assert got["behavioral"] == "drift" and got["temporal"] == "stable"
    assert drift.drift_check(h.limit(10), at()).count() == 0
    assert drift.drift_check(h, at(), last_check=at(days=-6, hours=-23)).count() == 0
    assert drift.drift_check(h, at(), last_check=at(days=-7)).count() == 3
    assert drift.drift_check(h, at(days=60)).count() == 0
    checks = drift.drift_check(h, at())
    summary = by_key(drift.psi_summary(checks.where("feature_group <> 'structural'")), "feature_group", value="psi")
    assert summary[("structural",)] == 0.0 and summary[("behavioral",)] > 0.25
    for days, ready in ((6, False), (7, True)):
        s = drift.shadow_status(checks, at(days=days)).first()
        assert s.in_shadow_mode and s.can_promote == ready
    promoted = spark.createDataFrame([(T0 + dt.timedelta(days=7),)], "ts timestamp")
    s = drift.shadow_status(checks, at(days=9), promoted).first()
    assert not s.in_shadow_mode and not s.can_promote


def test_tactics_order_and_default(spark):
    tel = events(spark, [("a", "b", 5, 1, 1, "rdp"), ("a", "b", 3, 1, 1, "powershell"), ("q", "r", 0, 1, 1, "ssh")])
    hit = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert soc.tactics(tel, hit).first().tactics == [
        "TA0002 Execution", "T1059.001 PowerShell", "TA0008 Lateral Movement", "T1021.001 Remote Desktop Protocol",
    ]
    none = spark.createDataFrame([("z", "z")], "src string, dst string")
    assert soc.tactics(tel, none).first().tactics == ["TA0008 Lateral Movement", "T1021 Remote Services"]


def test_alert_without_paths(spark):
    scores = spark.createDataFrame([("a", "b", 0.8, "R2:lateral_movement_tool", True)], "src string, dst string, total_score double, rule_triggered string, is_flagged boolean")
    empty = spark.createDataFrame([], "source string, target string, nodes array<string>, path_id string, hop_count int, risk_score double, risk_class string, edges array<struct<src:string,dst:string>>")
    weights = spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, weight double")
    actions = contain.containment_actions(empty, weights, at())
    rules = contain.firewall_rules(empty, spark.createDataFrame([("a",)], "node_id string"), actions)
    (a,) = soc.build_alert(scores, empty, actions, rules, events(spark, [("a", "b", 0)]), at()).collect()
    assert a.severity == "LOW" and a.containment is None and a.attack_paths == []
    assert a.description == "GNN anomaly detector flagged 1 suspicious edges."
    assert a.recommended_actions[0] == "Initiate manual incident response process." and len(a.recommended_actions) == 3


def test_alert_pages_hold_every_node(spark):
    from palisade.config import Settings
    from palisade.plans.tables import tables
    import json

    t = tables(spark, "/root/testdata/sf0.001")
    nodes = soc.alert_nodes(t.scores).withColumn("alert_id", t.alert.select("alert_id").scalar())
    sent = [json.loads(r.value) for r in soc.alert_messages(t.alert, nodes, Settings(nodes_per_page=10)).collect()]
    assert len(sent) == sent[0]["pages"] > 1
    assert sorted(n for m in sent for n in m["compromised_nodes"]) == sorted(r.node_id for r in nodes.collect())


def test_baseline_steps_match_replay(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(6, 4))
    rows = [("n", i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    history = spark.createDataFrame(rows, "node_id string, pass bigint, embedding array<double>")
    replay = {r["pass"]: r.drift for r in embed.replay_baseline(history).collect()}
    state = None
    for i in range(6):
        state = embed.update_baseline(history.where(F.col("pass") == i).select("node_id", "embedding"), state)
        assert state.first().drift == pytest.approx(replay[i])
    assert replay[0] == 0.0


def test_long_replay_is_cut_into_blocks(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(3000, 3)) + 1
    history = spark.createDataFrame(
        [("n", i, [float(x) for x in v]) for i, v in enumerate(vectors)], "node_id string, pass bigint, embedding array<double>"
    )
    got = {r["pass"]: r.drift for r in embed.replay_baseline(history).collect()}
    b = vectors[0]
    for i, v in enumerate(vectors):
        if i:
            b = 0.95 * b + 0.05 * v
            want = (1 - v @ b / np.linalg.norm(v) / np.linalg.norm(b)) / 2
            assert got[i] == pytest.approx(want, abs=1e-12)


def test_series_with_equal_times(spark):
    tel = events(spark, [("a", "b", 0, 1, 4), ("a", "b", 60, 1, 8), ("a", "b", 60, 1, 6), ("a", "b", 361, 1, 1)])
    rows = tel.select(F.col("source_node").alias("k"), "event_id", X.micros("ts").alias("at"), F.col("bytes_transferred").alias("value"))
    got = {r.event_id: r for r in windows.trailing_series(rows, ["k"], {"w": 300_000_000}).collect()}
    assert [got[i].w_count for i in "0123"] == [1, 3, 3, 1]
    assert got["1"].w_mean == 6.0 and got["1"].w_std == pytest.approx(2.0) and got["0"].w_std == 0.0
