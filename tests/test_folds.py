"""What a detection run folds once and reads from there: last events of pairs, deviations, lengths of embeddings."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from palisade import schemas
from palisade.functions import vectors as V
from palisade.operators import detect, embed, graph

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


@pytest.fixture(scope="module")
def tel(spark):
    ends = [
        ("a", "b", 0, "TCP"), ("a", "b", 400, "UDP"), ("a", "b", 400, ""), ("a", "b", 400, None), ("a", "b", None, "TCP"), ("b", "a", 3, "TCP"),
        ("x", "x", 5, "TCP"), ("x", "x", 90_000, "TCP"), (None, "b", 7, "TCP"), ("a", None, 8, "TCP"), (None, None, 9, "TCP"), ("n", "b", None, "TCP"),
    ]
    rows = [
        (str(i), None if sec is None else T0 + dt.timedelta(seconds=sec), src, dst, "", "", "network_flow", protocol, 443, 10 + i, "", "", True)
        for i, (src, dst, sec, protocol) in enumerate(ends)
    ]
    return spark.createDataFrame(rows, schemas.TELEMETRY)


def rows(df):
    return sorted(map(str, df.collect()))


def test_windows_take_the_last_events_from_the_pairs(spark, tel, monkeypatch):
    """The rows of the pairs are not folded a second time to find them (F20)."""
    pairs = graph.fold_pairs(tel).localCheckpoint()
    wanted = rows(graph.pair_windows(tel))
    assert len(wanted) == 3

    def refuse(*_):
        raise AssertionError("folded again")

    monkeypatch.setattr("palisade.operators.windows.materialize", refuse)
    assert rows(graph.pair_windows(tel, pairs=pairs)) == wanted


def test_edges_are_pairs_without_loops(tel):
    found = {(r.src, r.dst): r for r in graph.fold_pairs(tel).collect()}
    assert found.keys() == {("a", "b"), ("b", "a"), ("x", "x"), ("n", "b")}
    assert found["a", "b"].protocols == ["TCP", "UDP"] and found["a", "b"].event_count == 5
    assert rows(graph.fold_edges(tel)) == sorted(str(r) for k, r in found.items() if k != ("x", "x"))


def test_scores_of_weighed_edges_need_no_windows(spark, tel):
    """Deviations are in the weighed edges; without them the windows are read, with the same result (F22)."""
    edges, nodes, windows = graph.fold_edges(tel).localCheckpoint(), graph.merge_nodes(tel).localCheckpoint(), graph.pair_windows(tel).localCheckpoint()
    weighed = graph.weigh_edges(edges, windows, nodes).localCheckpoint()
    as_of = F.lit(T0 + dt.timedelta(days=1))
    vectors = spark.createDataFrame([("a", [1.0, 0.5]), ("b", [0.25, -1.0]), ("n", [0.0, 0.0])], "node_id string, embedding array<double>")
    first = embed.update_baseline(vectors, None)
    rules = detect.rule_scores(weighed, nodes, as_of)
    slow = detect.score_edges(edges, nodes, windows, rules, first, as_of)
    assert rows(detect.score_edges(weighed, nodes, None, rules, first, as_of)) == rows(slow)
    assert {r.src: r.d_g for r in slow.collect()}["n"] == 0.0


def test_given_lengths_change_no_distance(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, -4.5]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = df.select(V.cosine_distance(a, b).alias("x"), V.cosine_distance(a, b, V.length(a), V.length(b)).alias("y")).collect()
    assert all(r.x == r.y for r in got) and got[1].x == 0.0 and got[2].x is None
