"""With every key treated as hot, results must not change; brute-force checks of the iterative jobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.config import DEFAULT, Settings
from palisade.operators import centrality, detect, embed, graph, paths, windows
from palisade.operators.skew import hot_keys
from palisade.plans.tables import tables

HOT = Settings(hot_min_rows=2, slice_us=3_600_000_000)


@pytest.fixture(scope="module")
def t(spark):
    return tables(spark, "/root/testdata/sf0.001")


def rows(df):
    return sorted(map(str, df.select(*[F.round(c, 9).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes]).collect()))


def test_hot_list_is_bounded(spark):
    counts = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") + 1).alias("n"))
    hot = hot_keys(counts, ["k"], "n", Settings(hot_share=20, hot_min_rows=1))
    assert hot is None
    powers = spark.range(40).select(F.col("id").alias("k"), F.pow(F.lit(1.3), "id").cast("bigint").alias("n"))
    assert 0 < hot_keys(powers, ["k"], "n", Settings(hot_share=20, hot_min_rows=1)).count() < 20
    skewed = spark.createDataFrame([("a", 600), ("b", 2), ("c", 2)], "k string, n bigint")
    (row,) = hot_keys(skewed, ["k"], "n", Settings(hot_share=10, hot_min_rows=100)).collect()
    assert row.k == "a" and row._parts == 6


def test_no_hot_keys(spark):
    counts = spark.createDataFrame([("a", 600)], "k string, n bigint")
    assert hot_keys(counts, ["k"], "n") is None
    assert hot_keys(counts, ["k"], "n", Settings(hot_min_rows=100), rows=100) is None
    assert hot_keys(counts, ["k"], "n", Settings(hot_min_rows=100), rows=600) is not None


def test_windows(t):
    assert rows(graph.pair_windows(t.tel, HOT)) == rows(t.windows)
    assert rows(graph.node_windows(t.tel, HOT)) == rows(graph.node_windows(t.tel))


def test_series(t):
    r = t.tel.select(F.col("source_node").alias("k"), "event_id", F.unix_micros("ts").alias("at"), F.col("bytes_transferred").alias("value"))
    spans = {"a": DEFAULT.current_us, "b": DEFAULT.short_us, "c": DEFAULT.long_us}
    assert rows(windows.trailing_series(r, ["k"], spans, HOT)) == rows(windows.trailing_series(r, ["k"], spans))


def test_weights_rules_scores(t):
    assert rows(graph.weigh_edges(t.edges, t.windows, t.nodes, HOT)) == rows(t.weighted)
    assert rows(graph.point_in_time_frequency(t.tel, t.edges, HOT)) == rows(graph.point_in_time_frequency(t.tel, t.edges))
    assert rows(detect.rule_scores(t.edges, t.nodes, t.as_of, None, HOT)) == rows(detect.rule_scores(t.edges, t.nodes, t.as_of))
    first = embed.update_baseline(t.embeddings, None)
    args = (t.weighted, t.nodes, t.windows, t.rules, first, t.as_of)
    assert rows(detect.score_edges(*args, HOT).drop("details")) == rows(t.scores.drop("details"))


def test_pagerank_and_clustering(t):
    a, b = centrality.pagerank(t.nodes, t.edges, HOT), centrality.pagerank(t.nodes, t.edges)
    assert rows(a) == rows(b)
    assert rows(centrality.clustering(t.nodes, t.edges, HOT)) == rows(centrality.clustering(t.nodes, t.edges))


def test_pagerank_that_does_not_settle(t):
    got = centrality.pagerank(t.nodes, t.edges, Settings(rank_rounds=1))
    assert got.where("pagerank <> 0 or converged").count() == 0 and got.count() == t.nodes.count()


def test_paths_against_best_first_search(t):
    """Best-first search with a heap, one settled entry per (node, hop)."""
    import heapq

    out = {}
    for r in t.live.collect():
        out.setdefault(r.src, []).append((r.dst, r.weight))
    nodes = {r.node_id: r for r in t.nodes.collect()}
    want = set()
    for start in (r.node_id for r in t.starts.collect()):
        heap, settled = [(-1.0, 0, start, (start,))], set()
        while heap:
            neg, hop, node, path = heapq.heappop(heap)
            if (node, hop) in settled:
                continue
            settled.add((node, hop))
            if hop and nodes[node].sensitivity >= 3:
                want.add((start, node, hop, ">".join(path), round(-neg, 9)))
            if hop < 5:
                for nxt, w in out.get(node, []):
                    if nxt not in path and -neg * w >= 0.001:
                        heapq.heappush(heap, (neg * w, hop + 1, nxt, (*path, nxt)))
    for cfg in (DEFAULT, HOT):
        got = paths.attack_paths(t.live, t.starts, t.nodes, cfg)
        assert {(r.source, r.target, r.hop_count, ">".join(r.nodes), round(r.probability, 9)) for r in got.collect()} == want
    assert want


def dense(features, edges, layers, direction, lonely):
    ids = sorted(features)
    at = {n: i for i, n in enumerate(ids)}
    h = np.array([features[n] for n in ids], layers[0].own.dtype)
    near = {}
    for s, d in edges:
        a, b = (s, d) if direction == "out" else (d, s)
        near.setdefault(at[a], []).append(at[b])
    act = {"tanh": np.tanh, "relu": lambda x: np.maximum(x, 0), "linear": lambda x: x}
    for layer in layers:
        mean = h.copy() if lonely == "own" else np.zeros_like(h)
        for i, peers in near.items():
            mean[i] = h[peers].mean(axis=0)
        h = act[layer.activation](h @ layer.own + mean @ layer.peers + layer.bias)
    return {n: h[at[n]] for n in ids}


@pytest.mark.parametrize("direction, lonely, relu", [("out", "own", False), ("in", "zero", True)])
def test_embeddings_against_dense_matrices(spark, t, direction, lonely, relu, tmp_path):
    layers = embed.with_relu(embed.seeded_layers()) if relu else embed.seeded_layers()
    embed.save_layers(spark, layers, str(tmp_path / "w"))
    layers = embed.load_layers(spark, str(tmp_path / "w"))
    assert all(x.own.dtype == np.float32 for x in layers)
    features = {r.node_id: r.vector for r in t.features.collect()}
    want = dense(features, [(r.src, r.dst) for r in t.edges.collect()], layers, direction, lonely)
    for cfg in (DEFAULT, HOT):
        got = embed.embed(t.features, t.edges, layers, direction, lonely, cfg).collect()
        assert len(got) == len(want)
        for r in got:
            np.testing.assert_allclose(r.embedding, want[r.node_id], atol=1e-4, rtol=1e-3)


def test_weights_survive_storage(spark, tmp_path):
    made = embed.seeded_layers()
    embed.save_layers(spark, made, str(tmp_path / "w"))
    for a, b in zip(made, embed.load_layers(spark, str(tmp_path / "w"))):
        assert (a.own == b.own).all() and (a.peers == b.peers).all() and (a.bias == b.bias).all()
    assert made[0].own.shape == (64, 128) and made[2].peers.shape == (64, 32)


def test_replay_when_hot(t, spark):
    h = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(
        F.col("label").cast("string").alias("node_id"), F.col("vec_id").alias("pass"), "embedding"
    )
    assert rows(embed.replay_baseline(h, HOT)) == rows(embed.replay_baseline(h))


def test_materialize_uses_the_shared_folder(spark, tmp_path):
    from palisade import storage

    assert storage.shared_root(spark)
    df, path = storage.store(spark.range(3), "tiny")
    assert df.count() == 3 and path.startswith(storage.shared_root(spark))
    storage.discard(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path)
    with pytest.raises(ValueError):
        storage.discard(spark, str(tmp_path))


def test_clustering_sends_numbers_of_edges_that_go_on(spark, monkeypatch):
    """Only numbers travel along edges, and nothing for an edge whose higher end has no list (F1)."""
    stored = {}
    keep = centrality.materialize
    monkeypatch.setattr(centrality, "materialize", lambda df, name: stored.setdefault(name, keep(df, name)))
    named = lambda i: f"{'n' * 200}{i:03d}"
    pairs = {(a, b) for a in range(40) for b in range(40) if (a * 7 + b * 3) % 5 == 0 and a != b}
    edges = spark.createDataFrame([(named(a), named(b)) for a, b in sorted(pairs)], "src string, dst string")
    nodes = spark.createDataFrame([(named(a),) for a in range(41)], "node_id string")
    found = {r["node_id"]: (r["triangles"], r["clustering"]) for r in centrality.clustering(nodes, edges).collect()}
    linked = {frozenset(p) for p in pairs}
    for a in range(41):
        near = [b for b in range(40) if frozenset((a, b)) in linked]
        closed = sum(frozenset((b, c)) in linked for b in near for c in near if b < c)
        n = len(near)
        assert found[named(a)] == (closed, pytest.approx(2 * closed / (n * (n - 1)) if n > 1 else 0.0))
    assert stored["above"].schema["above"].dataType.simpleString() == "array<bigint>"
    assert stored["above"].where(F.exists(F.transform("above", lambda x: x), lambda x: x < F.col("lo"))).isEmpty()
