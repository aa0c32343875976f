"""What a graph operator moves and keeps: lists within reach of each other, a vector once per bucket, no consumed tables."""

from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.config import DEFAULT, SPLIT
from palisade.operators import centrality, embed
from palisade.storage import shared_root


@pytest.fixture(scope="module")
def graph(spark):
    rng = np.random.default_rng(3)
    pairs = {(f"n{a}", f"n{b}") for a, b in rng.integers(0, 40, (260, 2))} | {("n0", f"n{k}") for k in range(1, 30)}
    edges = spark.createDataFrame(sorted(pairs), "src string, dst string").localCheckpoint()
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct().localCheckpoint()
    return nodes, edges, sorted(pairs)


@pytest.mark.parametrize("cfg", [DEFAULT, SPLIT])
def test_clustering_drops_what_it_has_used(spark, graph, cfg):
    """Undirected and oriented edges are deleted once the lists are stored (F5); triangles are those of plain search."""
    nodes, edges, pairs = graph
    kept = lambda: sum(len([*Path(shared_root(spark)).glob(f"{n}-*")]) for n in ("undirected", "oriented"))
    before = kept()
    found = {r.node_id: r.triangles for r in centrality.clustering(nodes, edges, cfg).collect()}
    assert kept() == before
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    assert found == {n: sum(b in near[a] for a, b in combinations(near.get(n, ()), 2)) for n in found}


@pytest.mark.parametrize("cfg", [DEFAULT, SPLIT])
def test_a_vector_goes_once_to_a_bucket(spark, cfg, monkeypatch):
    """A thousand nodes that share two peers do not send a vector each (F2 to F4, F6 to F10); means are those of plain search."""
    links = [(f"a{i}", f"p{i % 2}") for i in range(1000)] + [("a0", "p1"), ("a0", "gone"), ("x", "gone"), *(("hub", f"a{i}") for i in range(300))]
    edges = spark.createDataFrame(links, "src string, dst string").localCheckpoint()
    rng = np.random.default_rng(5)
    ids = sorted({n for e in links for n in e} - {"gone"})
    vectors = dict(zip(ids, rng.normal(size=(len(ids), 4))))
    features = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in vectors.items()], "node_id string, vector array<double>")
    stored = {}
    old = embed.materialize

    def watch(df, name):
        stored[name] = old(df, name)
        return stored[name]

    monkeypatch.setattr(embed, "materialize", watch)
    one = embed.Layer(np.eye(4), 2 * np.eye(4), np.zeros(4), "linear")
    got = {r.node_id: r.embedding for r in embed.embed(features, edges, [one], lonely="zero", cfg=cfg).collect()}
    assert got.keys() == vectors.keys()
    for n, v in vectors.items():
        peers = [vectors[b] for a, b in links if a == n and b in vectors]
        assert got[n] == pytest.approx(v + 2 * (np.mean(peers, axis=0) if peers else 0))
    assert stored["asked"].where("peer in ('p0', 'p1')").count() == 2
