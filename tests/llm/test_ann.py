import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import ann
from palisade.llm.frames import sample
from tests.llm.conftest import SF


def brute_force(ids, x, k=20):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        scores = (x * x[i]).sum(axis=1)
        other = np.flatnonzero(ids != ids[i])
        best = other[np.lexsort((ids[other], -scores[other]))[:k]]
        out[int(ids[i])] = [(int(ids[j]), float(scores[j])) for j in best]
    return out


def check(found, wanted):
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(wanted)
    hit = total = 0
    for q, rows in got.items():
        truth = dict(wanted[q])
        assert len(rows) == len(truth) and rows == sorted(rows, key=lambda r: (-r[1], r[0]))
        assert all(abs(truth[v] - s) < 1e-12 for v, s in rows if v in truth)
        hit += len(truth.keys() & {v for v, _ in rows})
        total += len(truth)
    return hit / total


def test_recall_on_the_table(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").toArrow()
    x = np.array(vectors["embedding"].to_pylist(), float)
    assert check(ann.op7_neighbours(spark, SF).collect(), brute_force(vectors["vec_id"].to_numpy(), x)) >= 0.9


def test_clustered_vectors_need_few_probes_and_copies_are_tied_by_id(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16)) * 4
    x = centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1000:3000] = x[20]
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    usable = ann.usable(docs)
    router = ann.fit(usable)
    assert router.probes <= router.weights[-1].shape[0] // 2
    found = ann.nearest(usable, F.col("vec_id") % 20 == 0, router=router).collect()
    assert check(found, brute_force(np.arange(6000), x)) >= 0.9
    assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == 20] == list(range(1000, 1020))


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]),
            (7, [float("inf"), 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (9, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("part", F.lit("clash"))
    found = ann.nearest(ann.usable(table), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in found] == [(0, 1, 1, 1.0), (0, 2, 20, 1.0), (0, 3, 2, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 1.0), (20, 3, 2, 0.5)]
    assert ann.nearest(ann.usable(table.limit(0)), F.lit(True)).count() == 0
    assert ann.nearest(ann.usable(table.where("vec_id = 0")), F.lit(True)).count() == 0


def test_bisection_is_balanced_and_cuts_few_edges():
    graph = np.zeros((100, 100), np.float32)
    graph[:50, :50] = graph[50:, 50:] = 1
    order = np.random.default_rng(1).permutation(100)
    side = ann.bisect(graph[np.ix_(order, order)])
    assert side.sum() == 50 and len(set((order[side] < 50).tolist())) == 1


@pytest.mark.parametrize("turn", [1, -1])
def test_vectors_of_one_id_are_all_candidates(spark, turn):
    """In any order of rows: each different vector of an id is found, its own id never, the least vector asks."""
    rows = [(0, [1.0, 0.0]), (1, [0.1, 0.0]), (1, [0.9, 0.0]), (2, [0.5, 0.0]), (1, [0.9, 0.0]), (2, [0.5, -0.0])][::turn]
    vectors = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = ann.nearest(vectors, F.col("vec_id").isin(0, 1), k=5).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in found] == [
        (0, 1, 1, 0.9), (0, 2, 2, 0.5), (0, 3, 1, 0.1), (1, 1, 0, 0.1), (1, 2, 2, 0.05),
    ]


def test_samples_are_bounded(spark):
    """Copies, one id for all rows, and null ids."""
    equal = spark.range(100_000).select(F.lit(7).alias("doc_id"), F.lit("the same text").alias("text"), F.lit("en").alias("lang"))
    some = spark.range(5000).select(
        F.when(F.col("id") % 2 == 0, 7).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.when(F.col("id") % 3 == 0, "en").otherwise("fr").alias("lang")
    )
    both = equal.unionByName(some)
    assert sample(both, 800, F.col("text")).count() == 800
    assert sample(equal, 800, F.col("text")).count() == 1
    by_label = {r["lang"]: r["count"] for r in sample(both, 300, F.col("text"), "lang").groupBy("lang").count().collect()}
    assert by_label == {"en": 300, "fr": 300}
    assert sorted(map(tuple, sample(both, 9, F.col("text")).collect()), key=str) == sorted(map(tuple, sample(both.repartition(3), 9, F.col("text")).collect()), key=str)
