"""Approximate nearest neighbours by learned partitions.

On a bounded sample (``SAMPLE`` distinct vectors, chosen by their hash) the graph of nearest neighbours is cut into
balanced parts by repeated bisection. A small neural network then learns to tell from a vector in which parts its
neighbours lie. It puts every row into its most probable part, and sends a query to its several most probable parts,
where inner products with all rows are taken on the original vectors. How many parts a query visits is set on the
sample: the fewest that reach ``RECALL`` there. A sample is thinner than the table, so its neighbours are farther away
and the table's recall is higher.

Parts are searched as blocks: a slice of the rows of a part against a block of its queries, both of bounded size, so a
part in which one vector is repeated a million times is only more slices.

Cases: vectors that are null, zero, or hold a null or non-finite number take no part, nor do those without an id or of
another length than most; rows of one id and one vector count once; of one id, each different vector is a candidate of
its own, the least one (component by component) asks, and none of them is found by it; a query meets every candidate if
there are fewer than ``k`` in its parts; equal scores go to the smaller id; a table without vectors gives no rows.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.frames import Batches, map_batches, sample, store, table

SAMPLE = 4096
PARTS = 32
NEIGHBOURS = 10
RECALL = 0.95
HIDDEN = 128
K = 20
#: Queries of a block, and least and most rows of a slice.
QUERIES, LEAST_ROWS, MOST_ROWS = 2048, 2048, 20_000


def usable(vectors: DataFrame, id_name: str = "vec_id", name: str = "embedding") -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    picked = vectors.select(F.col(id_name).cast("long").alias("vec_id"), F.col(name).cast("array<double>").alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    lengths = picked.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").first()
    return picked.where(F.size("vector") == (lengths["length"] if lengths else 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def distinct_rows(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Numbers of rows, one of each id and vector, by id."""
    order = np.argsort(ids, kind="stable")
    if not np.any(ids[order][1:] == ids[order][:-1]):
        return order
    rows = np.concatenate([ids[:, None].view(np.uint8), np.ascontiguousarray(x + 0.0).view(np.uint8)], axis=1)  # 0.0: one zero
    first = np.unique(rows, axis=0, return_index=True)[1]
    return first[np.argsort(ids[first], kind="stable")]


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the ``k`` rows of largest inner product with each row, itself left out."""
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for at in range(0, len(x), 512):
        scores = x[at : at + 512] @ x.T
        scores[np.arange(len(scores)), at + np.arange(len(scores))] = -np.inf
        out[at : at + 512] = np.argpartition(-scores, out.shape[1] - 1, axis=1)[:, : out.shape[1]] if out.shape[1] else 0
    return out


def bisect(graph: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Halves of equal size with few edges between them: the second eigenvector cut at its median, then better swaps."""
    degree = graph.sum(axis=1) + 1e-9
    root = np.sqrt(degree)
    first = root / np.linalg.norm(root)
    v = np.random.default_rng(5).normal(size=len(graph))
    for _ in range(rounds):
        v -= first * (first @ v)
        v = v + (graph @ (v / root)) / root
        v /= np.linalg.norm(v) + 1e-300
    side = np.zeros(len(graph), bool)
    side[np.argsort(v / root, kind="stable")[len(graph) // 2 :]] = True
    for _ in range(20):
        across = graph @ side
        gain = np.where(side, degree - 2 * across, 2 * across - degree)
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        n = min(len(left), len(right))
        better = np.flatnonzero(gain[left[:n]] + gain[right[:n]] > 0)[: max(1, n // 20)]
        if not len(better):
            break
        trial = side.copy()
        trial[left[better]], trial[right[better]] = True, False
        if trial @ (graph @ ~trial) >= side @ (graph @ ~side):
            break
        side = trial
    return side


def balanced_parts(x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part of each row, and for each row the share of its neighbours (and itself) in each part."""
    near = neighbours(x, NEIGHBOURS)
    graph = np.zeros((len(x), len(x)), np.float32)
    graph[np.arange(len(x))[:, None], near] = 1
    graph = np.maximum(graph, graph.T)
    part = np.zeros(len(x), np.int64)
    n = 1
    while n < parts:
        for p in range(n):
            own = np.flatnonzero(part == p)
            if len(own) > 1:
                part[own[bisect(graph[np.ix_(own, own)])]] = p + n
        n *= 2
    target = np.zeros((len(x), n))
    np.add.at(target, (np.arange(len(x)), part), 1.0)
    for column in near.T:
        np.add.at(target, (np.arange(len(x)), part[column]), 1.0)
    return part, target / target.sum(axis=1, keepdims=True)


class Router(NamedTuple):
    scale: float
    weights: list[np.ndarray]
    probes: int

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        z = np.maximum(x / self.scale @ a + b, 0) @ c + d
        return z - z.max(axis=1, keepdims=True)


def train_router(x: np.ndarray, target: np.ndarray, epochs: int = 40, rate: float = 2e-3) -> Router:
    """One hidden layer, soft targets, Adam."""
    random = np.random.default_rng(6)
    scale = float(np.sqrt((x * x).mean())) or 1.0
    size = [x.shape[1], HIDDEN, target.shape[1]]
    w = [random.normal(0, np.sqrt(2 / size[0]), (size[0], size[1])), np.zeros(size[1]),
         random.normal(0, np.sqrt(1 / size[1]), (size[1], size[2])), np.zeros(size[2])]
    m, s, t = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w], 0
    for epoch in range(epochs):
        order = random.permutation(len(x))
        for at in range(0, len(x), 128):
            own = order[at : at + 128]
            h = np.maximum(x[own] / scale @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            g = (p / p.sum(axis=1, keepdims=True) - target[own]) / len(own)
            back = (g @ w[2].T) * (h > 0)
            t += 1
            for i, grad in enumerate((x[own].T / scale @ back, back.sum(axis=0), h.T @ g, g.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * grad
                s[i] = 0.999 * s[i] + 0.001 * grad * grad
                w[i] -= rate * (1 - epoch / epochs) * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
    return Router(scale, w, target.shape[1])


def fit(vectors: DataFrame, rows: int = SAMPLE, parts: int = PARTS, recall: float = RECALL, k: int = K) -> Router | None:
    """A router with the fewest probes that reach ``recall`` on the sample."""
    found = sample(vectors, rows, F.col("vector")).select("vector").toArrow()
    x = np.unique(matrix(found["vector"]), axis=0) if found.num_rows else np.zeros((0, 0))
    if not len(x):
        return None
    parts = max(1, min(parts, 1 << int(np.log2(max(1, len(x) // 32)))))
    part, target = balanced_parts(x, parts)
    router = train_router(x, target)
    order = np.argsort(-router.log_probabilities(x), axis=1, kind="stable")
    home = order[:, 0]
    near = neighbours(x, k)
    if not near.shape[1]:
        return router
    rank = np.empty_like(order)
    rank[np.arange(len(x))[:, None], order] = np.arange(order.shape[1])
    needed = rank[np.arange(len(x))[:, None], home[near]]  # a neighbour is found if so many parts are visited
    share = np.cumsum(np.bincount(needed.ravel(), minlength=order.shape[1])) / needed.size
    return router._replace(probes=int(np.searchsorted(share, recall)) + 1)


def nearest(vectors: DataFrame, queries: Column, k: int = K, router: Router | None = None) -> DataFrame:
    """The ``k`` nearest rows of each row that ``queries`` selects: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    router = router or fit(vectors, k=k)
    schema = "query_id long, rank int, vec_id long, score double"
    if router is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(router)

    def route(batches: Batches) -> Batches:
        for batch in batches:
            # Copies that meet in a batch go no further, so a row in countless copies does not fill its slice.
            batch = batch.take(pa.array(np.sort(distinct_rows(batch.column("vec_id").to_numpy(), matrix(batch.column("vector"))))))
            order = np.argsort(-shared.value.log_probabilities(matrix(batch.column("vector"))), axis=1, kind="stable").astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array(order[:, 0]),
                pa.FixedSizeListArray.from_arrays(pa.array(order.ravel()), order.shape[1]).cast(pa.list_(pa.int32())),
            ], [*batch.schema.names, "part", "order"])

    routed = store(map_batches(
        vectors.withColumn("asks", queries), route, "vec_id long, vector array<double>, asks boolean, part int, order array<int>"
    ), "ann-routed")
    parts = router.weights[-1].shape[0]
    sizes = [0] * parts
    for r in routed.groupBy("part").count().collect():  # a row per part
        sizes[r["part"]] = r["count"]
    slice_rows = min(MOST_ROWS, max(LEAST_ROWS, sum(sizes) // 256))
    slices = F.array(*[F.lit(max(1, -(-n // slice_rows))) for n in sizes])
    # Parts in order of probability, until there are enough parts and, in them, enough candidates.
    filled = F.aggregate(
        "order", F.struct(F.array().cast("array<int>").alias("parts"), F.lit(0).cast("long").alias("rows")),
        lambda acc, p: F.when(
            (F.size(acc["parts"]) >= router.probes) & (acc["rows"] > 4 * k), acc
        ).otherwise(F.struct(
            F.concat(acc["parts"], F.array(p)).alias("parts"),
            (acc["rows"] + F.get(F.array(*[F.lit(n).cast("long") for n in sizes]), p)).alias("rows"),
        )),
    )["parts"]
    asking = routed.where("asks").groupBy("vec_id").agg(F.min(F.struct("vector", "order")).alias("q")).select("vec_id", "q.*")
    asking = store(asking.select("vec_id", "vector", filled.alias("parts")), "ann-asking")
    asked = asking.select("vec_id", "vector", F.explode("parts").alias("part"))
    asked_sizes = [0] * parts
    for r in asked.groupBy("part").count().collect():
        asked_sizes[r["part"]] = r["count"]
    blocks = F.array(*[F.lit(max(1, -(-n // QUERIES))) for n in asked_sizes])
    spot = lambda sizes, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.get(sizes, F.col("part"))).cast("int")
    every = lambda sizes: F.explode(F.sequence(F.lit(0), F.get(sizes, F.col("part")) - 1))
    left = asked.select("part", every(slices).alias("slice"), spot(blocks, "block").alias("block"), "vec_id", "vector")
    right = routed.select("part", spot(slices, "slice").alias("slice"), every(blocks).alias("block"), "vec_id", "vector")

    def search(asking: pa.Table, rows: pa.Table) -> pa.Table:
        out = [], [], []
        if asking.num_rows and rows.num_rows:
            ids, x = rows["vec_id"].to_numpy(), matrix(rows["vector"])
            own = distinct_rows(ids, x)
            ids, x = ids[own], x[own]
            query_ids, q = asking["vec_id"].to_numpy(), matrix(asking["vector"])
            for at in range(0, len(q), 256):
                rough = q[at : at + 256] @ x.T
                for i, scores in enumerate(rough):
                    scores = np.where(ids == query_ids[at + i], -np.inf, scores)
                    keep = min(k, len(ids))
                    edge = -np.partition(-scores, keep - 1)[keep - 1]
                    # Rounding of the block product must not decide ties: near the edge all are taken and summed alike.
                    near = np.flatnonzero((scores >= edge - 1e-9 * (1 + abs(edge))) & (scores > -np.inf))
                    exact = (x[near] * q[at + i]).sum(axis=1)
                    best = np.lexsort((ids[near], -exact))[:k]
                    out[0].append(np.full(len(best), query_ids[at + i]))
                    out[1].append(ids[near[best]])
                    out[2].append(exact[best])
        join = lambda lists, kind: np.concatenate(lists) if lists else np.zeros(0, kind)
        return pa.table({"query_id": join(out[0], np.int64), "vec_id": join(out[1], np.int64), "score": join(out[2], float)})

    at = ["part", "slice", "block"]
    found = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(usable(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)
