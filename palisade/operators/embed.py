"""Neighbourhood-mean node embeddings and their slow-moving baseline."""

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.config import DEFAULT, Settings
from palisade.functions import vectors as V
from palisade.operators.skew import hot_keys, hubs, renamed, running, spread
from palisade.shipping import ship
from palisade.storage import materialize


@dataclass(frozen=True)
class Layer:
    """act(h . own + mean(neighbours) . peers + bias)."""

    own: np.ndarray
    peers: np.ndarray
    bias: np.ndarray
    activation: str = "tanh"


def seeded_layers(cfg: Settings = DEFAULT) -> list[Layer]:
    """Untrained float32 weights: standard normal draws times 0.01, biases 0."""
    rng = np.random.default_rng(cfg.model_seed)
    layers = []
    for wide, narrow in zip(cfg.dims, cfg.dims[1:]):
        drawn = rng.standard_normal((2 * wide, narrow)).astype(np.float32) * np.float32(0.01)
        layers.append(Layer(drawn[:wide], drawn[wide:], np.zeros(narrow, np.float32)))
    return layers


def formula_layers(cfg: Settings = DEFAULT) -> list[Layer]:
    """Closed-form float64 weights, so that plain SQL can state the same model."""
    layers = []
    for wide, narrow in zip(cfg.dims, cfg.dims[1:]):
        i, j = np.meshgrid(np.arange(2 * wide), np.arange(narrow), indexing="ij")
        w = np.sin(12.9898 * i + 78.233 * j) * 0.01
        layers.append(Layer(w[:wide], w[wide:], np.zeros(narrow)))
    return layers


def with_relu(layers: list[Layer]) -> list[Layer]:
    """ReLU between layers and a linear last one (the convolution variant)."""
    names = ["relu"] * (len(layers) - 1) + ["linear"]
    return [Layer(x.own, x.peers, x.bias, name) for x, name in zip(layers, names)]


def save_layers(spark: SparkSession, layers: list[Layer], path: str) -> None:
    """Weights as a table (layer, part, i, j, w); its size is fixed by the model's dimensions."""
    frames = []
    for n, layer in enumerate(layers):
        for part, matrix in (("own", layer.own), ("peers", layer.peers), ("bias", layer.bias[None, :])):
            i, j = np.indices(matrix.shape)
            frames.append(pd.DataFrame({
                "layer": n, "part": part, "activation": layer.activation, "dtype": str(matrix.dtype),
                "i": i.ravel(), "j": j.ravel(), "w": matrix.astype(np.float64).ravel(),
            }))
    schema = "layer int, part string, activation string, dtype string, i int, j int, w double"
    spark.createDataFrame(pd.concat(frames), schema).coalesce(1).write.parquet(path)


def load_layers(spark: SparkSession, path: str) -> list[Layer]:
    table = spark.read.parquet(path).toPandas().sort_values(["layer", "part", "i", "j"])
    layers = []
    for _, rows in table.groupby("layer"):
        def matrix(part: str) -> np.ndarray:
            r = rows[rows.part == part]
            return r.w.to_numpy().reshape(r.i.max() + 1, r.j.max() + 1).astype(r.dtype.iloc[0])

        layers.append(Layer(matrix("own"), matrix("peers"), matrix("bias")[0], rows.activation.iloc[0]))
    return layers


_ACTIVATIONS = {"tanh": np.tanh, "relu": lambda x: np.maximum(x, 0), "linear": lambda x: x}


def _rows(column, dtype) -> np.ndarray:
    return np.asarray(column.flatten()).astype(dtype, copy=False).reshape(len(column), -1)


def _dense(df: DataFrame, columns: list[str], fn: Callable, names: list[str], dtype) -> DataFrame:
    """Apply ``fn`` to Arrow batches of the array ``columns`` as matrices; one array column per name."""
    kind = "float" if dtype == np.float32 else "double"
    arrow = pa.list_(pa.float32() if dtype == np.float32 else pa.float64())

    def run(batches):
        for batch in batches:
            made = fn(*[_rows(batch.column(c), dtype) for c in columns])
            arrays = [batch.column("node_id")]
            for m in made:
                offsets = pa.array(np.arange(m.shape[0] + 1, dtype=np.int32) * m.shape[1])
                flat = pa.array(np.ascontiguousarray(m, dtype=dtype).ravel())
                arrays.append(pa.ListArray.from_arrays(offsets, flat).cast(arrow))
            yield pa.RecordBatch.from_arrays(arrays, names=["node_id", *names])

    schema = "node_id string, " + ", ".join(f"{n} array<{kind}>" for n in names)
    ship(df.sparkSession)
    return df.select("node_id", *columns).mapInArrow(run, schema)


def _project(layer: Layer) -> Callable:
    return lambda h: (h @ layer.own + layer.bias, h @ layer.peers)


def _finish_projected(layer: Layer) -> Callable:
    act = _ACTIVATIONS[layer.activation]
    return lambda base, mean: (act(base + mean),)


def _finish_raw(layer: Layer) -> Callable:
    act = _ACTIVATIONS[layer.activation]
    return lambda h, mean: (act(h @ layer.own + mean @ layer.peers + layer.bias),)


#: Edges of a bucket that counts are planned for, and edges whose vectors a task holds at once.
BUCKET, AT_ONCE = 1 << 17, 1 << 15


def _dealt(links: DataFrame, rows: int, hot: DataFrame | None) -> DataFrame:
    """Links (node_id, peer) dealt over buckets by their receiving node; those of a hot node over several."""
    salted = spread(links, ["node_id"], hot, ["peer"])
    return salted.select("node_id", "peer", F.pmod(F.xxhash64("node_id", "_salt"), F.lit(rows // BUCKET + 1)).cast("int").alias("bucket"))


def _sum_group(key, links: pa.Table, given: pa.Table) -> pa.Table:
    """Number and sum of the vectors of each node's peers, for the nodes of a bucket."""
    if not (links.num_rows and given.num_rows):
        return _SUMS.empty_table()
    peers = given["peer"].combine_chunks().dictionary_encode()
    rows = _rows(given["msg"].combine_chunks().cast(pa.list_(pa.float64())), np.float64)
    vectors = np.zeros((len(peers.dictionary), rows.shape[1]))
    np.add.at(vectors, peers.indices.to_numpy(), rows)
    held = np.bincount(peers.indices.to_numpy(), minlength=len(vectors))
    links = links.append_column("at", pc.index_in(links["peer"], value_set=peers.dictionary))
    links = links.filter(pc.and_(pc.is_valid(links["at"]), pc.is_valid(links["node_id"])))
    nodes = links["node_id"].combine_chunks().dictionary_encode()
    node, at = nodes.indices.to_numpy(), links["at"].to_numpy()
    order = np.argsort(node, kind="stable")
    node, at = node[order], at[order]
    sums = np.zeros((len(nodes.dictionary), vectors.shape[1]))
    for low in range(0, len(node), AT_ONCE):
        own = node[low : low + AT_ONCE]
        new = np.flatnonzero(np.diff(own, prepend=-1))
        sums[own[new]] += np.add.reduceat(vectors[at[low : low + AT_ONCE]], new, axis=0)
    n = np.bincount(node, weights=held[at], minlength=len(sums)).astype(np.int64)
    offsets = pa.array(np.arange(len(sums) + 1, dtype=np.int32) * sums.shape[1])
    return pa.Table.from_arrays([nodes.dictionary, pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))], schema=_SUMS)


_SUMS = pa.schema([("node_id", pa.string()), ("n", pa.int64()), ("s", pa.list_(pa.float64()))])


def _mean_over(links: DataFrame, asked: DataFrame, state: DataFrame, column: str, width: int, salted: bool) -> DataFrame:
    """Mean of a neighbour's array per receiving node. ``links``: of `_dealt`; ``asked``: the different (bucket, peer).

    A vector goes once to each bucket that has edges to it, not once to each edge, and sums are taken where the edges are.
    """
    sent = state.select(F.col("node_id").alias("peer"), F.col(column).cast("array<double>").alias("msg"))
    given = asked.join(sent, "peer").select("bucket", "peer", "msg")
    ship(state.sparkSession)
    sums = links.groupBy("bucket").cogroup(given.groupBy("bucket")).applyInArrow(_sum_group, "node_id string, n bigint, s array<double>")
    places = range(width)
    if salted:
        sums = sums.groupBy("node_id").agg(F.sum("n").alias("n"), *[F.expr(f"sum(s[{i}]) AS s{i}") for i in places])
        return sums.selectExpr("node_id", f"array({', '.join(f's{i} / n' for i in places)}) AS mean")
    return sums.select("node_id", F.transform("s", lambda x: x / F.col("n")).alias("mean"))


def embed(
    features: DataFrame, edges: DataFrame, layers: list[Layer], direction: str = "out",
    lonely: str = "own", cfg: Settings = DEFAULT,
) -> DataFrame:
    """Embedding per node. ``features``: node_id, vector.

    ``direction`` picks whose mean a node takes: its successors ("out") or predecessors ("in").
    A node without such neighbours uses its "own" vector or "zero".

    The mean commutes with the matrix product, so a layer that narrows sends already projected
    vectors: what travels along an edge is never wider than the narrower side of the layer. Each
    layer's matrix work is one Arrow pass over the nodes; each layer's state is stored.
    """
    receiver, peer = ("src", "dst") if direction == "out" else ("dst", "src")
    links = edges.select(F.col(receiver).alias("node_id"), F.col(peer).alias("peer"))
    found = hubs(edges, cfg)
    hot = renamed(getattr(found, receiver), receiver, "node_id")
    links = _dealt(links, found.rows, hot)
    asked = materialize(links.select("bucket", "peer").distinct(), "asked")
    dtype = layers[0].own.dtype
    kind = "float" if dtype == np.float32 else "double"
    state = features.select("node_id", F.col("vector").cast(f"array<{kind}>").alias("h"))
    for n, layer in enumerate(layers):
        wide, narrow = layer.own.shape
        if narrow < wide:
            sent = _dense(state, ["h"], _project(layer), ["base", "msg"], dtype)
            finish, carried, width = _finish_projected(layer), "base", narrow
        else:
            sent = state.select("node_id", "h", F.col("h").alias("msg"))
            finish, carried, width = _finish_raw(layer), "h", wide
        sent = materialize(sent, f"layer-{n}-sent")
        mean = _mean_over(links, asked, sent, "msg", width, hot is not None)
        alone = F.col("msg").cast("array<double>") if lonely == "own" else F.array_repeat(F.lit(0.0), width)
        joined = sent.join(mean, "node_id", "left").select(
            "node_id", carried, F.coalesce("mean", alone).cast(f"array<{kind}>").alias("m")
        )
        state = _dense(joined, [carried, "m"], finish, ["h"], dtype)
        if n < len(layers) - 1 and layers[n + 1].own.shape[1] >= layers[n + 1].own.shape[0]:
            state = materialize(state, f"layer-{n}")
    return state.select("node_id", F.col("h").alias("embedding"))


def update_baseline(embeddings: DataFrame, baseline: DataFrame | None, cfg: Settings = DEFAULT) -> DataFrame:
    """One detection pass: node_id, embedding, new baseline, and the distance between the two.

    A node seen for the first time stores its embedding and scores 0. Otherwise the baseline moves
    first and the distance is taken to the moved baseline.
    """
    if baseline is None:
        return embeddings.select(
            "node_id", "embedding", F.col("embedding").cast("array<double>").alias("baseline"),
            F.lit(True).alias("first_pass"), F.lit(0.0).alias("drift"),
        )
    a = cfg.embedding_alpha
    moved = F.zip_with(
        F.col("old"), F.col("embedding"), lambda b, e: b * (1 - a) + e.cast("double") * a
    )
    joined = embeddings.join(
        baseline.select("node_id", F.col("baseline").alias("old")), "node_id", "left"
    ).select(
        "node_id", "embedding",
        F.coalesce(moved, F.col("embedding").cast("array<double>")).alias("baseline"),
        F.col("old").isNull().alias("first_pass"),
    )
    drift = F.when(F.col("first_pass"), 0.0).otherwise(V.cosine_distance(F.col("embedding"), F.col("baseline")))
    return joined.withColumn("drift", drift)


def replay_baseline(history: DataFrame, cfg: Settings = DEFAULT, reset_at: Column | None = None) -> DataFrame:
    """Drift of every pass in a long history (node_id, pass, embedding), one row per input row.

    The baseline forgets geometrically: after ``reach`` passes the start weighs less than the last
    bit of a double. So each node's passes are cut into blocks of ``reach`` rows, and a block needs
    only the block before it as run-up. A Python group holds at most two blocks, however long the
    history of a node is. ``reset_at`` forgets everything before that pass.
    """
    if reset_at is not None:
        history = history.where(F.col("pass") >= reset_at)
    alpha = cfg.embedding_alpha
    reach = int(np.ceil(np.log(1e-18) / np.log(1 - alpha)))
    hot = hot_keys(history.groupBy("node_id").agg(F.count("*").alias("n")), ["node_id"], "n", cfg)
    passes = history.select("node_id", F.col("pass").cast("bigint").alias("pass"), "embedding")
    slim = passes.select("node_id", "pass")
    ranked = running(
        slim, ["node_id"], "pass", [F.col("pass")], {"rank": ("sum", F.lit(1))}, hot,
        Settings(slice_us=reach * 16, hot_share=cfg.hot_share, hot_min_rows=cfg.hot_min_rows),
    )
    block = F.floor((F.col("rank") - 1) / reach).cast("bigint")
    numbered = passes.join(ranked, ["node_id", "pass"]).withColumn("block", block)
    copies = F.array(
        F.struct(F.col("block").alias("block"), F.lit(False).alias("run_up")),
        F.struct((F.col("block") + 1).alias("block"), F.lit(True).alias("run_up")),
    )
    placed = numbered.select("node_id", "pass", "rank", "embedding", F.explode(copies).alias("c")).select(
        "node_id", "pass", "rank", "embedding", "c.*"
    )

    def drift(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        vectors = np.vstack(frame.embedding.to_numpy()).astype(np.float64)
        # moved[t] = sum over s <= t of alpha (1 - alpha)^(t - s) vectors[s], with the whole start at s = 0.
        age = np.arange(len(vectors))[:, None] - np.arange(len(vectors))[None, :]
        share = np.where(age >= 0, (1 - alpha) ** np.maximum(age, 0), 0.0)
        share[:, 1:] *= alpha
        moved = share @ vectors
        lengths = np.linalg.norm(vectors, axis=1) * np.linalg.norm(moved, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            far = np.where(lengths == 0, 0.0, (1 - (vectors * moved).sum(axis=1) / lengths) / 2)
        first = frame["rank"].to_numpy() == 1
        out = pd.DataFrame({
            "node_id": frame.node_id, "pass": frame["pass"], "first_pass": first,
            "drift": np.where(first, 0.0, far),
        })
        return out[~frame.run_up.to_numpy()]

    ship(placed.sparkSession)
    return placed.groupBy("node_id", "block").applyInPandas(
        drift, "node_id string, pass bigint, first_pass boolean, drift double"
    )
