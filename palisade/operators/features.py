"""The 64 values per node: 24 behavioural, 16 temporal, 16 structural, 8 type."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.config import DEFAULT, Settings
from palisade.functions import scalar as X
from palisade.functions import vectors as V
from palisade.operators.centrality import clustering, pagerank
from palisade.operators.skew import hubs
from palisade.storage import materialize, together

BEHAVIORAL = (
    "out_degree", "in_degree", "peers_out", "peers_in", "max_out_weight", "mean_out_weight",
    "max_in_weight", "mean_in_weight", "out_megabytes", "in_megabytes", "protocol_count",
)
WIDTHS = {"behavioral": 24, "temporal": 16, "structural": 16, "node_type_enc": 8}


def _padded(values: list[Column], width: int) -> Column:
    cells = [v.cast("double") for v in values] + [F.lit(0.0)] * (width - len(values))
    return F.array(*cells)


def behavioral(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degrees, peers, weights, traffic and protocol variety, as named columns."""
    out = edges.groupBy(F.col("src").alias("node_id")).agg(
        F.count("*").alias("out_degree"),
        F.max("weight").alias("max_out_weight"),
        F.avg("weight").alias("mean_out_weight"),
        (F.sum("bytes_total") / 1e6).alias("out_megabytes"),
    )
    back = edges.groupBy(F.col("dst").alias("node_id")).agg(
        F.count("*").alias("in_degree"),
        F.max("weight").alias("max_in_weight"),
        F.avg("weight").alias("mean_in_weight"),
        (F.sum("bytes_total") / 1e6).alias("in_megabytes"),
    )
    variety = (
        edges.select(F.col("src").alias("node_id"), F.explode("protocols").alias("protocol"))
        .distinct()
        .groupBy("node_id")
        .agg(F.count("*").alias("protocol_count"))
    )
    joined = nodes.select("node_id")
    for side in (out, back, variety):
        joined = joined.join(side, "node_id", "left")
    joined = joined.withColumns({"peers_out": F.col("out_degree"), "peers_in": F.col("in_degree")})
    return joined.select(
        "node_id", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in BEHAVIORAL]
    )


def type_encoding(nodes: DataFrame) -> DataFrame:
    kinds = [(F.col("node_type") == k).cast("double") for k in ("workload", "user", "asset")]
    level = F.col("sensitivity") / F.lit(4.0)
    cells = [*kinds, level, F.col("is_critical").cast("double")]
    return nodes.select("node_id", _padded(cells, WIDTHS["node_type_enc"]).alias("node_type_enc"))


def structural(nodes: DataFrame, edges: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """PageRank, clustering, and both degrees as a share of the node count."""
    total = nodes.agg(F.greatest(F.count("*"), F.lit(1))).scalar()
    out = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("o"))
    back = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("i"))
    ranks, closure = together(lambda: pagerank(nodes, edges, cfg), lambda: clustering(nodes, edges, cfg))
    return (
        ranks.join(closure, "node_id")
        .join(out, "node_id", "left")
        .join(back, "node_id", "left")
        .select(
            "node_id",
            "pagerank",
            "clustering",
            (F.coalesce("o", F.lit(0)) / total).alias("out_share"),
            (F.coalesce("i", F.lit(0)) / total).alias("in_share"),
            "converged",
        )
    )


def assemble(
    nodes: DataFrame, edges: DataFrame, activity: DataFrame, as_of: Column, cfg: Settings = DEFAULT
) -> DataFrame:
    """All four blocks and the 64-wide vector. ``activity`` is the output of `node_windows`.

    The blocks that aggregate edges or rows are stored first, at the same time: joined in one stage, the buffers of all
    their aggregations and sorts would be held by each of its tasks at once.
    """
    hubs(edges, cfg)  # two of the builds below read them
    conduct, shape_of, active = together(
        lambda: materialize(behavioral(nodes, edges), "behavioral"),
        lambda: materialize(structural(nodes, edges, cfg), "structural"),
        lambda: materialize(activity, "activity"),
    )
    act = ["activity_count", "activity_rate", "activity_mean", "activity_std"]
    frame = (
        conduct
        .join(shape_of, "node_id")
        .join(active, "node_id", "left")
        .join(type_encoding(nodes), "node_id")
    )
    temporal = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in act] + X.time_encoding(as_of)
    shape = [F.col(c) for c in ("pagerank", "clustering", "out_share", "in_share")]
    blocks = frame.select(
        "node_id",
        _padded([F.col(c) for c in BEHAVIORAL], WIDTHS["behavioral"]).alias("behavioral"),
        _padded(temporal, WIDTHS["temporal"]).alias("temporal"),
        _padded(shape, WIDTHS["structural"]).alias("structural"),
        "node_type_enc",
    )
    return blocks.withColumn("vector", V.finite(F.concat(*WIDTHS)))
