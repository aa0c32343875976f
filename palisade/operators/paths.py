"""Attack paths: best-first search from compromised nodes, one hop per round."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.config import DEFAULT, Settings
from palisade.functions import scalar as X
from palisade.operators.graph import sensitive_nodes
from palisade.operators.skew import hubs, replicate, spread
from palisade.storage import materialize


def attack_paths(
    edges: DataFrame, starts: DataFrame, nodes: DataFrame, cfg: Settings = DEFAULT, weight: str = "weight"
) -> DataFrame:
    """The best path per (start, node, hop) that ends at a sensitive node.

    Weights are at most 1, so best-first order settles every (node, hop) with the highest
    probability and, among equals, the smallest path. Hop h + 1 depends only on the winners of hop
    h: a join with the edges and a min per (start, node), which combines map-side. Each hop's
    winners are stored. Edges of hot sources are salted by their target.
    """
    hot = hubs(edges, cfg).src
    links = materialize(
        spread(
            edges.select("src", "dst", F.coalesce(F.col(weight), F.lit(cfg.default_weight)).alias("w")),
            ["src"], hot, ["dst"],
        ),
        "links",
    )
    frontier = starts.select(
        F.col("node_id").alias("start"),
        F.col("node_id").alias("node"),
        F.lit(1.0).alias("probability"),
        F.array("node_id").alias("nodes"),
    )
    found = None
    for hop in range(1, cfg.max_hops + 1):
        reached = (
            replicate(frontier.withColumnRenamed("node", "src"), ["src"], hot)
            .join(links, ["src", "_salt"])
            .where(~F.array_contains("nodes", F.col("dst")))
            .withColumn("p", F.col("probability") * F.col("w"))
            .where(F.col("p") >= cfg.min_probability)
            .select(
                "start", F.col("dst").alias("node"), (-F.col("p")).alias("neg"),
                F.concat("nodes", F.array("dst")).alias("nodes"),
            )
        )
        best = reached.groupBy("start", "node").agg(F.min(F.struct("neg", "nodes")).alias("b"))
        frontier = materialize(
            best.select("start", "node", (-F.col("b.neg")).alias("probability"), F.col("b.nodes").alias("nodes")),
            f"hop-{hop}",
        )
        level = frontier.withColumn("hop_count", F.lit(hop))
        found = level if found is None else found.unionByName(level)
    return _rate(found, nodes, cfg)


def _rate(found: DataFrame, nodes: DataFrame, cfg: Settings) -> DataFrame:
    assets = sensitive_nodes(nodes).select(
        F.col("node_id").alias("node"),
        X.impact(F.col("sensitivity"), F.col("is_critical")).alias("impact_score"),
    )
    steps = F.zip_with(
        F.slice("nodes", F.lit(1), F.col("hop_count")),
        F.slice("nodes", F.lit(2), F.col("hop_count")),
        lambda a, b: F.struct(a.alias("src"), b.alias("dst")),
    )
    risk = F.col("probability") * F.col("impact_score")
    return found.join(assets, "node").select(
        X.natural_id(F.array_join("nodes", ">")).alias("path_id"),
        F.col("start").alias("source"),
        F.col("node").alias("target"),
        "nodes",
        steps.alias("edges"),
        "hop_count",
        "probability",
        "impact_score",
        risk.alias("risk_score"),
        X.risk_class(risk, cfg).alias("risk_class"),
        X.undetected_probability(F.col("hop_count"), cfg).alias("undetected_probability"),
    )


def by_risk(paths: DataFrame) -> DataFrame:
    return paths.orderBy(F.desc("risk_score"), "nodes")


def top_paths(paths: DataFrame, k: int = 10) -> DataFrame:
    return by_risk(paths).limit(k)


def aggregate_risk(paths: DataFrame) -> DataFrame:
    return paths.agg(F.coalesce(F.max("risk_score"), F.lit(0.0)).alias("risk"))
