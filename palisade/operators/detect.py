"""Edge scoring: novelty, rules, degree spikes and the blended anomaly score."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import config as C
from palisade.config import DEFAULT, Settings
from palisade.functions import scalar as X
from palisade.functions import vectors as V
from palisade.operators.graph import temporal_deviation
from palisade.operators.skew import Hubs, hubs, salted_join


def _attach_ends(edges: DataFrame, src_side: DataFrame, dst_side: DataFrame, found: Hubs) -> DataFrame:
    """Join per-node tables (keyed src / dst) to stored edges; hubs are salted on either side."""
    joined = salted_join(edges, src_side, ["src"], found.src, ["dst"], "left")
    return salted_join(joined, dst_side, ["dst"], found.dst, ["src"], "left")


def _node_sides(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    src = nodes.select(F.col("node_id").alias("src"), F.col("node_type").alias("src_type"))
    dst = nodes.select(
        F.col("node_id").alias("dst"),
        X.is_sensitive(F.col("sensitivity"), F.col("is_critical")).alias("to_sensitive"),
    )
    return src, dst


def edge_novelty(edges: DataFrame, nodes: DataFrame, as_of: Column, cfg: Settings = DEFAULT) -> DataFrame:
    src, dst = _node_sides(nodes)
    sensitive = F.coalesce("to_sensitive", F.lit(False))
    return _attach_ends(edges, src, dst, hubs(edges, cfg)).select(
        "src", "dst", X.novelty(F.col("first_seen"), sensitive, as_of, cfg).alias("novelty")
    )


def rule_scores(
    edges: DataFrame, nodes: DataFrame, as_of: Column, degree_baseline: DataFrame | None = None,
    cfg: Settings = DEFAULT,
) -> DataFrame:
    """First matching rule wins: new edge, lateral tool, rarely used admin port, degree spike.

    ``degree_baseline``: src, baseline. A source without one has its current degree as baseline.
    """
    src, dst = _node_sides(nodes)
    degree = edges.groupBy("src").agg(F.count("*").alias("out_degree"))
    if degree_baseline is not None:
        degree = degree.join(degree_baseline.select("src", "baseline"), "src", "left")
    else:
        degree = degree.withColumn("baseline", F.lit(None).cast("double"))
    src = degree.join(src, "src", "left")
    age = X.age_hours(F.col("first_seen"), as_of)
    young = age < cfg.novelty_hours
    sensitive = F.coalesce("to_sensitive", F.lit(False))
    tool = F.coalesce("lateral_tool", F.lit(False))
    port = (
        (F.col("event_count") <= cfg.rule_port_max_events)
        & F.col("admin_port").isNotNull()
        & (F.coalesce("src_type", F.lit("workload")) != "asset")
    )
    reached = ~young & ~tool & ~port
    spike = F.coalesce(
        (F.col("baseline") > 0) & (F.col("out_degree") > cfg.spike_factor * F.col("baseline")), F.lit(False)
    )
    score = (
        F.when(young, X.novelty(F.col("first_seen"), sensitive, as_of, cfg))
        .when(tool, cfg.rule_tool)
        .when(port, cfg.rule_port)
        .when(spike, cfg.rule_spike)
        .otherwise(0.0)
    )
    name = (
        F.when(young & sensitive, C.RULE_SENSITIVE)
        .when(young, C.RULE_NEW)
        .when(tool, C.RULE_TOOL)
        .when(port, F.concat(F.lit(C.RULE_PORT), F.col("admin_port").cast("string")))
        .when(spike, C.RULE_SPIKE)
        .otherwise("")
    )
    return _attach_ends(edges, src, dst, hubs(edges, cfg)).select(
        "src", "dst", score.alias("rule_score"), name.alias("rule_triggered"), "out_degree",
        reached.alias("reached_spike_rule"),
    )


def degree_pass(scored: DataFrame, baseline: DataFrame | None, cfg: Settings = DEFAULT) -> DataFrame:
    """Degree baselines after one detection pass. ``scored``: output of `rule_scores`.

    The moving average is applied once per edge that reached the spike rule. Within a pass either
    all of a source's edges fire (baseline unchanged) or none does, so m updates have a closed form.
    Sources absent from this pass keep their baseline.
    """
    now = scored.groupBy("src").agg(
        F.max("out_degree").cast("double").alias("degree"), F.count_if("reached_spike_rule").alias("m")
    )
    if baseline is None:
        known = now.withColumn("old", F.lit(None).cast("double"))
    else:
        known = now.join(baseline.select("src", F.col("baseline").alias("old")), "src", "full")
    start = F.coalesce("old", "degree")
    spike = F.coalesce((start > 0) & (F.col("degree") > cfg.spike_factor * start), F.lit(False))
    kept = F.pow(F.lit(1 - cfg.degree_alpha), F.col("m"))
    m = F.coalesce("m", F.lit(0))
    moved = F.when((m == 0) | spike, F.col("old")).otherwise(kept * start + (1 - kept) * F.col("degree"))
    return known.select("src", "degree", m.alias("edges_reached"), spike.alias("spike"), moved.alias("baseline"))


def score_edges(
    edges: DataFrame, nodes: DataFrame, windows: DataFrame, rules: DataFrame, embeddings: DataFrame,
    as_of: Column, cfg: Settings = DEFAULT,
) -> DataFrame:
    """Blend of behavioural, temporal and structural deviation; a rule can only raise the total.

    ``edges``: output of `weigh_edges`, or another edge table; only where it has no ``deviation_score`` are the ``windows``
    read. ``embeddings``: output of `update_baseline` (node_id, embedding, drift). The lengths of the embeddings are
    taken once per node, not at each of its edges.
    """
    vector = F.col("embedding")
    src = embeddings.select(
        F.col("node_id").alias("src"), vector.alias("e_src"), V.length(vector).alias("length_src"), "drift"
    )
    dst = embeddings.select(
        F.col("node_id").alias("dst"), vector.alias("e_dst"), V.length(vector).alias("length_dst")
    ).join(_node_sides(nodes)[1], "dst", "left")
    novelty = X.novelty(F.col("first_seen"), F.coalesce("to_sensitive", F.lit(False)), as_of, cfg)
    weighed = "deviation_score" in edges.columns
    slim = edges.select("src", "dst", "first_seen", *([F.col("deviation_score").alias("deviation")] if weighed else []))
    near = _attach_ends(slim, src, dst, hubs(edges, cfg)).select(
        "src", "dst", *(["deviation"] if weighed else []), F.col("drift").alias("d_b_embed"), novelty.alias("novelty"),
        V.cosine_distance(F.col("e_src"), F.col("e_dst"), F.col("length_src"), F.col("length_dst")).alias("d_g"),
    )
    if not weighed:
        near = near.join(temporal_deviation(windows, cfg), ["src", "dst"], "left")
    joined = (
        near.join(rules.select("src", "dst", "rule_score", "rule_triggered"), ["src", "dst"], "left")
        .withColumns({
            "d_b": F.greatest("d_b_embed", "novelty"),
            "d_t": F.coalesce("deviation", F.lit(0.0)),
            "rule_score": F.coalesce("rule_score", F.lit(0.0)),
            "rule_triggered": F.coalesce("rule_triggered", F.lit("")),
        })
    )
    gnn = cfg.w_behavioral * F.col("d_b") + cfg.w_temporal * F.col("d_t") + cfg.w_structural * F.col("d_g")
    total = F.greatest("gnn_score", "rule_score")
    return (
        joined.withColumn("gnn_score", gnn)
        .withColumn("total_score", total)
        .select(
            "src", "dst", as_of.alias("as_of"), "d_b", "d_t", "d_g", "gnn_score", "rule_score",
            "rule_triggered", "total_score", (F.col("total_score") > cfg.flag_above).alias("is_flagged"),
            F.struct(
                F.bround("gnn_score", 4).alias("gnn_score"), F.bround("rule_score", 4).alias("rule_score"),
                "rule_triggered", F.bround("d_b_embed", 4).alias("d_b_embed"),
                F.bround("novelty", 4).alias("novelty"), F.lit(cfg.flag_above).alias("threshold"),
            ).alias("details"),
        )
    )


def ranked(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.desc("total_score"), "src", "dst")


def flagged_edges(scores: DataFrame) -> DataFrame:
    return scores.where("is_flagged")


def compromised_nodes(scores: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Sources of the top flagged edges above the bar, or else the source of the best one."""
    top = ranked(flagged_edges(scores)).limit(cfg.compromised_top)
    best_first = F.array_sort(
        F.collect_list(F.struct((-F.col("total_score")).alias("below"), "src", "dst"))
    )
    sure = F.filter("top", lambda x: x.below < -cfg.compromised_above)
    chosen = F.when(F.size(sure) > 0, sure).otherwise(F.slice("top", 1, 1))
    return (
        top.agg(best_first.alias("top"))
        .select(F.explode(F.array_distinct(F.transform(chosen, lambda x: x.src))).alias("node_id"))
    )
