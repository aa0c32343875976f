"""One query per operator, over the whole benchmark tables. Times leave as timestamp_ntz, doubles
rounded to six places and lists joined to text, so that results compare across engines."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.config import DEFAULT, SPLIT
from palisade.functions import scalar as X
from palisade.functions import vectors as V
from palisade.operators import (
    centrality, contain, detect, drift, embed, features, graph, paths, soc, telemetry, windows,
)
from palisade.operators.skew import hot_keys, salted_join
from palisade.plans import detection
from palisade.plans.tables import Tables, tables
from palisade.sources import files
from palisade.storage import free_shuffles, materialize, new_path
from palisade.streaming import jobs

#: Bytes of rows for each byte of a stored file: what a join may broadcast (through the driver) is judged by its rows.
ROWS_PER_FILE_BYTE = "6.0"

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.sources.fileCompressionFactor", ROWS_PER_FILE_BYTE)
        free_shuffles(spark)
        return fn(tables(spark, sf_dir))

    REGISTRY[fn.__name__] = run
    return fn


def r6(column, places: int = 6) -> Column:
    """Rounded for comparison; the nudge (also in the SQL) keeps exact ties from falling both ways."""
    return F.round((F.col(column) if isinstance(column, str) else column) + 1e-12, places)


def _r(*names: str) -> list[Column]:
    return [r6(n).alias(n) for n in names]


def _t(*names: str) -> list[Column]:
    return [F.col(n).cast("timestamp_ntz").alias(n) for n in names]


def _joined(name: str, sep: str = ",") -> Column:
    return F.array_join(name, sep).alias(name)


# -- sources, normalisation -------------------------------------------------------------------


@query
def multi_source_union(t: Tables) -> DataFrame:
    good = telemetry.normalize(t.raw, t.as_of)
    return good.groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum("bytes_transferred").alias("bytes"),
        F.count_if("success").alias("ok"), F.min("ts").cast("timestamp_ntz").alias("first_ts"),
    )


@query
def normalize_events(t: Tables) -> DataFrame:
    good = telemetry.normalize(t.raw, t.as_of)
    return good.select(*[F.col(c) if c != "ts" else F.col("ts").cast("timestamp_ntz").alias("ts") for c in good.columns])


@query
def normalize_rejects(t: Tables) -> DataFrame:
    return telemetry.rejects(t.raw, t.as_of)


@query
def resolve_nodes(t: Tables) -> DataFrame:
    ends = t.raw.select(
        telemetry.resolve_node(t.raw, "source").alias("source_node"),
        telemetry.resolve_node(t.raw, "destination").alias("destination_node"),
    )
    return ends.groupBy("source_node", "destination_node").agg(F.count("*").alias("n"))


@query
def parse_timestamps(t: Tables) -> DataFrame:
    parsed = X.parse_timestamp(F.col("timestamp"), t.as_of)
    return t.raw.select("event_id", parsed.cast("timestamp_ntz").alias("ts"))


@query
def node_type_infer(t: Tables) -> DataFrame:
    dst, port = F.col("destination_node"), F.col("port")
    return t.tel.groupBy("destination_node", "port").agg(F.count("*").alias("n")).select(
        "destination_node", "port", "n",
        X.node_type(dst, port).alias("node_type"), X.node_sensitivity(dst, port).alias("sensitivity"),
    )


@query
def endpoint_expand(t: Tables) -> DataFrame:
    return telemetry.endpoints(t.tel).select(
        "event_id", "role", "node_id", "node_type", "sensitivity", "ip_address", "is_critical"
    )


@query
def suspicious_process(t: Tables) -> DataFrame:
    return t.tel.where(X.is_suspicious_process(F.col("process"))).select("event_id", "process")


@query
def business_hours(t: Tables) -> DataFrame:
    return t.tel.groupBy(X.in_business_hours(F.col("ts")).alias("business_hours"), "event_type").agg(
        F.count("*").alias("n")
    )


# -- graph ------------------------------------------------------------------------------------


def _edge_columns() -> list[Column]:
    return [
        F.col("src"), F.col("dst"), F.col("event_count"), F.col("bytes_total"), *_t("first_seen", "last_seen"),
        _joined("protocols"),
    ]


@query
def edge_fold(t: Tables) -> DataFrame:
    return graph.fold_edges(t.tel).select(*_edge_columns(), "lateral_tool", "admin_port")


@query
def edge_metadata(t: Tables) -> DataFrame:
    return graph.edge_metadata(t.tel)


@query
def node_merge(t: Tables) -> DataFrame:
    return graph.merge_nodes(t.tel).select(
        "node_id", "node_type", "sensitivity", "is_critical", "ip_address", "event_count",
        *_t("since_3", "since_4"),
    )


@query
def node_merge_prefix_only(t: Tables) -> DataFrame:
    return graph.merge_nodes(t.tel, use_ports=False).select("node_id", "node_type", "sensitivity", "is_critical")


@query
def node_event_counts(t: Tables) -> DataFrame:
    return graph.merge_nodes(t.tel).where("event_count > 0").select("node_id", "event_count")


@query
def edge_weights(t: Tables) -> DataFrame:
    return graph.weigh_edges(t.edges, t.windows, t.nodes).select(
        "src", "dst", *_r("frequency_score", "sensitivity_score", "deviation_score", "weight")
    )


@query
def edge_weights_pit(t: Tables) -> DataFrame:
    frequency = graph.point_in_time_frequency(t.tel, t.edges)
    return graph.weigh_edges(t.edges, t.windows, t.nodes, frequency=frequency).select(
        "src", "dst", *_r("frequency_score", "weight")
    )


@query
def edge_deviation(t: Tables) -> DataFrame:
    return t.weighted.select("src", "dst", *_r("deviation_score"))


@query
def edge_decay(t: Tables) -> DataFrame:
    return graph.decay_edges(t.weighted, t.as_of).select("src", "dst", *_r("weight"))


@query
def edge_prune(t: Tables) -> DataFrame:
    kept = graph.prune_edges(t.edges, t.as_of).agg(F.count("*").alias("kept"), F.sum("event_count").alias("kept_events"))
    return kept.withColumn("removed", graph.stale_edges(t.edges, t.as_of).agg(F.count("*")).scalar())


@query
def graph_stats(t: Tables) -> DataFrame:
    return graph.graph_stats(t.nodes, t.edges)


@query
def graph_snapshot(t: Tables) -> DataFrame:
    path = new_path(t.spark, "snapshots")
    files.write_snapshot(t.edges, path, t.as_of)
    return files.read_snapshot(t.spark, path, t.as_of).select(*_edge_columns(), "as_of_us")


@query
def sensitive_nodes(t: Tables) -> DataFrame:
    return graph.sensitive_nodes(t.nodes).select("node_id", "sensitivity", "is_critical")


@query
def graph_lookup(t: Tables) -> DataFrame:
    return soc.node_card(t.nodes, "db-0")


@query
def edge_lookup(t: Tables) -> DataFrame:
    return graph.lookup_edge(t.edges, "wl-4", "db-0").select(*_edge_columns())


@query
def neighbors(t: Tables) -> DataFrame:
    return graph.adjacency(t.edges)


# -- windows ----------------------------------------------------------------------------------


@query
def window_stats(t: Tables) -> DataFrame:
    rows = t.tel.select(
        F.col("source_node").alias("src"), "event_id", X.micros("ts").alias("at"),
        F.col("bytes_transferred").alias("value"),
    )
    cfg = DEFAULT
    spans = {"current": cfg.current_us, "short": cfg.short_us, "long": cfg.long_us}
    stats = windows.trailing_series(rows, ["src"], spans, cfg)
    doubles = [f"{s}_{m}" for s in spans for m in ("mean", "std", "rate")]
    return stats.select("src", "event_id", *[f"{s}_count" for s in spans], *_r(*doubles))


@query
def window_stats_without_ids(t: Tables) -> DataFrame:
    """The same for events that came without an id."""
    rows = t.tel.select(
        F.col("source_node").alias("src"), F.lit("").alias("event_id"), X.micros("ts").alias("at"),
        F.col("bytes_transferred").alias("value"),
    )
    cfg = DEFAULT
    spans = {"current": cfg.current_us, "short": cfg.short_us, "long": cfg.long_us}
    stats = windows.trailing_series(rows, ["src"], spans, cfg)
    doubles = [f"{s}_{m}" for s in spans for m in ("mean", "std", "rate")]
    return stats.select(
        "src", F.timestamp_micros("at").cast("timestamp_ntz").alias("ts"), F.col("value").alias("bytes_transferred"),
        *[f"{s}_count" for s in spans], *_r(*doubles),
    )


@query
def edge_temporal_features(t: Tables) -> DataFrame:
    six = graph.temporal_features(graph.pair_windows(t.tel))
    return six.select("src", "dst", *_r(*six.columns[2:]))


@query
def node_temporal_features(t: Tables) -> DataFrame:
    four = graph.node_windows(t.tel)
    return four.select("node_id", "activity_count", *_r("activity_rate", "activity_mean", "activity_std"))


@query
def temporal_deviation(t: Tables) -> DataFrame:
    return graph.temporal_deviation(t.windows).select("src", "dst", *_r("deviation"))


@query
def rolling_retention(t: Tables) -> DataFrame:
    kept = t.windows.select("src", "dst", F.col("long_count").alias("kept"))
    totals = t.edges.select("src", "dst", "event_count")
    return totals.join(kept, ["src", "dst"]).select(
        "src", "dst", "kept", (F.col("event_count") - F.col("kept")).alias("evicted")
    )


# -- features and embeddings ------------------------------------------------------------------


@query
def time_encoding(t: Tables) -> DataFrame:
    cells = X.time_encoding(F.col("ts"))
    names = ("hour_sin", "hour_cos", "day_sin", "day_cos")
    return t.tel.select("event_id", *[r6(c).alias(n) for c, n in zip(cells, names)])


@query
def node_behavioral(t: Tables) -> DataFrame:
    return features.behavioral(t.nodes, t.weighted).select("node_id", *_r(*features.BEHAVIORAL))


@query
def node_type_encoding(t: Tables) -> DataFrame:
    coded = features.type_encoding(t.nodes)
    return coded.select("node_id", *[F.col("node_type_enc")[i].alias(f"t{i}") for i in range(8)])


@query
def pagerank(t: Tables) -> DataFrame:
    return centrality.pagerank(t.nodes, t.edges).select("node_id", r6("pagerank", 8).alias("pagerank"), "converged")


@query
def clustering_coefficient(t: Tables) -> DataFrame:
    return centrality.clustering(t.nodes, t.edges).select("node_id", "triangles", *_r("clustering"))


@query
def node_structural(t: Tables) -> DataFrame:
    return features.structural(t.nodes, t.edges).select("node_id", *_r("pagerank", "clustering", "out_share", "in_share"))


@query
def node_features(t: Tables) -> DataFrame:
    return t.features.select("node_id", F.posexplode("vector").alias("i", "x")).select("node_id", "i", *_r("x"))


def _vector_rows(frame: DataFrame) -> DataFrame:
    return frame.select("node_id", F.posexplode("embedding").alias("i", "x")).select(
        "node_id", "i", r6(F.col("x").cast("double")).alias("x")
    )


@query
def sage_layer_sql(t: Tables) -> DataFrame:
    return _vector_rows(t.embeddings)


@query
def sage_weights_roundtrip(t: Tables) -> DataFrame:
    """Embeddings with stored and reloaded weights equal those with the weights as made."""
    path = new_path(t.spark, "weights")
    embed.save_layers(t.spark, embed.formula_layers(), path)
    again = embed.embed(t.features, t.weighted, embed.load_layers(t.spark, path))
    return t.embeddings.join(again.withColumnRenamed("embedding", "e2"), "node_id").select(
        "node_id",
        ((F.size("embedding") == F.size("e2")) & F.forall(
            F.zip_with("embedding", "e2", lambda a, b: F.abs(a - b) < 1e-12), lambda near: F.coalesce(near, F.lit(False))
        )).alias("same"),
    )


@query
def sage_embeddings(t: Tables) -> DataFrame:
    """Seeded weights, written to and read from their table first."""
    path = new_path(t.spark, "weights")
    embed.save_layers(t.spark, embed.seeded_layers(), path)
    layers = embed.load_layers(t.spark, path)
    return embed.embed(t.features, t.weighted, layers)


@query
def sage_embeddings_in(t: Tables) -> DataFrame:
    layers = embed.with_relu(embed.formula_layers())
    return _vector_rows(embed.embed(t.features, t.weighted, layers, direction="in", lonely="zero"))


@query
def cosine_distance(t: Tables) -> DataFrame:
    vectors = t.spark.read.parquet(f"{t.sf_dir}/embeddings.parquet")
    first = vectors.groupBy("label").agg(
        F.min_by("embedding", "vec_id").alias("anchor"), F.count("*").alias("n")
    )
    hot = hot_keys(first, ["label"], "n")
    return salted_join(vectors, first.drop("n"), ["label"], hot, ["vec_id"]).select(
        "vec_id", r6(V.cosine_distance(F.col("embedding"), F.col("anchor"))).alias("distance")
    )


def _embedding_history(t: Tables) -> DataFrame:
    return t.spark.read.parquet(f"{t.sf_dir}/embeddings.parquet").select(
        F.col("label").cast("string").alias("node_id"), F.col("vec_id").alias("pass"), "embedding"
    )


@query
def embedding_drift(t: Tables) -> DataFrame:
    return embed.replay_baseline(_embedding_history(t)).select("node_id", "pass", "first_pass", *_r("drift"))


@query
def embedding_drift_reset(t: Tables) -> DataFrame:
    middle = F.lit(t.spark.read.parquet(f"{t.sf_dir}/embeddings.parquet").agg(F.max("vec_id")).first()[0] // 2)
    return embed.replay_baseline(_embedding_history(t), reset_at=middle).select("node_id", "pass", "first_pass", *_r("drift"))


# -- detection --------------------------------------------------------------------------------


@query
def edge_novelty(t: Tables) -> DataFrame:
    return detect.edge_novelty(t.edges, t.nodes, t.as_of).select("src", "dst", *_r("novelty"))


@query
def rule_scores(t: Tables) -> DataFrame:
    return detect.rule_scores(t.edges, t.nodes, t.as_of).select("src", "dst", *_r("rule_score"), "rule_triggered")


@query
def degree_spikes(t: Tables) -> DataFrame:
    return t.pass_degrees.select("pass", "src", "degree", "edges_reached", "spike", *_r("baseline"))


@query
def edge_scores(t: Tables) -> DataFrame:
    return detect.ranked(t.scores).select(
        "src", "dst", *_r("d_b", "d_t", "d_g", "gnn_score", "rule_score", "total_score"), "rule_triggered", "is_flagged"
    )


@query
def flagged_edges(t: Tables) -> DataFrame:
    return detect.flagged_edges(t.scores).select("src", "dst", *_r("total_score"), "rule_triggered")


@query
def compromised_nodes(t: Tables) -> DataFrame:
    return detect.compromised_nodes(t.scores)


# -- paths and containment --------------------------------------------------------------------


def _path_columns() -> list[Column]:
    return [
        F.col("path_id"), F.col("source"), F.col("target"), _joined("nodes", ">"), F.col("hop_count"),
        *_r("probability", "impact_score", "risk_score"), F.col("risk_class"),
    ]


@query
def attack_paths(t: Tables) -> DataFrame:
    return t.paths.select(*_path_columns())


@query
def attack_paths_decayed(t: Tables) -> DataFrame:
    decayed = graph.decay_edges(t.live, t.as_of)
    return paths.attack_paths(decayed, t.starts, t.nodes).select(*_path_columns())


@query
def path_undetected_prob(t: Tables) -> DataFrame:
    return t.paths.select("path_id", r6("undetected_probability", 9).alias("undetected_probability"))


@query
def top_paths(t: Tables) -> DataFrame:
    return paths.top_paths(t.paths).select("path_id", *_r("risk_score"))


@query
def risk_classes(t: Tables) -> DataFrame:
    return t.paths.groupBy("risk_class").agg(F.count("*").alias("n"), r6(F.max("risk_score")).alias("max_risk"))


@query
def severity_labels(t: Tables) -> DataFrame:
    return t.weighted.groupBy(X.severity(F.col("weight")).alias("severity")).agg(F.count("*").alias("n"))


@query
def impact_scores(t: Tables) -> DataFrame:
    return t.nodes.select("node_id", r6(X.impact(F.col("sensitivity"), F.col("is_critical"))).alias("impact"))


@query
def aggregate_risk(t: Tables) -> DataFrame:
    return paths.aggregate_risk(t.paths).select(*_r("risk"))


@query
def business_impact(t: Tables) -> DataFrame:
    return contain.business_impact(contain.path_edges(t.paths), t.live).select(*_r("blocked_weight", "impact"))


@query
def containment_actions(t: Tables) -> DataFrame:
    return t.actions.select(
        "action_id", "risk_class", "action_type", *_r("risk_score", "business_impact"), "path_count", "edge_count",
        "auto_applied", *_t("created_at", "applied_at"),
    )


@query
def action_targets(t: Tables) -> DataFrame:
    return contain.action_targets(t.paths, t.starts, t.actions)


def _rule_columns() -> list[Column]:
    return [
        *[F.col(c) for c in ("rule_id", "action_id", "action", "source", "destination", "protocol", "port", "priority")],
        *_t("created_at", "expires_at"), F.col("reason"),
    ]


@query
def containment_rules(t: Tables) -> DataFrame:
    return t.firewall.select(*_rule_columns())


@query
def active_rules(t: Tables) -> DataFrame:
    later = t.as_of + F.make_dt_interval(hours=F.lit(23))
    return contain.active_rules(contain.applied_rules(t.firewall, t.actions), later).select(*_rule_columns())


@query
def rollback_rules(t: Tables) -> DataFrame:
    undone = t.actions.where("risk_class = 'SOC_ALERT'").select("action_id")
    return contain.rollback_rules(t.firewall, undone).select("rule_id", "action_id")


@query
def rollback_status(t: Tables) -> DataFrame:
    undone = t.actions.where("risk_class = 'SOC_ALERT'").select("action_id")
    return contain.rollback_status(t.actions, undone).select("action_id", "rollback_applied")


@query
def containment_history(t: Tables) -> DataFrame:
    return contain.containment_history(t.actions, t.firewall).select(
        "action_id", "action_type", *_r("risk_score", "business_impact"), "auto_applied", "rules_count",
        *_t("created_at", "applied_at"),
    )


# -- operations centre ------------------------------------------------------------------------


@query
def mitre_tactics(t: Tables) -> DataFrame:
    return soc.tactics(t.tel, detect.flagged_edges(t.scores)).select(_joined("tactics", "|"))


@query
def alert_build(t: Tables) -> DataFrame:
    top = F.array_join(F.transform("attack_paths", lambda p: F.array_join(p.nodes, ">")), "|")
    scored = F.array_join(F.transform("anomaly_scores", lambda s: F.concat(s.src, F.lit(">"), s.dst)), "|")
    return t.alert.select(
        "alert_id", "severity", "title", "description", "node_count",
        _joined("recommended_actions", "|"), _joined("mitre_tactics", "|"),
        top.alias("attack_paths"), scored.alias("anomaly_scores"),
        F.col("containment.action_type").alias("action_type"), F.col("containment.rules_count").alias("rules_count"),
        *_t("created_at"), "total_flagged_edges", "total_attack_paths", *_r("max_risk_score"),
    )


@query
def alert_json(t: Tables) -> DataFrame:
    nodes = soc.alert_nodes(t.scores).withColumn("alert_id", t.alert.select("alert_id").scalar())
    path = new_path(t.spark, "alerts")
    files.write_messages(soc.alert_messages(t.alert, nodes), path)
    sent = t.spark.read.parquet(path)
    field = lambda p: F.get_json_object("value", p)
    return sent.select(
        "topic", "key", field("$.severity").alias("severity"), field("$.title").alias("title"),
        field("$.page").cast("int").alias("page"), field("$.pages").cast("int").alias("pages"),
        F.regexp_replace(field("$.compromised_nodes"), r'[\[\]"]', "").alias("compromised_nodes"),
        F.json_array_length(field("$.attack_paths")).alias("path_count"),
        field("$.containment.action_type").alias("action_type"),
        field("$.containment.rules_count").cast("bigint").alias("rules_count"),
        field("$.created_at").alias("created_at"),
    )


def _alert_columns() -> list[Column]:
    return [F.col("alert_id"), F.col("severity"), *_t("created_at"), F.col("total_flagged_edges"), *_r("max_risk_score")]


@query
def alert_list(t: Tables) -> DataFrame:
    return soc.list_alerts(t.alerts, severity="LOW", limit=50).select(*_alert_columns())


@query
def alert_acknowledged(t: Tables) -> DataFrame:
    acks = t.alerts.where("max_risk_score = 0").select("alert_id")
    return soc.acknowledge(t.alerts, acks).select("alert_id", "acknowledged")


# -- drift ------------------------------------------------------------------------------------


@query
def psi_feature(t: Tables) -> DataFrame:
    cutoff = X.micros(t.as_of) - F.lit(7 * 86_400_000_000)
    values = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").select(
        F.col("event_type").alias("feature"), (X.micros(F.col("ts").cast("timestamp")) < cutoff).alias("expected"),
        F.col("value").alias("v"),
    )
    return drift.psi(values).select("feature", *_r("psi"))


def _checks(t: Tables) -> DataFrame:
    if "checks" not in t.__dict__:
        t.checks = materialize(drift.drift_check(t.history, t.as_of), "checks")
    return t.checks


@query
def drift_check(t: Tables) -> DataFrame:
    return _checks(t).select("feature_group", *_r("psi_score"), "features", "status", "triggered_retrain", *_t("detected_at"))


@query
def drift_status(t: Tables) -> DataFrame:
    recent = drift.recent_drift_events(_checks(t), 5).select("feature_group", "drift_id")
    return drift.psi_summary(_checks(t)).join(recent, "feature_group", "left").select("feature_group", *_r("psi"), "drift_id")


@query
def shadow_status(t: Tables) -> DataFrame:
    later = t.as_of + F.make_dt_interval(days=F.lit(8))
    return drift.shadow_status(_checks(t), later).select("in_shadow_mode", *_t("shadow_start"), "can_promote")


def _checks_shifted(t: Tables) -> DataFrame:
    if "checks_shifted" not in t.__dict__:
        t.checks_shifted = materialize(drift.drift_check(t.history_shifted, t.as_of), "checks-shifted")
    return t.checks_shifted


@query
def drift_check_shifted(t: Tables) -> DataFrame:
    """A history that does drift: all three states occur."""
    return _checks_shifted(t).select("feature_group", *_r("psi_score"), "features", "status", "triggered_retrain", *_t("detected_at"))


@query
def drift_events_shifted(t: Tables) -> DataFrame:
    return drift.recent_drift_events(_checks_shifted(t), 5).select("drift_id", "feature_group", *_t("detected_at"), *_r("psi_score"))


@query
def drift_gate(t: Tables) -> DataFrame:
    """A check three days after the last one is not due; one eight days after it is."""
    found = None
    for days in (3, 8):
        last = t.as_of - F.make_dt_interval(days=F.lit(days))
        part = drift.drift_check(t.history_shifted, t.as_of, last_check=last).select(
            F.lit(days).alias("days"), "feature_group", "status", *_r("psi_score")
        )
        found = part if found is None else found.unionByName(part)
    return found


@query
def shadow_states(t: Tables) -> DataFrame:
    """Shadow mode after two and eight days, and after a promotion on the fifth day."""
    found = None
    day = lambda n: t.as_of + F.make_dt_interval(days=F.lit(n))
    promoted = t.spark.range(1).select(day(5).alias("ts"))
    for name, moment, promotions in (("young", day(2), None), ("old", day(8), None), ("promoted", day(8), promoted)):
        part = drift.shadow_status(_checks_shifted(t), moment, promotions).select(
            F.lit(name).alias("state"), "in_shadow_mode", *_t("shadow_start"), "can_promote"
        )
        found = part if found is None else found.unionByName(part)
    return found


# -- the plan for large, skewed tables ---------------------------------------------------------
# The same results with keys of a few rows treated as hot: salted joins, sliced running totals.


@query
def edge_weights_split(t: Tables) -> DataFrame:
    frequent = graph.weigh_edges(t.edges, graph.pair_windows(t.tel, SPLIT), t.nodes, SPLIT)
    return frequent.select("src", "dst", *_r("frequency_score", "sensitivity_score", "deviation_score", "weight"))


@query
def rule_scores_split(t: Tables) -> DataFrame:
    return detect.rule_scores(t.edges, t.nodes, t.as_of, None, SPLIT).select("src", "dst", *_r("rule_score"), "rule_triggered")


@query
def pagerank_split(t: Tables) -> DataFrame:
    return centrality.pagerank(t.nodes, t.edges, SPLIT).select("node_id", r6("pagerank", 8).alias("pagerank"), "converged")


@query
def clustering_split(t: Tables) -> DataFrame:
    return centrality.clustering(t.nodes, t.edges, SPLIT).select("node_id", "triangles", *_r("clustering"))


@query
def attack_paths_split(t: Tables) -> DataFrame:
    return paths.attack_paths(t.live, t.starts, t.nodes, SPLIT).select(*_path_columns())


@query
def window_stats_split(t: Tables) -> DataFrame:
    rows = t.tel.select(
        F.col("source_node").alias("src"), "event_id", X.micros("ts").alias("at"), F.col("bytes_transferred").alias("value")
    )
    spans = {"current": SPLIT.current_us, "short": SPLIT.short_us, "long": SPLIT.long_us}
    stats = windows.trailing_series(rows, ["src"], spans, SPLIT)
    doubles = [f"{s}_{m}" for s in spans for m in ("mean", "std", "rate")]
    return stats.select("src", "event_id", *[f"{s}_count" for s in spans], *_r(*doubles))


# -- bulk graph: orders and line items -----------------------------------------------------------


@query
def pagerank_bulk(t: Tables) -> DataFrame:
    return centrality.pagerank(t.bulk_nodes, t.bulk_edges).select("node_id", r6("pagerank", 8).alias("pagerank"), "converged")


@query
def clustering_bulk(t: Tables) -> DataFrame:
    return centrality.clustering(t.bulk_nodes, t.bulk_edges).select("node_id", "triangles", *_r("clustering"))


# -- streaming --------------------------------------------------------------------------------
# The events arrive in four slices of about a week. A job runs until it has read what is there,
# stops, and is started again from its checkpoint for the next slice.

SLICES = 4


def _slice_of(ts: str = "ts") -> Column:
    return F.floor((F.dayofmonth(ts) - 1) / 8)


def _arrive(t: Tables, run: Callable[[DataFrame, str], jobs.StreamingQuery], arrival: Column | None = None) -> str:
    """``run(stream, folder)`` is called once per slice; returns the folder of the job."""
    folder = new_path(t.spark, "stream")
    arrival = _slice_of() if arrival is None else arrival
    for i in range(SLICES):
        t.tel.where(arrival == i).write.mode("append").parquet(f"{folder}/in")
        jobs.drain(run(files.telemetry_stream(t.spark, f"{folder}/in"), folder))
    return folder


@query
def stream_source_parse(t: Tables) -> DataFrame:
    folder = new_path(t.spark, "messages")
    text = F.to_json(F.struct(*t.raw.columns))
    # Decimal times and ports leave as JSON numbers; some messages are cut, blank or without any key.
    text = F.regexp_replace(text, r'"(timestamp|port)":"(-?\d+\.\d+)"', '"$1":$2')
    kind = F.col("event_id").cast("bigint") % 50
    cut = F.when(kind == 7, F.substring(text, 1, 25)).when(kind == 9, "  ").when(kind == 11, "{}").otherwise(text)
    t.raw.select(cut.alias("value")).write.text(f"{folder}/in")
    stream = files.message_stream(t.spark, f"{folder}/in")
    jobs.drain(jobs.ingest_messages(stream, f"{folder}/out", f"{folder}/ck", t.as_of))
    good = t.spark.read.parquet(f"{folder}/out/good").groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum("bytes_transferred").alias("bytes"),
        F.sum(X.micros("ts").cast("decimal(28,0)")).alias("times"),
    )
    bad = t.spark.read.parquet(f"{folder}/out/bad").groupBy("reject_reason").agg(F.count("*").alias("n"))
    return good.select(F.lit("good").alias("status"), F.col("event_type").alias("what"), "n", "bytes", "times").unionByName(
        bad.select(F.lit("bad").alias("status"), F.col("reject_reason").alias("what"), "n", F.lit(None).cast("bigint").alias("bytes"), F.lit(None).cast("decimal(38,0)").alias("times"))
    )


@query
def stream_edge_state(t: Tables) -> DataFrame:
    folder = _arrive(t, lambda s, f: jobs.maintain_edges(s, f"{f}/edges", f"{f}/ck"))
    return jobs.merged_edges(t.spark, f"{folder}/edges").select(*_edge_columns(), "lateral_tool", "admin_port")


@query
def stream_edge_compaction(t: Tables) -> DataFrame:
    folder = _arrive(t, lambda s, f: jobs.maintain_edges(s, f"{f}/edges", f"{f}/ck"))
    jobs.compact_edges(t.spark, f"{folder}/edges")
    merged = jobs.merged_edges(t.spark, f"{folder}/edges")
    return graph.prune_edges(merged, t.as_of).select(*_edge_columns())


@query
def stream_window_stats(t: Tables) -> DataFrame:
    folder = _arrive(t, lambda s, f: jobs.maintain_windows(s, f"{f}/log", f"{f}/out", f"{f}/ck"))
    six = graph.temporal_features(jobs.latest_windows(t.spark, f"{folder}/out"))
    return six.select("src", "dst", *_r(*six.columns[2:]))


@query
def stream_sliding_counts(t: Tables) -> DataFrame:
    folder = _arrive(t, lambda s, f: jobs.sliding_counts(s, f"{f}/out", f"{f}/ck"))
    return t.spark.read.parquet(f"{folder}/out").select(*_t("start", "end"), "src", "dst", "n", "bytes")


def _tardy() -> Column:
    """Slice of arrival when the rows of port 22 come a slice late."""
    return F.least(F.lit(SLICES - 1), _slice_of() + F.when(F.col("port") == 22, 1).otherwise(0))


@query
def stream_sliding_balance(t: Tables) -> DataFrame:
    """Emitted, open and dropped rows of each window and pair, with rows that come late."""
    folder = _arrive(t, lambda s, f: jobs.sliding_counts(s, f"{f}/out", f"{f}/ck"), _tardy())
    found = jobs.sliding_balance(t.spark.read.parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/ck")
    return found.select(*_t("start", "end"), "src", "dst", "arrived", "emitted", "open", "dropped")


@query
def stream_late_events(t: Tables) -> DataFrame:
    arrival = _tardy()
    folder = _arrive(t, lambda s, f: jobs.split_late(s, f"{f}/out", f"{f}/ck", 3_600_000_000), arrival)
    return t.spark.read.parquet(f"{folder}/out/rows").select("event_id", "batch_id", "late")


def _detected(t: Tables) -> str:
    """State of a detection stream over the four slices, run once for the queries that read it."""
    if "detected" not in t.__dict__:
        t.detected = _arrive(t, lambda s, f: jobs.detect_stream(s, f"{f}/state", f"{f}/ck", layers=embed.formula_layers()))
    return t.detected


@query
def stream_detection(t: Tables) -> DataFrame:
    """Scores of the pass after each micro-batch."""
    return detection.read_passes(t.spark, f"{_detected(t)}/state", "scores").select(
        F.col("pass_no").alias("batch_id"), "src", "dst", *_r("d_b", "d_t", "rule_score", "total_score"), "rule_triggered", "is_flagged", *_t("as_of")
    )


@query
def stream_alerts(t: Tables) -> DataFrame:
    """Alerts of the detection stream, sent on once per batch."""
    folder, sent = _detected(t), new_path(t.spark, "sent")

    def publish(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sent}/batch_id={number}")

    jobs.drain(jobs.alert_stream(jobs.read_alerts(t.spark, f"{folder}/state"), publish, f"{sent}-ck"))
    return t.spark.read.parquet(sent).select(
        "alert_id", "severity", *_t("created_at"), "node_count", "total_flagged_edges", "total_attack_paths", *_r("max_risk_score")
    )


@query
def stream_attack_paths(t: Tables) -> DataFrame:
    """Paths that the passes of the detection stream found."""
    return detection.read_passes(t.spark, f"{_detected(t)}/state", "paths").select(F.col("pass_no").alias("batch_id"), *_path_columns())


# Trailing windows from the time cells that the passes keep.


def _kept(t: Tables, name: str) -> DataFrame:
    return materialize(detection.merged_tables(t.spark, f"{_detected(t)}/state")[name].read().drop("written"), f"kept-{name}")


@query
def edge_temporal_features_cells(t: Tables) -> DataFrame:
    six = graph.temporal_features(_kept(t, "windows"))
    return six.select("src", "dst", *_r(*six.columns[2:]))


@query
def node_temporal_features_cells(t: Tables) -> DataFrame:
    stats = _kept(t, "activity")
    return stats.select("node_id", "activity_count", *_r("activity_rate", "activity_mean", "activity_std"))


@query
def temporal_deviation_cells(t: Tables) -> DataFrame:
    return graph.temporal_deviation(_kept(t, "windows")).select("src", "dst", *_r("deviation"))


@query
def edge_weights_cells(t: Tables) -> DataFrame:
    weighted = graph.weigh_edges(_kept(t, "edges"), _kept(t, "windows"), _kept(t, "nodes"))
    return weighted.select("src", "dst", *_r("frequency_score", "sensitivity_score", "deviation_score", "weight"))


@query
def edge_deviation_cells(t: Tables) -> DataFrame:
    weighted = graph.weigh_edges(_kept(t, "edges"), _kept(t, "windows"), _kept(t, "nodes"))
    return weighted.select("src", "dst", *_r("deviation_score"))


@query
def detection_passes(t: Tables) -> DataFrame:
    """Two full passes a week apart, the second against the baselines of the first."""
    state = new_path(t.spark, "passes")
    for n in range(2):
        detection.run_pass(t.log, t.as_of_pass(2 + n), state, n, embed.formula_layers())
    return detection.read_passes(t.spark, state, "scores").select(
        "pass_no", "src", "dst", *_r("d_b", "d_t", "rule_score", "total_score"), r6("d_g", 5).alias("d_g"), "rule_triggered", "is_flagged"
    )
