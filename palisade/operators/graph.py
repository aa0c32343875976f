"""Node and edge tables, edge weights, decay, pruning and look-ups."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import config as C
from palisade.config import DEFAULT, Settings
from palisade.functions import scalar as X
from palisade.operators.skew import hot_keys, hubs, running, salted_join
from palisade.operators.telemetry import endpoints
from palisade.operators.windows import trailing_at_last


def merge_nodes(tel: DataFrame, use_ports: bool = True) -> DataFrame:
    """First record names type and ip; later records can only raise the sensitivity.

    ``since_k`` is when the node first had at least sensitivity k, which makes "level as of t" a
    comparison instead of a window. Records are folded map-side before the per-node step, so a hot
    node costs a handful of rows per task.
    """
    if not use_ports:
        tel = tel.withColumn("port", F.lit(0))
    alike = ["node_id", "role", "node_type", "sensitivity", "ip_address"]
    folded = (
        endpoints(tel)
        .groupBy(*alike)
        .agg(
            F.min("ts").alias("first_ts"),
            F.sum(F.when(F.col("self_loop"), 0).otherwise(1)).alias("n"),
        )
    )
    first = F.min(F.struct("first_ts", "role", "node_type", "ip_address"))
    since = [
        F.min(F.when(F.col("sensitivity") >= k, F.col("first_ts"))).alias(f"since_{k}") for k in (2, 3, 4)
    ]
    merged = folded.groupBy("node_id").agg(
        first.alias("f"), F.max("sensitivity").alias("sensitivity"), F.sum("n").alias("event_count"), *since
    )
    return merged.select(
        "node_id",
        F.col("f.node_type").alias("node_type"),
        "sensitivity",
        (F.col("sensitivity") == C.CRITICAL).alias("is_critical"),
        F.col("f.ip_address").alias("ip_address"),
        "event_count",
        "since_2", "since_3", "since_4",
        F.col("f.first_ts").alias("first_ts"),
        F.col("f.role").alias("first_role"),
    )


def fold_edges(tel: DataFrame, as_of: Column | None = None) -> DataFrame:
    """One row per (src, dst) with src <> dst."""
    return without_loops(fold_pairs(tel, as_of))


def without_loops(pairs: DataFrame) -> DataFrame:
    """The edges among the pairs of `fold_pairs`."""
    return pairs.where(F.col("src") != F.col("dst"))


def fold_pairs(tel: DataFrame, as_of: Column | None = None) -> DataFrame:
    """One row per (src, dst), self-loops included; rows without one of the ends are left out.

    Folds per protocol first: that step has fixed-size buffers and combines map-side, so only a few
    rows per pair reach the step that collects the protocol list. These are brought together and sorted
    first, as that step works on runs of equal keys: combined on both sides of the shuffle it sorts twice.
    """
    flows = tel.where(F.col("source_node").isNotNull() & F.col("destination_node").isNotNull())
    if as_of is not None:
        flows = flows.where(F.col("ts") <= as_of)
    admin = F.when(F.col("port").isin(*C.ADMIN_PORTS), F.col("port"))
    per_protocol = flows.groupBy(
        F.col("source_node").alias("src"), F.col("destination_node").alias("dst"), "protocol"
    ).agg(
        F.count("*").alias("n"),
        F.sum("bytes_transferred").alias("b"),
        F.min("ts").alias("t0"),
        F.max("ts").alias("t1"),
        F.max(X.runs_lateral_tool(F.col("process"))).alias("tool"),
        F.min(admin).alias("admin"),
    )
    return per_protocol.repartition("src", "dst").sortWithinPartitions("src", "dst").groupBy("src", "dst").agg(
        F.sum("n").alias("event_count"),
        F.sum("b").alias("bytes_total"),
        F.min("t0").alias("first_seen"),
        F.max("t1").alias("last_seen"),
        F.array_sort(F.collect_set(F.nullif(F.col("protocol"), F.lit("")))).alias("protocols"),
        F.max("tool").alias("lateral_tool"),
        F.min("admin").alias("admin_port"),
    )


def merge_edges(parts: DataFrame) -> DataFrame:
    """Edge folds of several parts as one. Late rows only widen first_seen / last_seen."""
    lists = F.flatten(F.collect_set("protocols"))
    merged = parts.groupBy("src", "dst").agg(
        F.sum("event_count").alias("event_count"),
        F.sum("bytes_total").alias("bytes_total"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.max("lateral_tool").alias("lateral_tool"),
        F.min("admin_port").alias("admin_port"),
        F.array_sort(F.array_distinct(F.array_compact(lists))).alias("protocols"),
    )
    return merged.select(parts.columns)


def merge_node_parts(parts: DataFrame) -> DataFrame:
    """Node folds of several parts as one: the earliest record names type and ip, sensitivity only rises."""
    first = F.min(F.struct("first_ts", "first_role", "node_type", "ip_address"))
    return parts.groupBy("node_id").agg(
        first.alias("f"),
        F.max("sensitivity").alias("sensitivity"),
        F.max("is_critical").alias("is_critical"),
        F.sum("event_count").alias("event_count"),
        *[F.min(f"since_{k}").alias(f"since_{k}") for k in (2, 3, 4)],
    ).select(
        "node_id", F.col("f.node_type").alias("node_type"), "sensitivity", "is_critical",
        F.col("f.ip_address").alias("ip_address"), "event_count", "since_2", "since_3", "since_4",
        F.col("f.first_ts").alias("first_ts"), F.col("f.first_role").alias("first_role"),
    )


def edge_metadata(tel: DataFrame) -> DataFrame:
    """Every (process, port) seen on an edge, in long form so that no list has to fit in a row."""
    return (
        tel.where(F.col("source_node") != F.col("destination_node"))
        .groupBy(
            F.col("source_node").alias("src"), F.col("destination_node").alias("dst"), "process", "port"
        )
        .agg(F.count("*").alias("n"))
    )


def pair_windows(tel: DataFrame, cfg: Settings = DEFAULT, pairs: DataFrame | None = None) -> DataFrame:
    """Current, day and week counts and bytes per (src, dst) as of the pair's last event.

    Self-loops are kept: they take part in window statistics although they are not edges. ``pairs``: stored output of
    `fold_pairs` over the same telemetry, which knows the last events already.
    """
    last = None if pairs is None else pairs.select("src", "dst", X.micros("last_seen").alias("last_at"), F.col("event_count").alias("n"))
    return trailing_at_last(pair_rows(tel), ["src", "dst"], pair_spans(cfg), cfg, last=last)


def pair_spans(cfg: Settings = DEFAULT) -> dict[str, int]:
    return {"current": cfg.current_us, "short": cfg.short_us, "long": cfg.long_us}


def pair_rows(tel: DataFrame) -> DataFrame:
    """What the windows of pairs count: src, dst, event_id, at (micros), value."""
    return tel.select(
        F.col("source_node").alias("src"),
        F.col("destination_node").alias("dst"),
        "event_id",
        X.micros("ts").alias("at"),
        F.col("bytes_transferred").alias("value"),
    )


def by_node(rows: DataFrame) -> DataFrame:
    """Rows of pairs as rows of both their ends."""
    return rows.select(F.explode(F.array("src", "dst")).alias("node_id"), "at", "value")


def node_windows(tel: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Day-long count, rate, mean and deviation of bytes per node as of its last event."""
    rows = endpoints(tel).select(
        "node_id", "event_id", X.micros("ts").alias("at"), F.col("bytes_transferred").alias("value")
    )
    return node_activity(trailing_at_last(rows, ["node_id"], {"short": cfg.short_us}, cfg, deviation=True))


def node_activity(stats: DataFrame) -> DataFrame:
    """Day-long trailing statistics under the names of the features."""
    return stats.select(
        "node_id",
        F.col("short_count").alias("activity_count"),
        F.col("short_rate").alias("activity_rate"),
        F.col("short_mean").alias("activity_mean"),
        F.col("short_std").alias("activity_std"),
    )


def temporal_features(windows: DataFrame) -> DataFrame:
    """Six values per pair: rate per minute and mean bytes of the three windows."""
    names = [f"{w}_{m}" for w in ("current", "short", "long") for m in ("rate", "mean")]
    return windows.select("src", "dst", *names)


def temporal_deviation(windows: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    dev = X.deviation(F.col("current_count"), F.col("short_count"), cfg)
    return windows.select("src", "dst", dev.alias("deviation"))


def level_at(ts: Column) -> Column:
    """Sensitivity a node had at ``ts``, from its since_k columns."""
    levels = [F.when(F.col(f"since_{k}") <= ts, k) for k in (4, 3, 2)]
    return F.coalesce(*levels, F.lit(C.LOW))


def weigh_edges(
    edges: DataFrame, windows: DataFrame, nodes: DataFrame, cfg: Settings = DEFAULT,
    frequency: DataFrame | None = None,
) -> DataFrame:
    """Frequency, sensitivity and deviation scores and their blend.

    ``edges`` and ``nodes`` should be stored tables (they are read more than once). Without
    ``frequency`` the counts are compared as they stand now; pass `point_in_time_frequency` for the
    value each edge had at its own last event.
    """
    busiest = edges.groupBy("src").agg(F.max("event_count").alias("busiest"))
    found = hubs(edges, cfg)
    gap = temporal_deviation(windows, cfg).withColumnRenamed("deviation", "deviation_score")
    scored = edges.join(gap, ["src", "dst"], "left").withColumn(
        "deviation_score", F.coalesce("deviation_score", F.lit(0.0))
    )

    levels = nodes.select(F.col("node_id").alias("dst"), "since_2", "since_3", "since_4")
    scored = salted_join(
        scored, levels, ["dst"], found.dst, ["src"], "left"
    ).withColumn("sensitivity_score", level_at(F.col("last_seen")) / F.lit(float(C.CRITICAL)))

    if frequency is None:
        scored = salted_join(scored, busiest, ["src"], found.src, ["dst"]).withColumn("frequency_score", F.col("event_count") / F.col("busiest"))
    else:
        scored = scored.join(frequency, ["src", "dst"])
    blend = X.weight(F.col("frequency_score"), F.col("sensitivity_score"), F.col("deviation_score"), cfg)
    return scored.select(
        *edges.columns, "frequency_score", "sensitivity_score", "deviation_score", blend.alias("weight")
    )


def point_in_time_frequency(tel: DataFrame, edges: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """At the edge's last event: its count over the largest count among the source's edges so far."""
    flows = tel.where(F.col("source_node") != F.col("destination_node")).select(
        F.col("source_node").alias("src"),
        F.col("destination_node").alias("dst"),
        "event_id",
        X.micros("ts").alias("at"),
    )
    order = [F.col("at"), F.col("event_id")]
    rows = edges.agg(F.sum("event_count")).first()[0]
    hot_edges = hot_keys(edges, ["src", "dst"], "event_count", cfg, rows)
    per_source = edges.groupBy("src").agg(F.sum("event_count").alias("n"))
    hot_sources = hot_keys(per_source, ["src"], "n", cfg, rows)

    counted = running(flows, ["src", "dst"], "at", order, {"own": ("sum", F.lit(1))}, hot_edges, cfg)
    peaked = running(counted, ["src"], "at", order, {"peak": ("max", F.col("own"))}, hot_sources, cfg)
    # The last event of an edge is the one where its running count is largest, and the peak only grows.
    last = peaked.groupBy("src", "dst").agg(F.max("own").alias("own"), F.max("peak").alias("peak"))
    return last.select("src", "dst", (F.col("own") / F.col("peak")).alias("frequency_score"))


def decay_edges(edges: DataFrame, as_of: Column, cfg: Settings = DEFAULT) -> DataFrame:
    return edges.withColumn("weight", X.decayed(F.col("weight"), F.col("last_seen"), as_of, cfg))


def _stale(as_of: Column, cfg: Settings) -> Column:
    # The bare column, so that the filter reaches the scan.
    return F.col("last_seen") < as_of - F.make_dt_interval(days=F.lit(cfg.prune_days))


def prune_edges(edges: DataFrame, as_of: Column, cfg: Settings = DEFAULT) -> DataFrame:
    """Edges seen within the last week."""
    return edges.where(~_stale(as_of, cfg))


def stale_edges(edges: DataFrame, as_of: Column, cfg: Settings = DEFAULT) -> DataFrame:
    """What `prune_edges` removes."""
    return edges.where(_stale(as_of, cfg))


def sensitive_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(X.is_sensitive(F.col("sensitivity"), F.col("is_critical")))


def lookup_node(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("node_id") == node_id)


def lookup_edge(edges: DataFrame, src: str, dst: str) -> DataFrame:
    return edges.where((F.col("src") == src) & (F.col("dst") == dst))


def successors(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.where(F.col("src") == node_id).select(F.col("dst").alias("node_id"))


def predecessors(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.where(F.col("dst") == node_id).select(F.col("src").alias("node_id"))


def adjacency(edges: DataFrame) -> DataFrame:
    """All neighbour pairs, both ways, as rows: a hub's list never has to fit in one task."""
    out = edges.select(F.col("src").alias("node_id"), F.lit("out").alias("direction"), F.col("dst").alias("neighbor"))
    back = edges.select(F.col("dst").alias("node_id"), F.lit("in").alias("direction"), F.col("src").alias("neighbor"))
    return out.unionByName(back)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    sensitive = X.is_sensitive(F.col("sensitivity"), F.col("is_critical"))
    counts = nodes.agg(F.count("*").alias("node_count"), F.count_if(sensitive).alias("sensitive_nodes"))
    return counts.withColumn("edge_count", edges.agg(F.count("*")).scalar())
