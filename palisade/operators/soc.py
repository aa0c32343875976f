"""Alerts, tactics and status reads for the operations centre."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import config as C
from palisade.config import DEFAULT, Settings
from palisade.functions import scalar as X
from palisade.operators.detect import flagged_edges, ranked
from palisade.operators.paths import by_risk
from palisade.operators.skew import hot_keys, salted_join


def keyword_hits(tel: DataFrame) -> DataFrame:
    """src, dst, k, ts: when an edge's events first matched the k-th keyword. Eight rows per edge at most.

    The keywords are matched as expressions on rows folded to distinct (edge, process, type), so a busy edge is one row
    per task.
    """
    seen = tel.groupBy(
        F.col("source_node").alias("src"), F.col("destination_node").alias("dst"), "process", "event_type"
    ).agg(F.min("ts").alias("ts"))
    hits = []
    for rank, (keyword, _) in enumerate(C.TACTICS):
        match = F.contains(F.lower("process"), F.lit(keyword)) | (F.col("event_type") == keyword)
        hits.append(F.when(match, F.lit(rank)))
    return merge_hits(seen.select("src", "dst", F.explode(F.array_compact(F.array(*hits))).alias("k"), "ts"))


def merge_hits(parts: DataFrame) -> DataFrame:
    return parts.groupBy("src", "dst", "k").agg(F.min("ts").alias("ts"))


def event_tactics(hits: DataFrame, flagged: DataFrame) -> DataFrame:
    """Tactic labels seen on events of flagged edges, with a rank by first appearance. ``hits``: of `keyword_hits`."""
    labels = F.array(*[
        F.array(*[F.struct(F.lit(place).alias("p"), F.lit(label).alias("tactic")) for place, label in enumerate(own)]) for _, own in C.TACTICS
    ])
    return (
        hits.join(flagged.select("src", "dst"), ["src", "dst"], "left_semi")
        .select("ts", "k", F.explode(F.get(labels, F.col("k"))).alias("h"))
        .groupBy(F.col("h.tactic").alias("tactic"))
        .agg(F.min(F.struct("ts", "k", "h.p")).alias("first_seen"))
    )


def tactics(tel: DataFrame, flagged: DataFrame) -> DataFrame:
    """One row: labels in order of first appearance (a closed list of 16), or the default pair."""
    return listed_tactics(keyword_hits(tel), flagged)


def listed_tactics(hits: DataFrame, flagged: DataFrame) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("first_seen", "tactic")))
    names = F.transform(listed, lambda x: x.tactic)
    default = F.array(*[F.lit(t) for t in C.DEFAULT_TACTICS])
    return event_tactics(hits, flagged).agg(F.when(F.size(names) > 0, names).otherwise(default).alias("tactics"))


def alert_nodes(scores: DataFrame) -> DataFrame:
    """Both ends of every flagged edge, one row each."""
    hit = flagged_edges(scores)
    return hit.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()


def build_alert(
    scores: DataFrame, paths: DataFrame, actions: DataFrame, rules: DataFrame, tel: DataFrame | None,
    as_of: Column, hits: DataFrame | None = None,
) -> DataFrame:
    """One alert for one detection pass. Node lists stay in `alert_nodes`; arrays here are top-k.

    ``hits``: stored output of `keyword_hits`, in place of the telemetry.
    """
    hit = flagged_edges(scores)
    top_scores = (
        ranked(hit).limit(20)
        .select((-F.col("total_score")).alias("below"), "src", "dst", "total_score", "rule_triggered")
        .agg(F.array_sort(F.collect_list(F.struct("below", "src", "dst", "total_score", "rule_triggered"))).alias("s"))
        .select(F.transform("s", lambda x: F.struct(x.src.alias("src"), x.dst.alias("dst"), x.total_score.alias("total_score"), x.rule_triggered.alias("rule_triggered"))))
    )
    shape = ("path_id", "nodes", "risk_score", "hop_count", "source", "target")
    top = (
        by_risk(paths).limit(5)
        .select((-F.col("risk_score")).alias("below"), *shape)
        .agg(F.array_sort(F.collect_list(F.struct("below", "nodes", "path_id", "risk_score", "hop_count", "source", "target"))).alias("p"))
        .select(F.transform("p", lambda x: F.struct(*[x[c].alias(c) for c in shape])))
    )
    first_action = F.struct("action_type", "auto_applied", "business_impact", F.coalesce("rules_count", F.lit(0)).alias("rules_count"))
    contained = (
        actions.join(rules.groupBy("action_id").agg(F.count("*").alias("rules_count")), "action_id", "left")
        .agg(F.min_by(first_action, "risk_class"))
    )
    frame = (
        hit.agg(F.count("*").alias("total_flagged_edges"))
        .withColumns({
            "node_count": alert_nodes(scores).agg(F.count("*")).scalar(),
            "total_attack_paths": paths.agg(F.count("*")).scalar(),
            "max_risk_score": paths.agg(F.coalesce(F.max("risk_score"), F.lit(0.0))).scalar(),
            "anomaly_scores": top_scores.scalar(),
            "attack_paths": top.scalar(),
            "containment": contained.scalar(),
            "mitre_tactics": listed_tactics(keyword_hits(tel) if hits is None else hits, hit).scalar(),
        })
        .withColumn("severity", X.severity(F.col("max_risk_score")))
        .withColumn("best", F.try_element_at("attack_paths", F.lit(1)))
    )
    found = X.fill(C.ALERT_FLAGGED, edges=F.col("total_flagged_edges"))
    worst = X.fill(
        C.ALERT_WORST, source=F.col("best.source"), target=F.col("best.target"),
        risk=X.two_places("max_risk_score"), hops=F.col("best.hop_count"),
    )
    title = X.fill(C.ALERT_TITLE, severity=F.col("severity"), nodes=F.col("node_count"))
    return frame.select(
        X.natural_id(F.lit("alert"), X.micros(as_of).cast("string")).alias("alert_id"),
        "severity",
        title.alias("title"),
        F.concat(found, F.coalesce(worst, F.lit(""))).alias("description"),
        "node_count", "attack_paths", "anomaly_scores",
        recommendations().alias("recommended_actions"),
        "mitre_tactics", "containment", as_of.alias("created_at"),
        "total_flagged_edges", "total_attack_paths", "max_risk_score",
    )


def recommendations() -> Column:
    """Reads the columns ``containment`` and ``best`` of an alert in the making."""
    c = F.col("containment")
    opening = (
        F.when(c["auto_applied"], X.fill(C.ADVICE_ISOLATED, rules=c["rules_count"]))
        .when(c["action_type"] == "SOC_ALERT", C.ADVICE_REVIEW)
        .otherwise(C.ADVICE_MANUAL)
    )
    trace = X.fill(C.ADVICE_PATH, path=F.array_join("best.nodes", " → "), risk=X.two_places("best.risk_score"))
    return F.array_compact(F.array(opening, trace, *[F.lit(x) for x in C.ADVICE_CLOSING]))


def alert_messages(alerts: DataFrame, nodes: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """JSON payloads (topic, key, value). ``nodes``: alert_id, node_id.

    The node list of an alert has no bound, so it is paged by a hash of the node: page 0 always
    exists, every page repeats the header, and no message carries more than about one page of ids.
    """
    header = alerts.withColumn(
        "pages", F.greatest(F.lit(1), F.ceil(F.col("node_count") / F.lit(cfg.nodes_per_page))).cast("int")
    )
    pages = header.select("alert_id", "pages")
    hot = hot_keys(nodes.groupBy("alert_id").agg(F.count("*").alias("n")), ["alert_id"], "n", cfg)
    digest = F.conv(F.substring(F.md5("node_id"), 1, 8), 16, 10).cast("bigint")
    listed = (
        salted_join(nodes, pages, ["alert_id"], hot, ["node_id"])
        .groupBy("alert_id", F.pmod(digest, F.col("pages")).cast("int").alias("page"))
        .agg(F.array_sort(F.collect_list("node_id")).alias("compromised_nodes"))
    )
    blank = header.select("*", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)).alias("page"))
    c = F.col("containment")
    payload = F.struct(
        "alert_id", "severity", "title", "description",
        F.coalesce("compromised_nodes", F.array().cast("array<string>")).alias("compromised_nodes"),
        "mitre_tactics", "recommended_actions",
        F.transform(
            "attack_paths",
            lambda p: F.struct(*[p[n].alias(n) for n in ("path_id", "nodes", "risk_score", "hop_count")]),
        ).alias("attack_paths"),
        F.when(
            c.isNotNull(),
            F.struct(
                c["action_type"].alias("action_type"), c["auto_applied"].alias("auto_applied"),
                c["rules_count"].alias("rules_count"), c["business_impact"].alias("business_impact"),
            ),
        ).alias("containment"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"),
        "page", "pages",
    )
    return blank.join(listed, ["alert_id", "page"], "left").select(
        F.lit(cfg.alert_topic).alias("topic"),
        F.col("alert_id").alias("key"),
        F.to_json(payload, {"ignoreNullFields": "false"}).alias("value"),
    )


def list_alerts(alerts: DataFrame, severity: str | None = None, limit: int = 50) -> DataFrame:
    """The latest alerts, optionally of one severity."""
    if severity is not None:
        alerts = alerts.where(F.col("severity") == severity)
    return alerts.orderBy(F.desc("created_at"), "alert_id").limit(limit)


def acknowledge(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """``acks``: alert_id of every acknowledgement."""
    done = acks.select("alert_id", F.lit(True).alias("hit")).distinct()
    return alerts.join(done, "alert_id", "left").select(
        *alerts.columns, F.coalesce("hit", F.lit(False)).alias("acknowledged")
    )


def node_card(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("node_id") == node_id).select(
        "node_id", "node_type", "sensitivity", "is_critical", "ip_address", F.lit("").alias("hostname")
    )


def alert_headers(scores: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """One short alert per detection pass (``as_of`` column) that flagged something."""
    flagged = scores.where("is_flagged").groupBy("as_of").agg(
        F.count("*").alias("total_flagged_edges"), F.max("total_score").alias("max_score")
    )
    if paths is None:
        rated = flagged.withColumn("max_risk_score", F.lit(0.0))
    else:
        worst = paths.groupBy("as_of").agg(F.max("risk_score").alias("max_risk_score"))
        rated = flagged.join(worst, "as_of", "left").withColumn(
            "max_risk_score", F.coalesce("max_risk_score", F.lit(0.0))
        )
    return rated.select(
        X.natural_id(F.lit("alert"), X.micros("as_of").cast("string")).alias("alert_id"),
        X.severity(F.col("max_risk_score")).alias("severity"),
        F.col("as_of").alias("created_at"),
        "total_flagged_edges", "max_score", "max_risk_score",
    )
