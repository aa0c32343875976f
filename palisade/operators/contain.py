"""Containment: one action per risk class, its firewall rules, rollback and history."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import config as C
from palisade.config import DEFAULT, Settings
from palisade.functions import scalar as X
from palisade.operators.skew import hot_keys, salted_join

CLASSES = ("AUTO_ISOLATE", "SOC_ALERT")


def path_edges(paths: DataFrame) -> DataFrame:
    """Distinct edges of the paths of each class that calls for action."""
    acted = paths.where(F.col("risk_class").isin(*CLASSES))
    return acted.select("risk_class", F.explode("edges").alias("e")).select("risk_class", "e.src", "e.dst").distinct()


def business_impact(blocked: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of all edge weight that blocking (src, dst) would remove; unknown edges add nothing."""
    cut = blocked.select("src", "dst").distinct().join(edges.select("src", "dst", "weight"), ["src", "dst"])
    total = edges.agg(F.sum("weight")).scalar()
    return cut.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("blocked_weight")).select(
        "blocked_weight",
        (F.col("blocked_weight") / F.greatest(F.coalesce(total, F.lit(0.0)), F.lit(1e-9))).alias("impact"),
    )


def containment_actions(
    paths: DataFrame, edges: DataFrame, as_of: Column, cfg: Settings = DEFAULT
) -> DataFrame:
    """At most two rows. An isolation that would disrupt too much is downgraded, not applied."""
    acted = paths.where(F.col("risk_class").isin(*CLASSES))
    blocked = (
        path_edges(paths)
        .join(edges.select("src", "dst", "weight"), ["src", "dst"], "left")
        .groupBy("risk_class")
        .agg(F.count("*").alias("edge_count"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("blocked_weight"))
    )
    total = F.coalesce(edges.agg(F.sum("weight")).scalar(), F.lit(0.0))
    impact = F.col("blocked_weight") / F.greatest(total, F.lit(1e-9))
    auto = F.col("risk_class") == "AUTO_ISOLATE"
    kind = (
        F.when(~auto, "SOC_ALERT")
        .when(F.col("business_impact") < cfg.impact_auto, "AUTO_ISOLATE")
        .when(F.col("business_impact") < cfg.impact_soc, "SOC_ALERT")
        .otherwise("MANUAL_REVIEW")
    )
    applied = auto & (F.col("action_type") == "AUTO_ISOLATE")
    return (
        acted.groupBy("risk_class")
        .agg(F.count("*").alias("path_count"), F.max("risk_score").alias("risk_score"))
        .join(blocked, "risk_class")
        .withColumn("business_impact", impact)
        .withColumn("action_type", kind)
        .select(
            X.natural_id("risk_class", X.micros(as_of).cast("string")).alias("action_id"),
            "risk_class", "action_type", "risk_score", "path_count", "edge_count", "business_impact",
            applied.alias("auto_applied"),
            as_of.alias("created_at"),
            F.when(applied, as_of).alias("applied_at"),
        )
    )


def _per_class(compromised: DataFrame) -> DataFrame:
    return compromised.select(F.explode(F.array(*[F.lit(c) for c in CLASSES])).alias("risk_class"), "node_id")


def action_targets(paths: DataFrame, compromised: DataFrame, actions: DataFrame) -> DataFrame:
    """Path targets and compromised nodes of each action, one row each. Actions: two rows at most."""
    ends = paths.where(F.col("risk_class").isin(*CLASSES)).select("risk_class", F.col("target").alias("node_id"))
    ids = F.broadcast(actions.select("risk_class", "action_id"))
    return ends.unionByName(_per_class(compromised)).distinct().join(ids, "risk_class").select("action_id", "node_id")


def firewall_rules(
    paths: DataFrame, compromised: DataFrame, actions: DataFrame, cfg: Settings = DEFAULT
) -> DataFrame:
    """Deny all traffic out of compromised nodes and every path edge. Actions: two rows at most."""
    isolate = _per_class(compromised).select(
        "risk_class", F.col("node_id").alias("source"), F.lit("ANY").alias("destination"),
        F.lit(10).alias("priority"), F.lit(True).alias("whole_node"),
    )
    cut = path_edges(paths).select(
        "risk_class", F.col("src").alias("source"), F.col("dst").alias("destination"),
        F.lit(20).alias("priority"), F.lit(False).alias("whole_node"),
    )
    header = F.broadcast(actions.select("risk_class", "action_id", "risk_score", "created_at"))
    ttl = F.make_dt_interval(hours=F.lit(cfg.rule_ttl_hours))
    risk = X.two_places("risk_score")
    reason = F.when(F.col("whole_node"), X.fill(C.REASON_NODE, risk=risk)).otherwise(X.fill(C.REASON_EDGE, risk=risk))
    return isolate.unionByName(cut).join(header, "risk_class").select(
        X.natural_id("action_id", "source", "destination").alias("rule_id"),
        "action_id",
        F.lit("DENY").alias("action"),
        "source",
        "destination",
        F.lit("ANY").alias("protocol"),
        F.lit(0).alias("port"),
        "priority",
        "created_at",
        (F.col("created_at") + ttl).alias("expires_at"),
        reason.alias("reason"),
    )


def _by_action(rules: DataFrame, ids: DataFrame, how: str, cfg: Settings) -> DataFrame:
    """An action may own a large share of all rules, so its rules are salted."""
    owned = rules.groupBy("action_id").agg(F.count("*").alias("n"))
    hot = hot_keys(owned, ["action_id"], "n", cfg)
    return salted_join(rules, ids.select("action_id").distinct(), ["action_id"], hot, ["rule_id"], how).select(rules.columns)


def applied_rules(rules: DataFrame, actions: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    return _by_action(rules, actions.where("auto_applied"), "left_semi", cfg)


def rollback_rules(rules: DataFrame, rollbacks: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Rules that stay in force after ``rollbacks`` (action_id)."""
    return _by_action(rules, rollbacks, "left_anti", cfg)


def rollback_status(actions: DataFrame, rollbacks: DataFrame) -> DataFrame:
    done = rollbacks.select("action_id", F.lit(True).alias("hit")).distinct()
    return actions.join(done, "action_id", "left").select(
        *actions.columns, F.coalesce("hit", F.lit(False)).alias("rollback_applied")
    )


def active_rules(rules: DataFrame, as_of: Column) -> DataFrame:
    return rules.where(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))


def containment_history(actions: DataFrame, rules: DataFrame, limit: int = 20) -> DataFrame:
    """The latest actions with their rule counts."""
    counts = rules.groupBy("action_id").agg(F.count("*").alias("rules_count"))
    latest = actions.orderBy(F.desc("created_at"), "action_id").limit(limit)
    return latest.join(counts, "action_id", "left").withColumn(
        "rules_count", F.coalesce("rules_count", F.lit(0))
    )
