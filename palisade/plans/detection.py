"""One full detection pass: telemetry in, scores, paths, containment and alerts out.

Every result is a stored table under ``state``, one part per pass, so passes can be re-run, read
by dashboards, and resumed after a failure. A pass reads the baselines of the pass before it.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.config import DAY_US, DEFAULT, Settings
from palisade.operators import contain, detect, drift, embed, features, graph, panes, paths, soc
from palisade.operators.skew import hubs
from palisade.state import Merged, delete
from palisade.storage import exists, materialize, together


def _save(df: DataFrame, state: str, table: str, pass_no: int) -> DataFrame:
    part = f"{state}/{table}/pass_no={pass_no}"
    df.write.mode("overwrite").parquet(part)
    return df.sparkSession.read.schema(df.schema).parquet(part)


def read_passes(spark: SparkSession, state: str, table: str) -> DataFrame | None:
    """All parts of a table with their ``pass_no``; null if no pass has written it."""
    return spark.read.parquet(f"{state}/{table}") if exists(spark, f"{state}/{table}") else None


def _before(spark: SparkSession, state: str, table: str, pass_no: int) -> DataFrame | None:
    """The newest part older than ``pass_no``."""
    parts = read_passes(spark, state, table)
    if parts is None:
        return None
    parts = parts.where(F.col("pass_no") < pass_no)
    newest = parts.agg(F.max("pass_no")).first()[0]
    return None if newest is None else parts.where(F.col("pass_no") == newest).drop("pass_no")


def run_pass(
    tel: DataFrame, as_of: Column, state: str, pass_no: int, layers: list[embed.Layer] | None = None,
    cfg: Settings = DEFAULT,
) -> None:
    """Detection over all telemetry up to ``as_of``. ``layers``: model weights, seeded if absent.

    Writes edges, nodes, rules, degree_baseline, embedding_baseline, scores, score_history, drift_checks,
    compromised, paths, actions, firewall_rules, alerts and alert_nodes; the last six are empty if
    nothing was flagged, so that a pass that is run again leaves nothing of its earlier run.
    """
    seen = tel.where(F.col("ts") <= as_of)

    def by_pair() -> tuple[DataFrame, DataFrame]:
        pairs = materialize(graph.fold_pairs(seen), "pairs")
        return graph.without_loops(pairs), materialize(graph.pair_windows(seen, cfg, pairs), "windows")

    (folded, windows), nodes, activity = together(
        by_pair, lambda: _save(graph.merge_nodes(seen), state, "nodes", pass_no),
        lambda: graph.node_windows(seen, cfg),
    )
    _conclude(folded, nodes, windows, activity, soc.keyword_hits(seen), as_of, state, pass_no, layers, cfg)


def run_increment(
    new: DataFrame, state: str, pass_no: int, layers: list[embed.Layer] | None = None, cfg: Settings = DEFAULT,
    as_of: Column | None = None,
) -> None:
    """The pass of `run_pass`, from the rows that arrived since the pass before and the state that passes keep.

    Numbers rise from pass to pass; a pass that is run again replaces its own work. Rows are folded once and merged into
    ``state``/merged (edges, nodes, time cells, tactics); window statistics are taken anew only for the pairs and nodes
    that the new rows touch, from their cells and from the rows of the minutes that a window's beginning cuts. Earlier
    telemetry is not needed for anything else. ``as_of``: the newest row of all passes if absent; later rows are the
    caller's to hold back.
    """
    spark = new.sparkSession
    new = materialize(new, "increment")
    _save(new.agg(F.max("ts").alias("newest")), state, "marks", pass_no)
    moment = read_passes(spark, state, "marks").where(F.col("pass_no") <= pass_no).agg(F.max("newest")).first()[0]
    if moment is None:
        return
    as_of = F.lit(moment) if as_of is None else as_of
    rows = graph.pair_rows(new).withColumn("day", F.to_date(F.timestamp_micros("at")))
    rows.drop("event_id").write.mode("overwrite").partitionBy("day").parquet(f"{state}/log/pass_no={pass_no}")

    tables = merged_tables(spark, state)
    stamp = F.lit(pass_no).alias("written")

    def kept(name: str, part: DataFrame) -> DataFrame:
        tables[name].add(part, pass_no)
        return materialize(tables[name].read(), f"state-{name}")

    def pair_windows() -> DataFrame:
        tables["pair_cells"].add(panes.cells(rows, PAIR), pass_no)
        touched = materialize(rows.select(*PAIR).distinct(), "touched-pairs")
        found = _windows(spark, state, pass_no, tables["pair_cells"], touched, PAIR, lambda x: x, graph.pair_spans(cfg))
        return kept("windows", found.select("*", stamp))

    def node_windows() -> DataFrame:
        tables["node_cells"].add(panes.cells(graph.by_node(rows), NODE), pass_no)
        touched = materialize(graph.by_node(rows).select(*NODE).distinct(), "touched-nodes")
        found = _windows(spark, state, pass_no, tables["node_cells"], touched, NODE, graph.by_node, {"short": cfg.short_us}, True)
        return kept("activity", graph.node_activity(found).select("*", stamp))

    # Each table depends on the new rows alone, so all are brought up to date at the same time.
    windows, activity, edges, nodes, hits = together(
        pair_windows, node_windows, lambda: kept("edges", graph.fold_edges(new)),
        lambda: _save(kept("nodes", graph.merge_nodes(new)), state, "nodes", pass_no), lambda: kept("hits", soc.keyword_hits(new)),
    )
    _conclude(edges, nodes, windows.drop("written"), activity.drop("written"), hits, as_of, state, pass_no, layers, cfg)


PAIR, NODE = ["src", "dst"], ["node_id"]


def merged_tables(spark: SparkSession, state: str) -> dict[str, Merged]:
    """The tables that `run_increment` keeps."""
    def newest(keys: list[str]):
        def merge(parts: DataFrame) -> DataFrame:
            rest = [c for c in parts.columns if c not in keys]
            return parts.groupBy(*keys).agg(F.max_by(F.struct(*rest), "written").alias("w")).select(*keys, "w.*").select(parts.columns)

        return merge

    table = lambda name, keys, merge: Merged(spark, f"{state}/merged/{name}", keys, merge)
    return {
        "edges": table("edges", PAIR, graph.merge_edges),
        "nodes": table("nodes", NODE, graph.merge_node_parts),
        "hits": table("hits", PAIR, soc.merge_hits),
        "pair_cells": table("pair_cells", PAIR, lambda parts: panes.merge(parts, PAIR)),
        "node_cells": table("node_cells", NODE, lambda parts: panes.merge(parts, NODE)),
        "windows": table("windows", PAIR, newest(PAIR)),
        "activity": table("activity", NODE, newest(NODE)),
    }


def _windows(
    spark: SparkSession, state: str, pass_no: int, cells: Merged, touched: DataFrame, keys: list[str],
    shape: Callable[[DataFrame], DataFrame], spans: dict[str, int], deviation: bool = False,
) -> DataFrame:
    """Window statistics of touched keys. Of the log, the days are read in which a window of theirs begins."""
    kept = materialize(cells.read(touched), "touched-cells")
    cut = panes.cut_minutes(kept.groupBy(*keys).agg(F.max("last").alias("last_at")), keys, spans)
    days = [r[0] for r in cut.select(F.to_date(F.timestamp_micros("start"))).distinct().collect()]  # a row per day
    log = spark.read.option("basePath", f"{state}/log").schema("src string, dst string, at bigint, value bigint, pass_no int, day date").parquet(f"{state}/log")
    rows = log.where(F.col("day").isin(days) & (F.col("pass_no") <= pass_no))
    return materialize(panes.from_cells(kept, shape(rows), keys, spans, deviation), "touched-windows")


def _conclude(
    folded: DataFrame, nodes: DataFrame, windows: DataFrame, activity: DataFrame, hits: DataFrame, as_of: Column, state: str, pass_no: int,
    layers: list[embed.Layer] | None, cfg: Settings,
) -> None:
    """All of a pass that follows from folded telemetry: weights, scores, drift, paths, containment and the alert."""
    spark = folded.sparkSession
    edges = _save(graph.weigh_edges(folded, windows, nodes, cfg), state, "edges", pass_no)

    def ruled() -> DataFrame:
        degrees = _before(spark, state, "degree_baseline", pass_no)
        rules = _save(detect.rule_scores(edges, nodes, as_of, degrees, cfg), state, "rules", pass_no)
        moved = detect.degree_pass(rules, degrees, cfg).where("baseline is not null")
        _save(moved.select("src", "baseline"), state, "degree_baseline", pass_no)
        return rules

    def embedded() -> DataFrame:
        vectors = materialize(features.assemble(nodes, edges, activity, as_of, cfg), "features")
        made = materialize(
            embed.embed(vectors, edges, layers or embed.seeded_layers(cfg), cfg=cfg), "embeddings"
        )
        known = _before(spark, state, "embedding_baseline", pass_no)
        return _save(embed.update_baseline(made, known, cfg), state, "embedding_baseline", pass_no)

    hubs(edges, cfg)  # both builds below read them
    rules, current, live = together(ruled, embedded, lambda: materialize(graph.prune_edges(edges, as_of, cfg), "live"))
    scores = _save(
        detect.score_edges(edges, nodes, windows, rules, current, as_of, cfg), state, "scores", pass_no
    )

    def drifted() -> None:
        history = scores.select(
            F.col("as_of").alias("ts"), F.array("d_b").alias("behavioral"), F.array("d_t").alias("temporal"),
            F.array("d_g").alias("structural"),
        )
        _save(history, state, "score_history", pass_no)
        _check_drift_once_due(spark, as_of, state, pass_no, cfg)

    def answered() -> None:
        compromised = _save(detect.compromised_nodes(scores, cfg), state, "compromised", pass_no)
        found = _save(paths.attack_paths(live, compromised, nodes, cfg), state, "paths", pass_no)
        actions = _save(contain.containment_actions(found, live, as_of, cfg), state, "actions", pass_no)
        blocks = _save(contain.firewall_rules(found, compromised, actions, cfg), state, "firewall_rules", pass_no)
        flagged = F.lit(not detect.flagged_edges(scores).isEmpty())
        alert = _save(soc.build_alert(scores, found, actions, blocks, None, as_of, hits).where(flagged), state, "alerts", pass_no)
        _save(
            soc.alert_nodes(scores).withColumn("alert_id", alert.select("alert_id").scalar()),
            state, "alert_nodes", pass_no,
        )

    together(drifted, answered)


# -- drift, and what people decide ------------------------------------------------------------------


def _check_drift_once_due(spark: SparkSession, as_of: Column, state: str, pass_no: int, cfg: Settings) -> None:
    """The pass's drift check over the scores of all passes so far; nothing is read until one interval after the last one.

    A check that was due but had too few rows leaves no trace, so the next pass tries again. With a check, history that
    the rolling window no longer reaches is deleted, a whole pass at a time.
    """
    last = None
    checks = read_passes(spark, state, "drift_checks")
    if checks is not None:
        last = checks.where(F.col("pass_no") < pass_no).agg(F.max(F.unix_micros("detected_at"))).first()[0]
    if last is not None:
        now = spark.range(1).select(F.unix_micros(as_of)).first()[0]
        if (now - last) // DAY_US < cfg.drift_check_days:
            return
    history = read_passes(spark, state, "score_history").where(F.col("pass_no") <= pass_no)
    found = _save(drift.drift_check(history.drop("pass_no"), as_of, cfg), state, "drift_checks", pass_no)
    if found.isEmpty():
        return
    reach = history.agg(F.max("ts")).scalar() - F.make_dt_interval(days=F.lit(cfg.drift_window_days))
    ended = history.groupBy("pass_no").agg(F.max("ts").alias("ts")).where(F.col("ts") < reach)
    for row in ended.collect():  # a row per stored pass
        delete(spark, f"{state}/score_history/pass_no={row['pass_no']}")


def _decide(spark: SparkSession, state: str, table: str, key: str, row: DataFrame) -> None:
    row.coalesce(1).write.mode("overwrite").parquet(f"{state}/{table}/key={key}")


def acknowledge(spark: SparkSession, state: str, alert_id: str) -> None:
    """An analyst has seen the alert; doing so twice changes nothing."""
    _decide(spark, state, "acknowledgements", alert_id, spark.range(1).select(F.lit(alert_id).alias("alert_id")))


def roll_back(spark: SparkSession, state: str, action_id: str) -> None:
    """The action's rules are no longer in force."""
    _decide(spark, state, "rollbacks", action_id, spark.range(1).select(F.lit(action_id).alias("action_id")))


def promote(spark: SparkSession, state: str, at: Column) -> None:
    """The retrained model goes live: shadow mode ends."""
    row = spark.range(1).select(at.alias("ts"))
    _decide(spark, state, "promotions", str(row.select(F.unix_micros("ts")).first()[0]), row)


def _decisions(spark: SparkSession, state: str, table: str, schema: str) -> DataFrame:
    stored = read_passes(spark, state, table)
    return spark.createDataFrame([], schema) if stored is None else stored.drop("key")


def alerts(spark: SparkSession, state: str) -> DataFrame:
    """Alerts of all passes with ``acknowledged``."""
    return soc.acknowledge(read_passes(spark, state, "alerts"), _decisions(spark, state, "acknowledgements", "alert_id string"))


def rules_in_force(spark: SparkSession, state: str, as_of: Column, cfg: Settings = DEFAULT) -> DataFrame:
    """Rules of applied actions that have neither run out nor been rolled back."""
    applied = contain.applied_rules(read_passes(spark, state, "firewall_rules"), read_passes(spark, state, "actions"), cfg)
    return contain.rollback_rules(contain.active_rules(applied, as_of), _decisions(spark, state, "rollbacks", "action_id string"), cfg)


def actions(spark: SparkSession, state: str) -> DataFrame:
    """Actions of all passes with ``rollback_applied``."""
    return contain.rollback_status(read_passes(spark, state, "actions"), _decisions(spark, state, "rollbacks", "action_id string"))


def shadow(spark: SparkSession, state: str, as_of: Column, cfg: Settings = DEFAULT) -> DataFrame:
    """Shadow mode as the stored checks and promotions have it."""
    promotions = _decisions(spark, state, "promotions", "ts timestamp")
    return drift.shadow_status(read_passes(spark, state, "drift_checks").drop("pass_no"), as_of, promotions, cfg)


def check_drift(spark: SparkSession, state: str, as_of: Column, cfg: Settings = DEFAULT) -> DataFrame:
    """Drift of the three score components over the stored passes."""
    return drift.drift_check(read_passes(spark, state, "score_history").drop("pass_no"), as_of, cfg)
