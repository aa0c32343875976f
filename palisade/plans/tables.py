"""The stored tables of one detection run, built on first use and shared by the queries of a session."""

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade import config as C
from palisade.config import DEFAULT, Settings
from palisade.operators import contain, detect, embed, features, graph, paths, soc, telemetry
from palisade.operators.skew import hubs
from palisade.sources import fixtures
from palisade.storage import materialize, together

PASSES = 4


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str, cfg: Settings = DEFAULT):
        self.spark, self.sf_dir, self.cfg = spark, sf_dir, cfg

    @cached_property
    def tel(self) -> DataFrame:
        return fixtures.telemetry(self.spark, self.sf_dir)

    @cached_property
    def as_of_value(self):
        events = self.spark.read.parquet(f"{self.sf_dir}/events.parquet")
        return events.agg(F.unix_micros(F.max(F.col("ts").cast("timestamp")))).first()[0]

    @cached_property
    def as_of(self):
        """Latest event time; the default moment of every query."""
        return F.timestamp_micros(F.lit(self.as_of_value))

    def as_of_pass(self, p: int):
        """Moments of the weekly detection passes; the last one is `as_of`."""
        return F.timestamp_micros(F.lit(self.as_of_value - (PASSES - 1 - p) * 7 * C.DAY_US))

    @cached_property
    def raw(self) -> DataFrame:
        return telemetry.union_sources(*fixtures.raw_sources(self.spark, self.sf_dir))

    @cached_property
    def log(self) -> DataFrame:
        """The telemetry, stored for the folds of a whole detection run, which read it many times."""
        return materialize(self.tel, "log")

    @cached_property
    def pairs(self) -> DataFrame:
        return materialize(graph.fold_pairs(self.log), "pairs")

    @cached_property
    def edges(self) -> DataFrame:
        return graph.without_loops(self.pairs)

    @cached_property
    def nodes(self) -> DataFrame:
        return materialize(graph.merge_nodes(self.log), "nodes")

    @cached_property
    def windows(self) -> DataFrame:
        return materialize(graph.pair_windows(self.log, self.cfg, self.pairs), "windows")

    @cached_property
    def weighted(self) -> DataFrame:
        self.log  # both builds below read it
        windows, nodes = together(lambda: self.windows, lambda: self.nodes)
        return materialize(graph.weigh_edges(self.edges, windows, nodes, self.cfg), "weighted")

    @cached_property
    def live(self) -> DataFrame:
        return materialize(graph.prune_edges(self.weighted, self.as_of, self.cfg), "live")

    @cached_property
    def features(self) -> DataFrame:
        self.log  # both builds below read it
        activity, _ = together(lambda: graph.node_windows(self.log, self.cfg), lambda: self.weighted)
        return materialize(
            features.assemble(self.nodes, self.weighted, activity, self.as_of, self.cfg), "features"
        )

    @cached_property
    def embeddings(self) -> DataFrame:
        layers = embed.formula_layers(self.cfg)
        return materialize(embed.embed(self.features, self.weighted, layers, cfg=self.cfg), "embeddings")

    @cached_property
    def rules(self) -> DataFrame:
        return materialize(detect.rule_scores(self.weighted, self.nodes, self.as_of, None, self.cfg), "rules")

    @cached_property
    def scores(self) -> DataFrame:
        self.weighted  # both builds below read it
        embeddings, _ = together(lambda: self.embeddings, lambda: self.rules)
        first = embed.update_baseline(embeddings, None, self.cfg)
        return materialize(
            detect.score_edges(self.weighted, self.nodes, self.windows, self.rules, first, self.as_of, self.cfg),
            "scores",
        )

    @cached_property
    def starts(self) -> DataFrame:
        """The nodes that the scores show to be compromised: where the path search begins."""
        return materialize(detect.compromised_nodes(self.scores, self.cfg), "starts")

    @cached_property
    def paths(self) -> DataFrame:
        return materialize(paths.attack_paths(self.live, self.starts, self.nodes, self.cfg), "paths")

    @cached_property
    def actions(self) -> DataFrame:
        return materialize(contain.containment_actions(self.paths, self.live, self.as_of, self.cfg), "actions")

    @cached_property
    def firewall(self) -> DataFrame:
        return materialize(contain.firewall_rules(self.paths, self.starts, self.actions, self.cfg), "firewall")

    @cached_property
    def alert(self) -> DataFrame:
        self.weighted  # both builds below read it
        together(lambda: self.scores, lambda: self.firewall)
        return materialize(
            soc.build_alert(self.scores, self.paths, self.actions, self.firewall, self.tel, self.as_of), "alert"
        )

    @cached_property
    def _passes(self) -> tuple[DataFrame, DataFrame]:
        """Weekly rule passes over the growing graph: rule scores, and degree baselines per pass."""
        def folded(p: int) -> tuple[DataFrame, DataFrame]:
            seen = self.tel.where(F.col("ts") <= self.as_of_pass(p))
            edges = materialize(graph.fold_edges(seen), f"pass-{p}-edges")
            hubs(edges, self.cfg)
            return edges, materialize(graph.merge_nodes(seen), f"pass-{p}-nodes")

        self.as_of_value  # all folds below read it
        folds = together(*[lambda p=p: folded(p) for p in range(PASSES)])
        scored, degrees, baseline = [], [], None
        for p, (edges, nodes) in enumerate(folds):
            moment = self.as_of_pass(p)
            rules = materialize(detect.rule_scores(edges, nodes, moment, baseline, self.cfg), f"pass-{p}-rules")
            state = materialize(detect.degree_pass(rules, baseline, self.cfg), f"pass-{p}-degrees")
            baseline = state.where("baseline is not null")
            scored.append(rules.select(
                moment.alias("as_of"), "src", "dst", F.col("rule_score").alias("total_score"), "rule_triggered",
                (F.col("rule_score") > self.cfg.flag_above).alias("is_flagged"),
            ))
            degrees.append(state.select(F.lit(p).alias("pass"), "*"))
        union = lambda frames: reduce(lambda a, b: a.unionByName(b), frames)
        return union(scored), union(degrees)

    @cached_property
    def bulk_edges(self) -> DataFrame:
        """Who trades with whom: customer to supplier, supplier to part, customer to part.

        Equal edges are found on the numbers; names are made of what remains. A null key has no kind, so all nulls are one.
        """
        read = lambda name: self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        lines = read("orders").select("o_orderkey", F.col("o_custkey").alias("c")).join(
            read("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")),
            "o_orderkey",
        )
        kind = lambda k: F.when(F.col(k).isNotNull(), F.lit("csp".index(k)))
        ends = F.array(*[
            F.struct(kind(a).alias("a_kind"), F.col(a).alias("a"), kind(b).alias("b_kind"), F.col(b).alias("b")) for a, b in ("cs", "sp", "cp")
        ])
        found = lines.select(F.explode(ends).alias("e")).select("e.*").distinct()
        starts = F.array(*[F.lit(x) for x in ("c-", "s-", "p-")])
        node = lambda x: F.concat(F.get(starts, F.col(f"{x}_kind")), F.col(x).cast("string"))
        return materialize(found.select(node("a").alias("src"), node("b").alias("dst")), "bulk-edges")

    @cached_property
    def bulk_nodes(self) -> DataFrame:
        return materialize(self.bulk_edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct(), "bulk-nodes")

    @property
    def pass_scores(self) -> DataFrame:
        return self._passes[0]

    @property
    def pass_degrees(self) -> DataFrame:
        return self._passes[1]

    @cached_property
    def alerts(self) -> DataFrame:
        self.as_of_value  # both builds below read it
        found, scored = together(lambda: self.paths, lambda: self.pass_scores)
        return materialize(soc.alert_headers(scored, found.withColumn("as_of", self.as_of)), "alerts")

    @cached_property
    def history(self) -> DataFrame:
        """Per-event values of the three drift groups."""
        return self.tel.select(
            "ts",
            F.array(F.col("bytes_transferred").cast("double"), F.col("port").cast("double")).alias("behavioral"),
            F.array(F.hour("ts").cast("double"), F.weekday("ts").cast("double")).alias("temporal"),
            F.array(F.length("source_node").cast("double"), F.length("destination_node").cast("double")).alias("structural"),
        )

    @cached_property
    def history_shifted(self) -> DataFrame:
        """The same with a last week of larger transfers and, at some hours, longer names."""
        late = F.col("ts") >= self.as_of - F.make_dt_interval(days=F.lit(7))
        factor = F.when(late, 4.0).otherwise(1.0)
        longer = F.when(late & (F.hour("ts") < 6), 2.0).otherwise(0.0)
        return self.history.select(
            "ts", F.array(F.element_at("behavioral", 1) * factor, F.element_at("behavioral", 2)).alias("behavioral"), "temporal",
            F.transform("structural", lambda x: x + longer).alias("structural"),
        )


_tables: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _tables:
        _tables[key] = Tables(spark, sf_dir)
    return _tables[key]


def forget() -> None:
    """Build every table anew on next use (for cold timings)."""
    _tables.clear()
