"""PageRank and local clustering coefficient over the edge table."""

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.config import DEFAULT, Settings
from palisade.operators.skew import hot_keys, hubs, renamed, replicate, salted_join, spread
from palisade.storage import discard, materialize, store


def _links(edges: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Edges by (source, salt), partitioned and sorted as the rounds join them.

    Without hubs every salt is 0. A join leaves such a constant out of its keys, so it must not be
    part of the partitioning, or each round would move and sort all edges again. The number of
    partitions is given, as adaptive execution would otherwise merge some of them.
    """
    keys = ["node_id"] if hot is None else ["node_id", "_salt"]
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = spread(edges.select(F.col("src").alias("node_id"), "dst"), ["node_id"], hot, ["dst"])
    return ends.select(*keys, "dst").repartition(parts, *keys).sortWithinPartitions(*keys)


def _inflow(ranks: DataFrame, links: DataFrame, hot: DataFrame | None) -> DataFrame:
    """What each node receives in a round. ``links``: stored output of `_links`."""
    shares = ranks.where("out_degree is not null").select("node_id", (F.col("rank") / F.col("out_degree")).alias("share"))
    sent = shares if hot is None else replicate(shares, ["node_id"], hot)
    met = links.join(sent, [c for c in links.columns if c != "dst"])
    return met.groupBy(F.col("dst").alias("node_id")).agg(F.sum("share").alias("inflow"))


def pagerank(nodes: DataFrame, edges: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Unweighted PageRank with uniform dangling mass.

    Stops after the first round whose L1 change is below N * tolerance. If no round gets there the
    rank is 0.0 everywhere and ``converged`` is false.

    The edges are partitioned by (source, salt) once, sorted, and kept that way, so a round moves
    only ranks: they go to their edges, contributions are summed map-side, and the new ranks are
    stored. The driver reads two numbers per round.
    """
    ids = nodes.select("node_id")
    total = ids.count()
    degree = edges.groupBy("src").agg(F.count("*").alias("out_degree"))
    hot = renamed(hubs(edges, cfg).src, "src", "node_id")
    links = _links(edges, hot).persist(StorageLevel.MEMORY_AND_DISK)
    base = materialize(
        ids.join(degree.withColumnRenamed("src", "node_id"), "node_id", "left"), "rank-nodes"
    )

    def measure(ranks: DataFrame) -> tuple[float, float]:
        row = ranks.agg(
            F.sum("change").alias("change"),
            F.coalesce(F.sum(F.when(F.col("out_degree").isNull(), F.col("rank"))), F.lit(0.0)).alias("loose"),
        ).first()
        return row["change"], row["loose"]

    ranks = base.select("*", F.lit(1.0 / max(total, 1)).alias("rank"), F.lit(0.0).alias("change"))
    converged, previous, spark = False, None, nodes.sparkSession
    loose = measure(ranks)[1] if total else 0.0
    for round_no in range(cfg.rank_rounds if total else 0):
        received = _inflow(ranks, links, hot)
        fresh = cfg.damping * (F.coalesce("inflow", F.lit(0.0)) + F.lit(loose / total)) + F.lit(
            (1.0 - cfg.damping) / total
        )
        ranks, stored = store(
            ranks.select("node_id", "out_degree", F.col("rank").alias("old"))
            .join(received, "node_id", "left")
            .withColumn("rank", fresh)
            .select("node_id", "out_degree", "rank", F.abs(F.col("rank") - F.col("old")).alias("change")),
            f"rank-{round_no}",
        )
        if previous is not None:
            discard(spark, previous)
        previous = stored
        change, loose = measure(ranks)
        if change < total * cfg.rank_tolerance:
            converged = True
            break
    links.unpersist()
    value = F.col("rank") if converged else F.lit(0.0)
    return ranks.select("node_id", value.alias("pagerank"), F.lit(converged).alias("converged"))


def clustering(nodes: DataFrame, edges: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """2T / (d (d - 1)) on the undirected graph; 0 where the degree is below 2.

    Nodes are numbered by (degree, id) and each undirected edge points from its lower to its higher
    number. A node then has at most sqrt(2m) outgoing neighbours whatever its degree, so outgoing
    lists are bounded and a hub's list is short. Triangles are found per edge by intersecting two
    such lists of numbers: the neighbours of the lower end behind the higher one, and those of the
    higher end. Only edges whose higher end has a list travel, with what lies between its smallest and its largest number.
    Hot heads of edges are salted.
    """
    pair = edges.select(
        F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")
    ).where("a <> b").distinct()
    pair, pair_path = store(pair, "undirected")
    ends = pair.select(F.explode(F.array("a", "b")).alias("node_id"))
    counted = ends.groupBy("node_id").agg(F.count("*").alias("degree")).orderBy("degree", "node_id")
    degree = materialize(counted.withColumn("number", F.monotonically_increasing_id()), "degree")
    pairs = pair.count()
    hot = hot_keys(degree, ["node_id"], "degree", cfg, 2 * pairs)

    def numbered(df: DataFrame, end: str, other: str) -> DataFrame:
        return salted_join(
            df, degree.select(F.col("node_id").alias(end), F.col("number").alias(f"number_{end}")), [end],
            renamed(hot, "node_id", end), [other],
        ).drop(end)

    both = numbered(numbered(pair, "a", "b"), "b", "number_a")
    oriented, oriented_path = store(
        both.select(F.least("number_a", "number_b").alias("lo"), F.greatest("number_a", "number_b").alias("hi")), "oriented"
    )
    discard(edges.sparkSession, pair_path)
    tails = oriented.select(F.col("lo").alias("node"), F.col("hi").alias("next")).groupBy(F.col("node").alias("hi")).agg(
        F.min("next").alias("low"), F.max("next").alias("high")
    )
    heads = oriented.groupBy("hi").agg(F.count("*").alias("n"))
    hot_heads = hot_keys(heads, ["hi"], "n", cfg, pairs)
    marked = salted_join(oriented, tails, ["hi"], hot_heads, ["lo"], "left")
    listed = marked.groupBy("lo").agg(F.array_sort(F.collect_list(F.struct("hi", "low", "high"))).alias("above"))
    above = materialize(listed.select("lo", *[F.col(f"above.{c}").alias(n) for c, n in (("hi", "above"), ("low", "low"), ("high", "high"))]), "above")
    discard(edges.sparkSession, oriented_path)
    low, high = F.col("on.low"), F.col("on.high")
    behind = F.slice("above", F.col("at") + 2, F.size("above"))
    asked = (
        above.select("lo", "above", F.posexplode(F.arrays_zip("low", "high")).alias("at", "on"))
        .where(low.isNotNull() & (F.get("above", F.col("at") + 1) <= high) & (F.element_at("above", -1) >= low))
        .select("lo", F.get("above", F.col("at")).alias("hi"), F.filter(behind, lambda x: x.between(low, high)).alias("rest"))
    )
    per_edge = salted_join(
        asked, above.select(F.col("lo").alias("hi"), F.col("above").alias("above_hi")), ["hi"], hot_heads, ["lo"]
    ).select("lo", "hi", F.array_intersect("rest", "above_hi").alias("third")).where(F.size("third") > 0)
    closed = F.size("third").cast("bigint")
    corners = F.concat(
        F.array(F.struct(F.col("lo").alias("number"), closed.alias("t")), F.struct(F.col("hi").alias("number"), closed.alias("t"))),
        F.transform("third", lambda x: F.struct(x.alias("number"), F.lit(1).cast("bigint").alias("t"))),
    )
    counts = (
        per_edge.select(F.explode(corners).alias("c"))
        .groupBy(F.col("c.number").alias("number"))
        .agg(F.sum("c.t").alias("triangles"))
    )
    triangles = degree.join(counts, "number").select("node_id", "triangles")
    degree = degree.drop("number")
    d = F.col("degree")
    return (
        nodes.select("node_id")
        .join(degree, "node_id", "left")
        .join(triangles, "node_id", "left")
        .select(
            "node_id",
            F.coalesce("triangles", F.lit(0)).alias("triangles"),
            F.when(d >= 2, 2.0 * F.coalesce("triangles", F.lit(0)) / (d * (d - 1)).cast("double"))
            .otherwise(0.0)
            .alias("clustering"),
        )
    )
