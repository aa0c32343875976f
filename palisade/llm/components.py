"""Connected components of any number of edges, by alternating stars, with every round written to the shared folder."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.frames import store
from palisade.storage import discard
from palisade.storage import store as store_at


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that is not the smallest of its component; ``edges`` has columns a and b.

    A round points every neighbour of a node, first the larger and then the smaller ones, at the smallest that the node
    sees, until each component is one star. The number of rounds grows with the logarithm of the longest path. The
    minimum of a node is combined before the shuffle and joined back, so a node of a million neighbours is no hot group.
    """
    spark = edges.sparkSession
    now, path = store_at(_oriented(edges), "components")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = _oriented(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(least, "a")
        small = _oriented(pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(pairs.select("a", F.col("m").alias("b"))))
        following, new_path = store_at(small, "components")
        discard(spark, path)
        now, path, before, mark = following, new_path, mark, _mark(following)
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _oriented(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller end; no loops."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def with_roots(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node, the smallest of each component included, stored."""
    stars = components(edges)
    return store(stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()), name)
