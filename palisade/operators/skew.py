"""Joins and running totals that stay balanced when one key holds a large share of the rows.

A key is *hot* when it holds more than 1/hot_share of the table (and more than hot_min_rows rows),
so the list of hot keys always has fewer than hot_share rows: that is the proven bound under which
it is broadcast. Everything else goes through ordinary shuffles.
"""

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.config import DEFAULT, Settings
from palisade.storage import materialize


def hot_keys(
    counts: DataFrame, keys: Sequence[str], n: str, cfg: Settings = DEFAULT, rows: int | None = None
) -> DataFrame | None:
    """Hot keys with their number of parts (key, _parts), stored; None if there are none.

    ``counts`` holds one row per key with its row count ``n``. ``rows``, where the caller knows the
    total, answers at once for a table too small to have hot keys.
    """
    if rows is not None and rows <= cfg.hot_min_rows:
        return None
    total = counts.select(n).agg(F.sum(n)).scalar()
    share = F.ceil(F.col(n) * cfg.hot_share / total)
    size = F.ceil(F.col(n) / F.lit(cfg.hot_min_rows))
    found = counts.where((F.col(n) > cfg.hot_min_rows) & (F.col(n) * cfg.hot_share > total)).select(
        *keys, F.least(share, size).cast("int").alias("_parts")
    )
    hot = materialize(found, "hot")
    return None if hot.isEmpty() else hot


class Hubs(NamedTuple):
    """Hot sources and hot targets of an edge table (src / dst, _parts); None where there are none."""

    rows: int
    src: DataFrame | None
    dst: DataFrame | None


def hubs(edges: DataFrame, cfg: Settings = DEFAULT) -> Hubs:
    """The hubs of a stored edge table, found once for all operators that are given the same table."""
    known = edges.__dict__.setdefault("_palisade_hubs", {})
    if cfg not in known:
        rows = edges.count()
        ends = [
            hot_keys(edges.groupBy(end).agg(F.count("*").alias("n")), [end], "n", cfg, rows) for end in ("src", "dst")
        ]
        known[cfg] = Hubs(rows, *ends)
    return known[cfg]


def renamed(hot: DataFrame | None, old: str, new: str) -> DataFrame | None:
    return hot if hot is None or old == new else hot.withColumnRenamed(old, new)


def spread(df: DataFrame, keys: Sequence[str], hot: DataFrame | None, by: Sequence[str]) -> DataFrame:
    """Add ``_salt``: rows of a hot key are spread over its parts by a hash of ``by``.

    The salt depends on row content only, so a re-run task sends each row to the same place.
    """
    if hot is None:
        return df.withColumn("_salt", F.lit(0))
    salt = F.pmod(F.xxhash64(*by), F.col("_parts").cast("bigint")).cast("int")
    return (
        df.join(F.broadcast(hot), list(keys), "left")
        .withColumn("_salt", F.coalesce(salt, F.lit(0)))
        .drop("_parts")
    )


def replicate(df: DataFrame, keys: Sequence[str], hot: DataFrame | None) -> DataFrame:
    """One copy of each row per part of its key (a single copy for ordinary keys)."""
    if hot is None:
        return df.withColumn("_salt", F.lit(0))
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    return (
        df.join(F.broadcast(hot), list(keys), "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_parts")
    )


def salted_join(
    facts: DataFrame,
    side: DataFrame,
    keys: Sequence[str],
    hot: DataFrame | None,
    by: Sequence[str],
    how: str = "inner",
) -> DataFrame:
    """Equi-join of ``facts`` with a table that has few rows per key; hot keys are salted."""
    if hot is None:
        return facts.join(side, list(keys), how)
    left = spread(facts, keys, hot, by)
    right = replicate(side, keys, hot)
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def running(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    order: Sequence[Column],
    measures: dict[str, tuple[str, Column]],
    hot: DataFrame | None,
    cfg: Settings = DEFAULT,
) -> DataFrame:
    """Running sum or max per key in ``order``, computed slice by slice for hot keys.

    The timeline of a hot key (``at``, in microseconds) is cut into slices. Rows are ranked inside
    their slice only; what earlier slices contribute comes from one total per slice, combined
    map-side. A window partition therefore holds one slice of a hot key, or one ordinary key.
    """
    fold = {"sum": F.sum, "max": F.max}
    if hot is None:
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[fold[kind](col).over(whole).alias(name) for name, (kind, col) in measures.items()])
    sliced = (
        df.join(
            F.broadcast(hot.select(*keys, F.lit(True).alias("_hot"))), list(keys), "left"
        )
        .withColumn(
            "_slice",
            F.when(F.col("_hot"), F.floor(F.col(at) / cfg.slice_us)).otherwise(F.lit(0)).cast("bigint"),
        )
        .drop("_hot")
    )
    part = [*keys, "_slice"]
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)

    totals = sliced.groupBy(*part).agg(
        *[fold[kind](col).alias(f"_t_{name}") for name, (kind, col) in measures.items()]
    )
    carried = totals.select(
        *part,
        *[fold[kind](f"_t_{name}").over(before).alias(f"_c_{name}") for name, (kind, _) in measures.items()],
    )
    ranked = sliced.select(
        "*", *[fold[kind](col).over(inside).alias(f"_r_{name}") for name, (kind, col) in measures.items()]
    )
    joined = ranked.join(carried, part, "left")
    out = []
    for name, (kind, _) in measures.items():
        own, prior = F.col(f"_r_{name}"), F.col(f"_c_{name}")
        out.append(
            (F.coalesce(own + prior, own) if kind == "sum" else F.greatest(own, prior)).alias(name)
        )
    return joined.select(*df.columns, *out)
