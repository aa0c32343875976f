"""Trailing time windows, exact and balanced.

Two forms. `trailing_at_last` gives each key's statistics as of its last event with two passes of
plain aggregation (find the last event; count what lies within reach of it). `trailing_series`
gives them at every event as differences of running totals, so the cost per event does not depend
on how many events the window holds.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.config import DEFAULT, MINUTE_US, Settings
from palisade.operators.skew import hot_keys, running, salted_join
from palisade.storage import materialize


def trailing_at_last(
    rows: DataFrame, keys: Sequence[str], spans: dict[str, int], cfg: Settings = DEFAULT,
    deviation: bool = False, last: DataFrame | None = None,
) -> DataFrame:
    """``rows``: keys, event_id, at (micros), value. Adds count, rate per minute and mean per span.

    ``last``, if it is stored already: keys, last_at, n (rows) of every key without nulls.
    """
    keys = list(keys)
    if last is None:
        last = materialize(rows.groupBy(*keys).agg(F.max("at").alias("last_at"), F.count("*").alias("n")), "last")
    hot = hot_keys(last, keys, "n", cfg, last.agg(F.sum("n")).first()[0] or 0)
    reach = salted_join(rows, last.select(*keys, "last_at"), keys, hot, ["event_id", "at"]).where(
        F.col("at") >= F.col("last_at") - F.lit(max(spans.values()))
    )
    aggs, out = [], []
    for name, span in spans.items():
        value = F.when(F.col("at") >= F.col("last_at") - F.lit(span), F.col("value"))
        aggs += [F.count(value).alias(f"{name}_count"), F.sum(value).alias(f"{name}_sum")]
        if deviation:
            aggs.append(F.stddev_samp(value.cast("double")).alias(f"{name}_std"))
        out += [
            F.col(f"{name}_count"),
            rate(F.col(f"{name}_count"), span).alias(f"{name}_rate"),
            (F.col(f"{name}_sum") / F.col(f"{name}_count")).alias(f"{name}_mean"),
        ]
        if deviation:
            out.append(F.coalesce(f"{name}_std", F.lit(0.0)).alias(f"{name}_std"))
    return reach.groupBy(*keys, "last_at").agg(*aggs).select(*keys, "last_at", *out)


def rate(count: Column, span_us: int) -> Column:
    return count / F.lit(span_us / MINUTE_US)


def trailing_series(
    rows: DataFrame, keys: Sequence[str], spans: dict[str, int], cfg: Settings = DEFAULT
) -> DataFrame:
    """Per event: count, mean, sample deviation and rate over each span ending at that event.

    An event counts towards windows that end up to ``span`` later, both ends included; events with
    equal times see each other. Rows are told apart by their content, not by their id: equal rows are
    one row with a number until the end, so ids may repeat or be empty. Each event asks for the running total at its own time and just
    before the start of each window; the answers are subtracted. Sums are exact integers.
    """
    keys = list(keys)
    row = [*keys, "event_id", "event_at", "value"]
    rows = rows.groupBy(*keys, "event_id", F.col("at").alias("event_at"), "value").agg(F.count("*").alias("times"))
    value, times = F.col("value").cast("decimal(19,0)"), F.col("times").cast("decimal(19,0)")
    nothing = F.lit(0).cast("decimal(38,0)")

    def mark(kind: int, at: Column, span: str | None, counted: bool) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            at.alias("at"),
            F.lit(span).cast("string").alias("span"),
            (F.col("times") if counted else F.lit(0).cast("bigint")).alias("one"),
            ((times * value).cast("decimal(38,0)") if counted else nothing).alias("v"),
            ((value * value).cast("decimal(38,0)") * F.col("times") if counted else nothing).cast("decimal(38,0)").alias("vv"),
        )

    # kind orders marks of equal time: window starts, then events, then window ends.
    at = F.col("event_at")
    marks = [mark(1, at, None, True), mark(2, at, None, False)]
    marks += [mark(0, at - F.lit(span), name, False) for name, span in spans.items()]
    timeline = rows.select(*row, "times", F.explode(F.array(*marks)).alias("m")).select(*row, "times", "m.*")
    hot = hot_keys(rows.groupBy(*keys).agg(F.count("*").alias("n")), keys, "n", cfg)
    measures = {
        "cum_n": ("sum", F.col("one")), "cum_v": ("sum", F.col("v")), "cum_vv": ("sum", F.col("vv")),
    }
    totals = running(timeline, keys, "at", [F.col("at"), F.col("kind")], measures, hot, cfg).where("kind <> 1")

    aggs = []
    for name in spans:
        sign = F.when(F.col("kind") == 2, 1).when(F.col("span") == name, -1)
        aggs += [
            F.sum(sign * F.col("cum_n")).alias(f"{name}_n"),
            F.sum(sign * F.col("cum_v")).alias(f"{name}_v"),
            F.sum(sign * F.col("cum_vv")).alias(f"{name}_vv"),
        ]
    out = []
    for name, span in spans.items():
        n, v, vv = (F.col(f"{name}_{x}") for x in ("n", "v", "vv"))
        # n*vv - v*v is a whole number, so the variance loses nothing to cancellation.
        spread = (n * vv - v * v).cast("double") / (n * (n - 1)).cast("double")
        out += [
            n.alias(f"{name}_count"),
            (v.cast("double") / n).alias(f"{name}_mean"),
            F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), spread))).otherwise(0.0).alias(f"{name}_std"),
            rate(n, span).alias(f"{name}_rate"),
        ]
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))
    found = totals.groupBy(*row, "times").agg(*aggs).select(*row, "times", *out).withColumn("_copy", each)
    return found.drop("times", "_copy").withColumnsRenamed({"event_at": "at"})
