"""Exact distributed quantiles, population stability and drift checks."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade import config as C
from palisade.config import DEFAULT, Settings
from palisade.functions import scalar as X
from palisade.storage import materialize

GROUPS = ("behavioral", "temporal", "structural")
_ACCURACY = 10_000


def counted(values: DataFrame) -> DataFrame:
    """Stored: rows of equal columns as one row with their number ``c``."""
    return materialize(values.groupBy(*values.columns).agg(F.count("*").alias("c")), "counted")


def exact_quantiles(values: DataFrame, probs: list[float], counts: DataFrame | None = None) -> DataFrame:
    """Linear-interpolated quantiles per ``feature`` of column ``v``: feature, n, edges.

    A sketch brackets each wanted rank; plain counts say how many values lie below each bracket;
    only the values inside the brackets that hold a wanted rank are sorted. The result is exact
    whatever the sketch says; its accuracy only decides how few values are sorted. There is one
    sketch row per feature, and the features are the fixed positions of the feature vector.
    ``counts``: `counted` rows of ``values``, if there are any; all but the sketch works on these.
    """
    near = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-2.0 / _ACCURACY, 2.0 / _ACCURACY)})
    sketch = materialize(
        values.groupBy("feature").agg(
            F.count("v").alias("n"),
            F.array_distinct(F.percentile_approx("v", near, _ACCURACY)).alias("cuts"),
        ),
        "sketch",
    )
    counts = counted(values.select("feature", "v")) if counts is None else counts
    celled = counts.where("v is not null").join(F.broadcast(sketch), "feature").select(
        "feature", "v", "c", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("cell")
    )
    below = Window.partitionBy("feature").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = materialize(
        celled.groupBy("feature", "cell").agg(F.sum("c").alias("held"))
        .withColumn("base", F.coalesce(F.sum("held").over(below), F.lit(0))),
        "cells",
    )
    points = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    wanted = sketch.where("n > 0").select("feature", "n", F.explode(points).alias("q")).select(
        "feature", "n", "q.i", ((F.col("n") - 1) * F.col("q.p")).alias("pos")
    )
    ranks = wanted.select("feature", F.explode(F.array(F.floor("pos"), F.ceil("pos"))).alias("rank")).distinct()
    placed = materialize(
        ranks.join(cells, "feature").where("rank >= base and rank < base + held").select("feature", "cell", "base", "rank"),
        "ranks",
    )
    # two ranks per quantile and feature: a fixed handful of rows
    inside = celled.join(F.broadcast(placed.select("feature", "cell").distinct()), ["feature", "cell"])
    upto = Window.partitionBy("feature", "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed_values = inside.groupBy("feature", "cell", "v").agg(F.sum("c").alias("c")).withColumn("hi", F.sum("c").over(upto))
    picked = materialize(
        placed_values.join(F.broadcast(placed), ["feature", "cell"])
        .where("rank - base < hi and rank - base >= hi - c")
        .select("feature", "rank", "v"),
        "picked",
    )
    low = picked.select("feature", F.col("rank").alias("r0"), F.col("v").alias("v0"))
    high = picked.select("feature", F.col("rank").alias("r1"), F.col("v").alias("v1"))
    pairs = (
        wanted.withColumns({"r0": F.floor("pos"), "r1": F.ceil("pos")})
        .join(low, ["feature", "r0"])
        .join(high, ["feature", "r1"])
    )
    value = F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("pos") - F.col("r0"))
    ordered = F.array_sort(F.collect_list(F.struct("i", value.alias("x"))))
    return pairs.groupBy("feature").agg(
        F.max("n").alias("n"), F.transform(ordered, lambda e: e.x).alias("edges")
    )


def psi(values: DataFrame, cfg: Settings = DEFAULT, counts: DataFrame | None = None) -> DataFrame:
    """Population stability index per feature. ``values``: feature, expected (boolean), v; ``counts``: its `counted` rows.

    Buckets are quantiles of the expected side. Values outside the expected range fall in no
    bucket but stay in the denominator; an empty share counts as 1e-6; a missing side gives 0.
    """
    b = cfg.psi_buckets
    counts = counted(values.select("feature", "expected", "v")) if counts is None else counts
    before = counts.where("expected").select("feature", "v", "c")
    cuts = exact_quantiles(values.where("expected").select("feature", "v"), [i / b for i in range(b + 1)], before)
    nudged = F.transform(
        "edges",
        lambda e, i: F.when(i == 0, e - 1e-9).when(i == b, e + 1e-9).otherwise(e),
    )
    cuts = cuts.select("feature", nudged.alias("edges"))
    at = F.size(F.filter("edges", lambda e: e <= F.col("v"))) - 1
    inside = (F.col("v") >= F.col("edges")[0]) & (F.col("v") <= F.col("edges")[b])
    tagged = counts.join(F.broadcast(cuts), "feature", "left").select(
        "feature", "expected", "c", F.when(inside, F.least(at, F.lit(b - 1))).alias("bucket")
    )
    held = tagged.groupBy("feature", "expected", "bucket").agg(F.sum("c").alias("c"))
    # from here on there are at most (buckets + 1) x 2 rows per feature
    per_side = Window.partitionBy("feature", "expected")
    shares = held.withColumn("share", F.col("c") / F.sum("c").over(per_side))

    def share(expected: bool, i: int) -> Column:
        hit = (F.col("expected") == expected) & (F.col("bucket") == i)
        return F.coalesce(F.max(F.when(hit, F.col("share"))), F.lit(1e-6))

    terms = [(share(False, i) - share(True, i)) * F.log(share(False, i) / share(True, i)) for i in range(b)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    both = (F.count_if(F.col("expected")) > 0) & (F.count_if(~F.col("expected")) > 0)
    return shares.groupBy("feature").agg(F.when(both, total).otherwise(0.0).alias("psi"))


def _long_form(history: DataFrame) -> DataFrame:
    """ts plus three arrays -> one row per value, feature = group:position."""
    first, second, third = GROUPS
    rows = history.select(
        "ts", F.size(first).alias("n1"), F.size(second).alias("n2"),
        F.posexplode(F.concat(*GROUPS)).alias("at", "v"),
    )
    group = F.when(F.expr("at < n1"), first).when(F.expr("at < n1 + n2"), second).otherwise(third)
    pos = F.expr("CASE WHEN at < n1 THEN at WHEN at < n1 + n2 THEN at - n1 ELSE at - n1 - n2 END")
    return rows.select(
        "ts", F.concat(group, F.lit(":"), pos.cast("string")).alias("feature"),
        F.col("v").cast("double").alias("v"),
    )


def retained(history: DataFrame, cfg: Settings = DEFAULT) -> DataFrame:
    """Rows within the rolling window that ends at the newest row."""
    newest = history.agg(F.max("ts")).scalar()
    return history.where(F.col("ts") >= newest - F.make_dt_interval(days=F.lit(cfg.drift_window_days)))


def drift_check(
    history: DataFrame, as_of: Column, cfg: Settings = DEFAULT, last_check: Column | None = None
) -> DataFrame:
    """Mean stability index per feature group, before against after ``as_of`` minus one interval.

    ``history``: ts, behavioral, temporal, structural (arrays). Nothing is checked when fewer than
    `drift_min_rows` rows are held, when one side is empty, or less than one interval (whole days)
    after ``last_check``.
    """
    kept = retained(history, cfg)
    if last_check is not None:
        days = F.floor((X.micros(as_of) - X.micros(last_check)) / F.lit(C.DAY_US))
        kept = kept.where(days >= cfg.drift_check_days)
    cutoff = X.micros(as_of) - F.lit(cfg.drift_check_days * C.DAY_US)
    rows = _long_form(kept).withColumn("expected", X.micros("ts") < cutoff)
    values = rows.select("feature", "expected", "v")
    counts = counted(values)
    enough = counts.groupBy(F.substring_index("feature", ":", 1).alias("feature_group"), "feature").agg(
        F.sum("c").alias("n"), F.sum(F.when(F.col("expected"), F.col("c"))).alias("before"),
        F.sum(F.when(~F.col("expected"), F.col("c"))).alias("after"),
    )
    enough = enough.where((F.col("n") >= cfg.drift_min_rows) & (F.col("before") > 0) & (F.col("after") > 0))
    scores = psi(values, cfg, counts)
    status = (
        F.when(F.col("psi_score") > cfg.psi_critical, "drift")
        .when(F.col("psi_score") > cfg.psi_warn, "moderate")
        .otherwise("stable")
    )
    return (
        enough.join(scores, "feature")
        .groupBy("feature_group")
        .agg(F.avg("psi").alias("psi_score"), F.count("*").alias("features"))
        .select(
            "feature_group", "psi_score", "features", status.alias("status"),
            (F.col("psi_score") > cfg.psi_critical).alias("triggered_retrain"), as_of.alias("detected_at"),
        )
    )


def drift_events(checks: DataFrame) -> DataFrame:
    return checks.where("triggered_retrain").select(
        X.natural_id("feature_group", X.micros("detected_at").cast("string")).alias("drift_id"),
        "detected_at", "feature_group", "psi_score", "triggered_retrain",
    )


def recent_drift_events(checks: DataFrame, limit: int = 20) -> DataFrame:
    return drift_events(checks).orderBy(F.desc("detected_at"), "feature_group").limit(limit)


def psi_summary(checks: DataFrame) -> DataFrame:
    """Latest index per group; 0 for a group never checked."""
    latest = checks.groupBy("feature_group").agg(F.max_by("psi_score", "detected_at").alias("psi"))
    spark = checks.sparkSession
    names = spark.range(1).select(F.explode(F.array(*[F.lit(g) for g in GROUPS])).alias("feature_group"))
    return names.join(latest, "feature_group", "left").select(
        "feature_group", F.coalesce("psi", F.lit(0.0)).alias("psi")
    )


def shadow_status(
    checks: DataFrame, as_of: Column, promotions: DataFrame | None = None, cfg: Settings = DEFAULT
) -> DataFrame:
    """A drift event starts shadow mode; it may be promoted after a week of whole days.

    ``promotions`` (ts): a promotion at or after the latest drift event ends shadow mode.
    """
    start = drift_events(checks).agg(F.max("detected_at").alias("shadow_start"))
    if promotions is not None:
        start = start.withColumn("promoted_at", promotions.agg(F.max("ts")).scalar())
    else:
        start = start.withColumn("promoted_at", F.lit(None).cast("timestamp"))
    on = F.col("shadow_start").isNotNull() & (
        F.col("promoted_at").isNull() | (F.col("promoted_at") < F.col("shadow_start"))
    )
    days = F.floor((X.micros(as_of) - X.micros("shadow_start")) / F.lit(C.DAY_US))
    return start.select(
        on.alias("in_shadow_mode"),
        F.when(on, F.col("shadow_start")).alias("shadow_start"),
        F.coalesce(on & (days >= cfg.shadow_days), F.lit(False)).alias("can_promote"),
    )
