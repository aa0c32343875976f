"""Drift checks work on equal values counted, not on one row per value of the history."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from palisade.operators import drift


def test_values_are_counted_once(spark, monkeypatch):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(hours=h), float(h % 5), float(h % 3)) for h in range(600)]
    history = spark.createDataFrame(rows, "ts timestamp, a double, b double").select(
        "ts", F.array("a", "b").alias("behavioral"), F.array("b").alias("temporal"), F.array("a").alias("structural")
    )
    stored, keep = {}, drift.materialize

    def recorded(df, name):
        out = keep(df, name)
        stored[name] = (out.count(), out.agg(F.sum("c")).first()[0] if "c" in out.columns else None)
        return out

    monkeypatch.setattr(drift, "materialize", recorded)
    found = drift.drift_check(history, F.lit(rows[-1][0])).collect()
    assert {r["feature_group"] for r in found} == set(drift.GROUPS)
    assert stored["counted"] == (2 * (5 + 3 + 3 + 5), 4 * 600)


def test_quantiles_without_counts(spark):
    values = spark.createDataFrame([("f", float(v)) for v in [1, 1, 1, 2, 5]], "feature string, v double")
    assert drift.exact_quantiles(values, [0.0, 0.5, 0.8, 1.0]).first()["edges"] == [1.0, 1.0, 2.0 + 3.0 * (4 * 0.8 - 3), 5.0]
