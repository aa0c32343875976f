"""Column expressions. All are built-in functions, so they stay inside whole-stage codegen."""

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade import config as C
from palisade.config import DEFAULT, Settings


def micros(ts) -> Column:
    return F.unix_micros(ts)


def _text(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def whole_number(text: Column, kind: str) -> Column:
    """Integer text (spaces and a sign allowed) as ``kind``; null for anything else."""
    return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), text.try_cast(kind))


def parse_timestamp(text: Column, as_of: Column) -> Column:
    """ISO with Z (fraction optional), ``date time``, or epoch seconds (also 1.7e9); ``as_of`` for the rest."""
    iso = r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?Z$"
    plain = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"
    epoch = r"^-?\d+(\.\d+)?([eE][+-]?\d{1,2})?$"
    parsed = (
        F.when(text.rlike(iso), text.try_cast("timestamp"))
        .when(text.rlike(plain), F.concat(text, F.lit("Z")).try_cast("timestamp"))
        .when(
            text.rlike(epoch),
            F.timestamp_micros(F.round(text.try_cast("decimal(24,6)") * C.MICROS).try_cast("bigint")),
        )
    )
    return F.coalesce(parsed, as_of)


def truthy(text: Column) -> Column:
    return ~F.lower(F.trim(text)).isin("false", "f", "no", "n", "0", "0.0", "")


def is_asset(node: Column, port: Column) -> Column:
    return node.startswith("db-") | port.isin(*C.DB_PORTS)


def node_type(node: Column, port: Column) -> Column:
    return (
        F.when(is_asset(node, port), "asset")
        .when(node.startswith("usr-"), "user")
        .otherwise("workload")
    )


def node_sensitivity(node: Column, port: Column) -> Column:
    return (
        F.when(is_asset(node, port), C.CRITICAL)
        .when(port.isin(*C.SENSITIVE_PORTS), C.HIGH)
        .otherwise(C.LOW)
    )


def is_suspicious_process(process: Column) -> Column:
    return process.isin(*C.SUSPICIOUS_PROCESSES)


def runs_lateral_tool(process: Column) -> Column:
    return F.lower(process).rlike("|".join(C.LATERAL_TOOLS))


def in_business_hours(ts: Column) -> Column:
    return F.hour(ts).between(8, 18) & (F.weekday(ts) < 5)


def time_encoding(ts: Column) -> list[Column]:
    """sin/cos of the hour of day and of the weekday (Monday = 0)."""
    hour = F.hour(ts) * (2 * math.pi / 24)
    day = F.weekday(ts) * (2 * math.pi / 7)
    return [F.sin(hour), F.cos(hour), F.sin(day), F.cos(day)]


def age_hours(since: Column, as_of: Column) -> Column:
    return (micros(as_of) - micros(since)) / F.lit(float(C.HOUR_US))


def is_sensitive(level: Column, critical: Column) -> Column:
    return F.coalesce((level >= C.HIGH) | critical, F.lit(False))


def novelty(first_seen: Column, sensitive: Column, as_of: Column, cfg: Settings = DEFAULT) -> Column:
    """Falls linearly from the boost to 0 over the first hour of an edge."""
    age = age_hours(first_seen, as_of)
    boost = F.when(sensitive, cfg.novelty_sensitive).otherwise(cfg.novelty_other)
    return F.when(age < cfg.novelty_hours, boost * (1.0 - age / cfg.novelty_hours)).otherwise(0.0)


def deviation(current_count: Column, short_count: Column, cfg: Settings = DEFAULT) -> Column:
    """Relative gap between the current and the day-long event rate, in [0, 1]; 0 if never seen."""
    now = current_count / F.lit(cfg.current_us / C.MINUTE_US)
    base = short_count / F.lit(cfg.short_us / C.MINUTE_US)
    return F.coalesce(
        F.when(base == 0, F.least(F.lit(1.0), now)).otherwise(
            F.least(F.lit(1.0), F.abs(now - base) / base)
        ),
        F.lit(0.0),
    )


def weight(frequency: Column, sensitivity: Column, dev: Column, cfg: Settings = DEFAULT) -> Column:
    return cfg.w_frequency * frequency + cfg.w_sensitivity * sensitivity + cfg.w_deviation * dev


def decayed(value: Column, last_seen: Column, as_of: Column, cfg: Settings = DEFAULT) -> Column:
    idle = F.greatest(F.lit(0.0), age_hours(last_seen, as_of))
    return F.greatest(F.lit(0.0), value * F.exp(-cfg.decay_per_hour * idle))


def impact(level: Column, critical: Column) -> Column:
    by_level = F.coalesce(*[F.when(level == k, v) for k, v in C.IMPACT.items()], F.lit(0.1))
    bonus = F.when(critical, C.CRITICAL_BONUS).otherwise(0.0)
    return F.when(level.isNull(), C.UNKNOWN_IMPACT).otherwise(by_level + bonus)


def risk_class(risk: Column, cfg: Settings = DEFAULT) -> Column:
    return (
        F.when(risk > cfg.isolate_above, "AUTO_ISOLATE")
        .when(risk > cfg.soc_above, "SOC_ALERT")
        .otherwise("MONITOR")
    )


def severity(risk: Column) -> Column:
    return (
        F.when(risk > 0.8, "CRITICAL")
        .when(risk > 0.5, "HIGH")
        .when(risk > 0.2, "MEDIUM")
        .otherwise("LOW")
    )


def undetected_probability(hops: Column, cfg: Settings = DEFAULT) -> Column:
    return F.pow(F.lit(1.0 - cfg.p_detect), hops.cast("double"))


def natural_id(*parts) -> Column:
    """Deterministic id of a natural key (stands in for a random one)."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def fill(template: str, **values: Column) -> Column:
    """``template`` with each {name} replaced by a column; null if a column is null."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def two_places(name: str) -> Column:
    """Text with two decimals, halves to even."""
    return F.call_function("format_number", F.col(name), F.lit("0.00"))
