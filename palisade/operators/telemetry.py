"""Raw events of any source -> canonical telemetry."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import config as C
from palisade import schemas
from palisade.functions import scalar as X


def union_sources(*sources: DataFrame) -> DataFrame:
    """One frame over all sources; keys that a source lacks are null. Every key becomes text."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(as_text, sources))


#: Keys whose values must be whole numbers.
WHOLE_KEYS = (*C.FIELD_KEYS["port"], *C.FIELD_KEYS["bytes_transferred"])
_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text that loses nothing of its type, whatever the session's time zone.

    Points in time become epoch seconds with six decimals (times without a zone count as UTC), and
    numbers in a key of whole numbers are cut to whole ones; text stays as it is.
    """
    seconds = lambda micros: (micros.cast("decimal(24,0)") / F.lit(C.MICROS)).cast("decimal(24,6)").cast("string")

    def column(name: str, kind: str) -> Column:
        value = F.col(f"`{name}`")
        if kind == "timestamp":
            value = seconds(F.unix_micros(value))
        elif kind == "timestamp_ntz":
            value = seconds(F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, `{name}`)"))
        elif kind == "date":
            value = seconds(F.unix_date(value).cast("bigint") * C.DAY_US)
        elif kind in ("float", "double") or kind.startswith("decimal"):
            if name in WHOLE_KEYS:
                value = F.coalesce(value.try_cast("decimal(38,6)").try_cast("bigint").cast("string"), value.cast("string"))
            elif name == "timestamp":
                value = F.coalesce(value.try_cast("decimal(24,6)").cast("string"), value.cast("string"))
        return value.cast("string").alias(name)

    return df.select(*[column(name, kind) for name, kind in df.dtypes])


def _first(raw: DataFrame, keys) -> Column:
    present = [F.col(k).cast("string") for k in keys if k in raw.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def resolve_node(raw: DataFrame, direction: str) -> Column:
    """First non-empty endpoint key."""
    present = [
        F.nullif(F.col(k).cast("string"), F.lit(""))
        for k in C.ENDPOINT_KEYS[direction]
        if k in raw.columns
    ]
    return F.coalesce(*present, F.lit(f"unknown-{direction}"))


def _typed(raw: DataFrame, as_of: Column) -> DataFrame:
    """Canonical columns plus ``reject_reason`` (null for a good row)."""
    raw = as_text(raw)
    pick = {name: _first(raw, keys) for name, keys in C.FIELD_KEYS.items()}
    plain = {k: _first(raw, (k,)) for k in ("event_id", "timestamp", "event_type", "protocol")}
    port = X.whole_number(pick["port"], "int")
    size = X.whole_number(pick["bytes_transferred"], "bigint")
    reason = (
        F.when(pick["port"].isNotNull() & port.isNull(), F.lit("port"))
        .when(pick["bytes_transferred"].isNotNull() & size.isNull(), F.lit("bytes_transferred"))
    )
    return raw.select(
        F.coalesce(plain["event_id"], F.lit("")).alias("event_id"),
        X.parse_timestamp(plain["timestamp"], as_of).alias("ts"),
        resolve_node(raw, "source").alias("source_node"),
        resolve_node(raw, "destination").alias("destination_node"),
        F.coalesce(pick["source_ip"], F.lit("")).alias("source_ip"),
        F.coalesce(pick["destination_ip"], F.lit("")).alias("destination_ip"),
        F.coalesce(plain["event_type"], F.lit("network_flow")).alias("event_type"),
        F.upper(F.coalesce(plain["protocol"], F.lit("TCP"))).alias("protocol"),
        F.coalesce(port, F.lit(0)).alias("port"),
        F.coalesce(size, F.lit(0).cast("bigint")).alias("bytes_transferred"),
        F.coalesce(pick["user"], F.lit("")).alias("user"),
        F.lower(F.coalesce(pick["process"], F.lit(""))).alias("process"),
        F.coalesce(X.truthy(pick["success"]), F.lit(True)).alias("success"),
        reason.alias("reject_reason"),
    )


def normalize(raw: DataFrame, as_of: Column) -> DataFrame:
    """Good rows as canonical telemetry. ``as_of`` replaces a timestamp that cannot be read."""
    return _typed(raw, as_of).where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejects(raw: DataFrame, as_of: Column) -> DataFrame:
    """Quarantine: rows whose port or byte count is not a whole number, with the field at fault."""
    return (
        _typed(raw, as_of)
        .where(F.col("reject_reason").isNotNull())
        .select("event_id", "source_node", "destination_node", "event_type", "reject_reason")
    )


def parse_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """JSON text -> raw keys. ``_bad`` keeps the text of a message that is no JSON object with a known key.

    JSON numbers such as 443.0 in a key of whole numbers are cut as `as_text` does; JSON text is not.
    """
    text = F.col(value).cast("string")
    parsed = F.from_json(
        text, schemas.RAW + ", `_bad` string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    )
    numbers = F.from_json(text, ", ".join(f"`{k}` double" for k in WHOLE_KEYS))
    rows = messages.select(text.alias("_text"), parsed.alias("m"), numbers.alias("x")).select("_text", "x", "m.*")
    whole = {
        k: F.when(F.col(k).rlike("[.eE]"), F.coalesce(F.col(f"x.{k}").try_cast("bigint").cast("string"), F.col(k))).otherwise(F.col(k))
        for k in WHOLE_KEYS
    }
    known = F.coalesce(*[F.col(k) for k in schemas.RAW_KEYS]).isNotNull()
    bad = F.when(F.col("_bad").isNotNull() | ~known, F.coalesce("_bad", "_text", F.lit("")))
    return rows.withColumns({**whole, "_bad": bad}).drop("_text", "x")


def endpoints(tel: DataFrame) -> DataFrame:
    """Two rows per event: its source (the port says nothing about it) and its destination."""

    def side(role: int, node: str, ip: str, port: Column) -> Column:
        kind = X.node_type(F.col(node), port)
        return F.struct(
            F.lit(role).alias("role"),
            F.col(node).alias("node_id"),
            kind.alias("node_type"),
            X.node_sensitivity(F.col(node), port).alias("sensitivity"),
            F.col(ip).alias("ip_address"),
            (kind == "asset").alias("is_critical"),
        )

    both = F.array(
        side(0, "source_node", "source_ip", F.lit(0)),
        side(1, "destination_node", "destination_ip", F.col("port")),
    )
    return tel.select(
        "event_id", "ts", "bytes_transferred",
        (F.col("source_node") == F.col("destination_node")).alias("self_loop"),
        F.explode(both).alias("e"),
    ).select("event_id", "ts", "bytes_transferred", "self_loop", "e.*")
