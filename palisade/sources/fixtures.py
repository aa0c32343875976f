"""Telemetry projected from the benchmark `events` table, and the same events as nine raw sources."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade import config as C


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("string").alias("u"),
        F.col("user_id").alias("user_id"),
        "event_type",
        "value",
        F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("k"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k, u = F.col("event_type"), F.col("k"), F.col("u")
    ports = F.array(*[F.lit(p) for p in (22, 3389, 445, 135)])
    tools = F.array(*[F.lit(p) for p in ("psexec", "ssh", "rdp", "wmi", "winrm", "dcom", "powershell")])
    user = F.concat(F.lit("usr-"), u)
    return events(spark, sf_dir).select(
        "event_id",
        "ts",
        F.when(e.isin("signup", "view"), user).otherwise(F.concat(F.lit("wl-"), u)).alias("source_node"),
        F.when(e == "view", F.concat(F.lit("wl-"), (F.col("user_id") % 100).cast("string")))
        .when(e == "purchase", F.concat(F.lit("db-"), (k % 10).cast("string")))
        .otherwise(F.concat(F.lit("wl-"), k.cast("string")))
        .alias("destination_node"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")).alias("source_ip"),
        F.concat(F.lit("10.1.0."), k.cast("string")).alias("destination_ip"),
        F.when(e == "signup", "authentication")
        .when(e == "view", "application")
        .when(e == "error", "process_exec")
        .otherwise("network_flow")
        .alias("event_type"),
        F.when(e == "view", "UDP").otherwise("TCP").alias("protocol"),
        F.when(e == "purchase", 5432)
        .when(e == "error", F.element_at(ports, k % 4 + 1))
        .otherwise(443)
        .alias("port"),
        (F.col("value") * 1000).cast("bigint").alias("bytes_transferred"),
        user.alias("user"),
        F.when(e == "purchase", "postgres")
        .when(e == "error", F.element_at(tools, k % 7 + 1))
        .otherwise("chrome")
        .alias("process"),
        (e != "error").alias("success"),
    )


def raw_sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Nine frames with nine vocabularies; together they hold every row of `events` once."""
    base = events(spark, sf_dir).withColumn("tag", F.col("k") % len(C.SOURCE_TAGS))
    k, u = F.col("k"), F.col("u")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    iso_short = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    plain = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    epoch = F.unix_micros("ts") / F.lit(1e6)
    size = (F.col("value") * 1000).cast("bigint").cast("string")
    wl_u, wl_k, usr = F.concat(F.lit("wl-"), u), F.concat(F.lit("wl-"), k.cast("string")), F.concat(F.lit("usr-"), u)
    port = F.when(k % 18 == 9, "n/a").when(k % 18 == 0, " 5432 ").otherwise((k + 20).cast("string"))

    def source(tag: int, **columns) -> DataFrame:
        fixed = {"event_id": F.col("event_id"), "event_type": F.lit(C.SOURCE_TAGS[tag])}
        return base.where(F.col("tag") == tag).select(*[v.alias(n) for n, v in {**fixed, **columns}.items()])

    return [
        source(0, timestamp=F.col("ts"), src_ip=F.concat(F.lit("10.0.0."), u), dst_ip=F.concat(F.lit("10.1.0."), k.cast("string")),
               dst_port=port, bytes=size, protocol=F.lit("tcp")),
        source(1, timestamp=iso_short, src_host=wl_u, dst_host=wl_k, process_name=F.lit("PsExec"), username=usr),
        source(2, timestamp=epoch, source_id=usr, dest_id=F.concat(F.lit("db-"), (k % 10).cast("string")),
               user=usr, result=F.when(F.col("event_type") == "error", "False").otherwise("ok")),
        source(3, timestamp=plain, src_node=wl_u, dst_node=F.when(k % 2 == 0, wl_k).otherwise(F.lit("")), process=F.lit("Bash")),
        source(4, timestamp=iso, source_node=usr, destination_node=wl_k, success=F.when(k % 2 == 0, "true").otherwise("0")),
        source(5, timestamp=F.lit("yesterday"), source_node=wl_u, destination_node=wl_k, bytes_transferred=size, protocol=F.lit("udp")),
        source(6, timestamp=iso, source_node=F.lit(""), src_host=wl_u, dst_host=F.lit("resolver"), port=F.lit("53"),
               bytes=F.when(k % 4 == 0, "12.5").otherwise(size)),
        source(7, source_ip=F.lit("172.16.0.1"), src_ip=F.lit("172.16.0.2"), destination_ip=F.lit("10.2.0.1"),
               user=usr, timestamp=iso_short, success=F.lit("")),
        source(8, timestamp=iso, src_node=wl_u, source_id=usr, dst_node=F.lit("db-files"), process_name=F.lit("CMD"), port=F.lit(445.0)),
    ]
