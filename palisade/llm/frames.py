"""Small helpers that the operators of this folder share."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.shipping import ship
from palisade.storage import materialize

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns that an operator uses, so that no other column can clash with its own."""
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key() -> Column:
    """128 bits of the text (null counts as empty): the identity of a text in joins."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def held_out(column: str, folds: int, fold: int) -> Column:
    """Whether a row is left out of learning: crc32 of the id as text, modulo ``folds``."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == fold, F.lit(False))


def row_ids() -> Iterator[int]:
    """Numbers that no other task of the job hands out. Store the table before using them as keys."""
    at = TaskContext.get().partitionId() << 40
    while True:
        yield at
        at += 1


def sample(df: DataFrame, rows: int, by: Column, label: str | None = None) -> DataFrame:
    """At most ``rows`` rows (of each non-null value of ``label``, whose values must be few), one for each value of ``by``.

    Those of smallest hash are taken, so the sample is the same in every run; rows equal in ``by`` count once, however
    many there are.
    """
    hashed = df.withColumn("_hash", F.xxhash64(by))
    if label is None:
        low = hashed.select("_hash").distinct().orderBy("_hash").limit(rows).agg(F.max("_hash")).first()[0]
        edge = F.lit(low)
    else:
        order = Window.partitionBy(label).orderBy("_hash")
        ranked = hashed.select(label, "_hash").distinct().withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= rows)
        edge = F.lit(None).cast("long")
        for r in ranked.groupBy(label).agg(F.max("_hash").alias("low")).collect():
            edge = F.when(F.col(label) == r[label], r["low"]).otherwise(edge)
    keys = ["_hash"] if label is None else [label, "_hash"]
    return hashed.where(F.col("_hash") <= edge).dropDuplicates(keys).select(df.columns)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: one computation, short lineage."""
    return materialize(df, name)


#: Bytes of a batch that goes to or comes from a Python worker, so that long texts bound the rows of a batch.
BATCH_BYTES = 8 << 20


def map_batches(df: DataFrame, run: Callable[[Batches], Batches], schema) -> DataFrame:
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(run, schema)
