"""From raw documents to training tokens: five stages, each written as Parquet and read again by the next.

| stage | keeps |
|---|---|
| quality | documents that the weakly supervised scorer takes for good |
| near_duplicates | of each group of equal or similar texts the one of smallest doc_id |
| decontaminate | documents without a window of a benchmark item |
| secrets | all, with spans of live or weak secrets replaced by a mark (n_chars follows) |
| tokens | all: doc_id, n_tokens, ids_sha256, decoded_sha256, ids |

All stages but the last return the columns of documents. Model fitting and similarity can't be expressed in SQL, so
there is no ORACLE_SQL; tests compare the stages with plain versions.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import bpe, jaccard, positional, secrets
from palisade.llm import quality as scorer
from palisade.llm.frames import store, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return scorer.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return positional.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, F.col("doc_id"), F.col("source"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, with_ids=True)


STAGES = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secret_scan),
    ("tokens", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the result of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
