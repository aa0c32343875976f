from palisade.llm import lm
from palisade.llm.frames import held_out
from tests.llm import brute
from tests.llm.conftest import SF

NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = brute.rows_of(lm.op10_lm(spark, SF), *NAMES)
    brute.same(found, brute.language_model(brute.rows_of(docs, "doc_id", "text"), lm.BACKOFF))
    held = [r for r in found if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)  # the model predicts unseen texts better


def test_awkward_rows(spark, awkward):
    found = brute.rows_of(lm.score(awkward, held_out("doc_id", 7, 2)), *NAMES)
    brute.same(found, brute.language_model(brute.rows_of(awkward, "doc_id", "text"), lm.BACKOFF))


def test_no_training_and_no_documents(spark, awkward, no_documents):
    from pyspark.sql import functions as F

    assert lm.score(no_documents, held_out("doc_id", 7, 2)).count() == 0
    found = brute.rows_of(lm.score(awkward, F.lit(True)), *NAMES)
    assert all(r[1] and r[3] == 0 and r[4] == 0 for r in found) and len(found) == awkward.count()
