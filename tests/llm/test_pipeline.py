"""The stages one after the other against plain versions of what each keeps."""

from pyspark.sql import functions as F

import corpus_pipeline
from palisade.llm import bpe, positional, quality, secrets
from palisade.llm.frames import store
from tests.llm import brute
from tests.llm.conftest import SF
from tests.llm.test_jaccard import brute_force as near
from tests.llm.test_secrets import base


def test_stages_against_plain_versions(spark):
    docs = store(spark.read.parquet(f"{SF}/documents.parquet"), "test-docs")
    items = brute.rows_of(spark.read.parquet(f"{SF}/benchmark.parquet"), "item_id", "text")
    columns, passed = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = store(stage(spark, docs, SF), "test-stage")
        passed[name] = (docs, out)
        docs = out
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert all(out.columns == columns for name, (_, out) in passed.items() if name != "tokens")
    before, after = passed["quality"]
    assert ids(after) == ids(quality.classify(before).where("keep")) and after.count() < before.count()
    before, after = passed["near_duplicates"]
    assert ids(after) == {r[3] for r in near(brute.rows_of(before, "doc_id", "text"))} and after.count() < before.count()
    before, after = passed["decontaminate"]
    clean = {r[0] for r in brute.decontaminate(brute.rows_of(before, "doc_id", "text"), items) if not r[5]}
    assert ids(after) == clean and after.count() < before.count()
    before, after = passed["secrets"]
    old, new = dict(brute.rows_of(before, "doc_id", "text")), dict(brute.rows_of(after, "doc_id", "text"))
    assert old.keys() == new.keys()
    spans = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(before, F.col("doc_id"), F.col("source")).collect()}
    assert all((old[i] == new[i]) or spans[i] for i in old) and any(old[i] != new[i] for i in old)
    assert all(not base(new[i])[1] for i in old if not base(old[i])[1])
    before, after = passed["tokens"]
    brute.same(brute.rows_of(after, "doc_id", "ids_sha256"), brute.rows_of(bpe.encode(before), "doc_id", "ids_sha256"))


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert 0 < out.count() < spark.read.parquet(f"{SF}/documents.parquet").count()


def test_awkward_documents_go_through_every_stage(spark, awkward, no_documents):
    for docs in (awkward, no_documents):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() <= docs.count()


def test_windows_import():
    assert positional.WINDOW == 10
