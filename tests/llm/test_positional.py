import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import positional
from palisade.llm.words import pack
from tests.llm import brute
from tests.llm.conftest import SF

NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def items_of(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


def test_whole_tables(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), items_of(spark)
    found = brute.rows_of(positional.op5_decontaminate(spark, SF), *NAMES)
    brute.same(found, brute.decontaminate(brute.rows_of(docs, "doc_id", "text"), brute.rows_of(items, "item_id", "text")))
    assert any(r[2] for r in found)


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_awkward_rows_in_blocks(spark, awkward, block):
    items = spark.createDataFrame(
        [(1, "one two"), (2, None), (3, ""), (4, "the the the"), (5, "a text without"), (5, "a text without"), (None, "tail end")]
        + [(6, awkward.where("doc_id = 5").first()["text"][40:260])], "item_id long, text string")
    found = brute.rows_of(positional.decontaminate(awkward, items, block=block), *NAMES)
    brute.same(found, brute.decontaminate(brute.rows_of(awkward, "doc_id", "text"), brute.rows_of(items, "item_id", "text")))


def test_empty_tables(spark, awkward, no_documents):
    items = items_of(spark)
    assert positional.decontaminate(no_documents, items).count() == 0
    assert positional.decontaminate(awkward, items.limit(0)).where("contaminated").count() == 0


def test_small_segments_give_the_same(spark, awkward):
    index = positional.build_index(awkward, segment=50)
    assert index.count() > 5
    assert index.select(F.explode("doc_ids")).count() == awkward.count()


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red green blue"), (2, "blue x x green x red"), (3, "red " + "x " * 30 + "green blue"),
                                  (4, "red green")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    index, windows = positional.build_index(docs), positional.test_windows(items)
    ids = {}
    for row in index.collect():
        ids |= {(row["segment"], i): d for i, d in enumerate(row["doc_ids"])}
    near = {ids[r["segment"], r["number"]] for r in positional.hits(index, windows, slop=5).collect()}
    exact = {ids[r["segment"], r["number"]] for r in positional.hits(index, windows).collect()}
    assert near == {1, 2} and exact == {1}


def test_pipeline_form_drops_only_hit_documents(spark, awkward):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    left = positional.without_contaminated(awkward, items)
    assert left.columns == awkward.columns
    assert left.count() == awkward.count() - 1 and left.where("text = 'one two'").count() == 0


def test_segment_without_words():
    none = pack(np.zeros(0, np.int64))
    empty = positional.Segment.read({"lengths": pack(np.zeros(2, np.int64)), "terms": none, "counts": none, "postings": none})
    assert empty.find(np.array([5], np.uint64)).tolist() == [-1]
