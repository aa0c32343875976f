import base64

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from palisade.llm import bpe
from tests.llm import brute
from tests.llm.conftest import SF

NAMES = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def official():
    lines = open(public_tokenizers.path(bpe.VOCABULARY), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.text("ab eth\n\t's1"), st.text("éü 日本　\x1c\x85​🙂🏽")))
def test_same_as_the_library(text):
    codec = bpe.codec(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    ids = codec.encode(text)
    assert ids == OFFICIAL.encode_ordinary(text)
    assert codec.decode(ids).decode() == text


OFFICIAL = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
    mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bpe.VOCABULARY), "rb"))},
)


def test_whole_table(spark, awkward, no_documents):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), awkward):
        wanted = []
        for i, t in brute.rows_of(docs, "doc_id", "text"):
            ids = OFFICIAL.encode_ordinary(t or "")
            wanted.append((i, len(ids), brute.sha(",".join(map(str, ids))), brute.sha((t or "").encode())))
        brute.same(brute.rows_of(bpe.encode(docs), *NAMES), wanted)
    assert bpe.encode(no_documents, with_ids=True).count() == 0


def test_ids_are_returned_whole(spark, awkward):
    for r in bpe.encode(awkward, with_ids=True).collect():
        assert len(r["ids"]) == r["n_tokens"]


def test_small_vocabulary_with_unreachable_token():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abcd": 258}
    own = bpe.Codec(ranks, r"\S+|\s+")
    assert own.encode("abcd") == [258]  # merging cannot make it, but it is a whole piece
    assert own.encode("abcdx") == [256, 99, 100, 120]
    assert own.encode("abc") == [256, 99] and own.encode("bcx") == [257, 120]


def test_linear_in_the_length(codec):
    assert codec.decode(codec.encode("ab" * 50_000)) == b"ab" * 50_000
