"""Token files against the tokenizer library, and the code against its definition."""

import heapq
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palisade.llm import token_files as T
from palisade.llm.frames import store, table
from palisade.storage import new_path
from tests.llm.brute import rows_of, same
from tests.llm.conftest import SF

NAMES = ("doc_id", "start", "n_tokens", "ids_crc32")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(T.tokenizer_path())


def whole(library, text) -> list[int]:
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def brute(library, docs):
    out, start = [], 0
    for doc_id, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = whole(library, text)
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def files(spark, docs):
    folder = new_path(spark, "test-files")
    T.write(store(T.tokenize(docs, T.tokenizer_path()), "test-tokens"), folder, T.width(T.tokenizer_path()))
    return folder


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85\xa0 ̧́ΣσςİIı'sté<|endoftext>09٣"), st.characters(codec="utf-8")), max_size=60))
def test_words_encode_as_whole_texts(text):
    own = T.words_of(T.tokenizer_path())
    ids, ends = own.encode(pa.array([text, "", text + " a"]))
    alone = whole(own.library, text)[:-1]
    assert ids.tolist() == alone * 2 + whole(own.library, "a")[:-1] and ends.tolist()[:2] == [len(alone)] * 2


def huffman_bits(counts) -> int:
    """Bits of the best code without a limit."""
    heap, total = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total or sum(counts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=60), st.integers(1, 12))
def test_code_lengths(counts, limit):
    counts = np.array(counts)
    lengths = T.code_lengths(counts, limit)
    most = max(limit, (len(counts) - 1).bit_length())
    assert lengths.max() <= max(1, most) and (len(counts) == 1 or sum(2.0**-lengths) == 1)
    assert T.code_lengths(counts, 62) @ counts == huffman_bits(counts.tolist())
    # Best under the limit: no exchange of lengths makes it shorter, and a looser limit is never worse.
    assert lengths @ counts == np.sort(lengths)[::-1] @ np.sort(counts)
    assert T.code_lengths(counts, limit + 1) @ counts <= lengths @ counts


def best_limited(counts, limit):
    """Least bits over all full codes of at most ``limit`` bits, by trying all sorted length lists."""
    counts = sorted(counts, reverse=True)

    def tries(at, least, room):
        if at == len(counts):
            return 0 if room == 0 else np.inf
        return min((counts[at] * k + tries(at + 1, k, room - 2 ** (limit - k)) for k in range(least, limit + 1) if 2 ** (limit - k) <= room), default=np.inf)

    return tries(0, 1, 2**limit)


@pytest.mark.parametrize("counts", [[1, 1, 2, 3, 5, 8, 13], [100, 1, 1, 1, 1], [7, 7, 7], [1, 2, 4, 8, 16, 32, 64]])
def test_the_limit_costs_least(counts):
    assert T.code_lengths(np.array(counts), 3) @ np.array(counts) == best_limited(counts, 3)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3000), min_size=1, max_size=900), min_size=1, max_size=4))
def test_blocks_round_trip(blocks):
    ids, counts = np.unique(np.concatenate(blocks), return_counts=True)
    book = T.Codebook.build(ids, T.code_lengths(counts**3, 12))
    packed = [T.pack(np.array(b), book) for b in blocks]
    found = T.unpack([p[0] for p in packed], [p[1] for p in packed], [len(b) for b in blocks], book)
    assert [f.tolist() for f in found] == blocks


@given(st.binary(max_size=50), st.binary(max_size=5000))
def test_crc_of_pieces(a, b):
    assert T.followed(zlib.crc32(a), len(b)) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_awkward_documents(spark, awkward, library, monkeypatch):
    """Documents over many blocks; of the three equal rows of id 5 any order is the same."""
    monkeypatch.setattr(T, "BLOCK", 1000)
    wanted = brute(library, rows_of(awkward, "doc_id", "text"))
    same(rows_of(T.read_documents(spark, files(spark, awkward)), *NAMES), wanted)


def test_no_documents(spark, no_documents):
    assert T.read_documents(spark, files(spark, no_documents)).collect() == []


def test_table_and_ranges(spark, library):
    docs = table(spark, SF, "documents")
    rows = sorted(rows_of(docs, "doc_id", "text"))
    folder = files(spark, docs)
    same(rows_of(T.read_documents(spark, folder), *NAMES), brute(library, rows))
    ids = [i for _, text in rows for i in whole(library, text)]
    for start, stop in ((0, 1), (65_530, 65_545), (100_000, 100_700), (len(ids) - 3, len(ids) + 9), (1000, 70_000)):
        found = T.read_range(spark, folder, start, stop).orderBy("place")
        assert [tuple(r) for r in found.collect()] == [(i, ids[i]) for i in range(start, min(stop, len(ids)))]
    bits = spark.read.schema(T.BLOCKS).parquet(f"{folder}/blocks").agg(F.sum(F.octet_length("bits"))).first()[0]
    assert bits < 1.5 * len(ids)  # against two bytes an id
