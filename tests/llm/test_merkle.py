"""The Merkle manifest against a plain version with the library's hash, over several bands and fan-outs."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from palisade.llm import merkle
from palisade.llm import sha_states as S
from tests.llm.brute import rows_of, same


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def climb(tree, at, node, fanout):
    """The folded root and the siblings on the way."""
    siblings = []
    for level in tree[:-1]:
        first = at - at % fanout
        run = level[first : first + fanout]
        siblings += run[: at - first] + run[at - first + 1 :]
        run[at - first] = node
        node, at = h(*run), at // fanout
    return node, siblings


def brute(rows, fanout=2):
    """rows: doc_id, source, lang, n_chars, text."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda x: b"" if x is None else b"=" + x.encode())
    leaf = lambda r: h(*map(field, r))
    trees = {}
    for lang in order:
        own = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = own, levels([leaf(r) for r in own], fanout)
    top = levels([trees[x][1][-1][0] for x in order], fanout)
    root, out = top[-1][0], []
    for number, lang in enumerate(order):
        own, tree = trees[lang]
        for i, r in enumerate(own):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            changed = leaf((*r[:3], r[3] + 1 if hit and r[3] is not None else r[3], r[4]))
            node, one = climb(tree, i, changed, fanout)
            node, two = climb(top, number, node, fanout)
            out.append((r[0], tree[0][i], tree[-1][0], root, h(*one, *two), node, node == root))
    return out


NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def test_states_are_those_of_the_library():
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(7)]
    state = S.absorb(S.START.repeat(7, axis=1), S.hex_block(S.words(b"".join(digests))))
    stored = S.words(S.raw(state))  # written down and resumed
    found = S.raw(S.absorb(S.absorb(stored, S.hex_block(S.words(digests[0] * 7))), S.ending(2)))
    assert found == b"".join(hashlib.sha256((d.hex() + digests[0].hex()).encode()).digest() for d in digests)


def test_awkward_documents(awkward):
    same(rows_of(merkle.verify(awkward), *NAMES), brute(rows_of(awkward, *FIELDS)))


def test_no_documents(no_documents):
    assert merkle.verify(no_documents).collect() == []
    assert merkle.verify(no_documents).columns == list(NAMES)


@pytest.mark.parametrize("bits", [1, 3])
def test_several_bands(spark, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BITS", bits)
    langs = [None, "", "a", "é", *[f"l{i}" for i in range(9)]]
    rows = [(i * 7 % 301, "s", langs[i * i % 13], i, "t" * (i % 5)) for i in range(301)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    same(rows_of(merkle.verify(docs), *NAMES), brute(rows))


@pytest.mark.parametrize("fanout", [3, 5])
def test_other_fanouts(spark, monkeypatch, fanout):
    """Rows that all tell the truth give the root; a lie does not; siblings stand in their order."""
    monkeypatch.setattr(merkle, "BITS", 3)
    rows = [(i, "s", "ab"[i % 2], i, "t") for i in range(61)]
    leaf = lambda r: h(*map(field, r))
    table = spark.createDataFrame([(r[0], "=" + r[2], leaf(r), leaf((*r[:3], 0, r[4]))) for r in rows], "doc_id long, tree string, d string, w string")
    leaves = table.select("doc_id", "tree", F.unhex("d").alias("digest"), F.unhex(F.when(F.col("doc_id") % 3 == 0, F.col("w")).otherwise(F.col("d"))).alias("replaced"))
    own = merkle.manifest(leaves, "doc_id", fanout=fanout)
    trees = {x: levels([leaf(r) for r in rows if r[2] == x], fanout) for x in "ab"}
    top = levels([trees[x][-1][0] for x in "ab"], fanout)
    assert own.root.hex() == top[-1][0]
    wanted = []
    for r in rows:
        node, one = climb(trees[r[2]], r[0] // 2, leaf((*r[:3], 0, r[4])) if r[0] % 3 == 0 else leaf(r), fanout)
        node, two = climb(top, "ab".index(r[2]), node, fanout)
        wanted.append((r[0], h(*one, *two), node))
    hexed = merkle.folded(own, "doc_id").select("doc_id", F.lower(F.hex("proof")), F.lower(F.hex("folded")))
    same([tuple(r) for r in hexed.collect()], wanted)


def test_equal_rows_are_leaves_of_their_own(spark):
    rows = [(5, "s", "en", 1, "x")] * 40 + [(5, "s", "en", 1, "y"), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    same(rows_of(merkle.verify(docs), *NAMES), brute(rows))
