"""Vector codes against plain whole numbers, with limbs at their limits."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palisade.llm import vector_codes as V
from tests.llm.brute import rows_of, same

NAMES = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
SCHEMA = "vec_id long, embedding array<double>, label int, x string, error double"


def brute(rows, parts=8, entries=16, rounds=6):
    """rows: vec_id, embedding, label; all of one length that fits."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    firsts = {}
    for i, v, _ in kept:
        if i is not None:
            firsts[i] = min(v, firsts.get(i, v))
    books = [[cut(firsts[i], p) for i in sorted(firsts)[:entries]] for p in range(parts)]

    def assign():
        out = []
        for _, v, _ in kept:
            far = [[sum((a - b) ** 2 for a, b in zip(cut(v, p), entry)) for entry in books[p]] for p in range(parts)]
            out.append([(f.index(min(f)), min(f)) for f in far])
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for (_, v, _), f in zip(kept, found) if f[p][0] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    found = assign()
    sha = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    errors = [sum(d for _, d in f) for f in found]
    total = {}
    for (_, _, label), e in zip(kept, errors):
        total[label] = total.get(label, 0) + e
    return [(i, "".join(f"{c:02x}" for c, _ in f), e, total[label], sha) for (i, _, label), f, e in zip(kept, found, errors)]


def rows(n=300, size=16, scale=1.0, seed=1):
    random = np.random.default_rng(seed)
    x = random.normal(0, scale, (n, size)).round(4)
    return [(int(i), x[i].tolist(), None if i % 11 == 0 else int(i % 3)) for i in range(n)]


@given(st.integers(1, 64), st.integers(0, 2**32))
@settings(max_examples=100, deadline=None)
def test_products_are_exact_up_to_the_limit(size, seed):
    top = V.most(size)
    random = np.random.default_rng(seed)
    x = random.choice([-top, top, 0, 1, -1, top - 1, *random.integers(-top, top, 5).tolist()], (6, size))
    y = random.choice([-top, top, -1, *random.integers(-top, top, 5).tolist()], (4, size))
    wanted = [[sum(int(p) * int(q) for p, q in zip(a, b)) for b in y] for a in x]
    assert V.products(x, y, top).tolist() == wanted
    far = [[sum((int(p) - int(q)) ** 2 for p, q in zip(a, b)) for b in y] for a in x]
    code, error = V.nearest(x, y, top)
    assert code.tolist() == [f.index(min(f)) for f in far] and error.tolist() == [min(f) for f in far]
    bits = V.limb_bits(size)
    assert size * (2**bits - 1) ** 2 < 2**53 and len(V.limbs(x, bits, 2)) == 2


@pytest.mark.parametrize("scale", [0.3, 3000.0])
def test_against_plain_version(spark, scale):
    """Small numbers, and numbers that need several limbs; ties, repeated rows and ids, nulls, other numbers of parts."""
    data = rows(scale=scale)
    data += [data[3], data[3], (7, [0.0] * 16, 1), (None, [1.0] * 16, None), (5, None, 1), (6, [math.nan] + [0.0] * 15, 1),
             (8, [math.inf] + [0.0] * 15, 1), (9, [None] + [0.0] * 15, 1)]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in data], SCHEMA).repartition(5)
    same(rows_of(V.compress(df), *NAMES), brute(data))
    same(rows_of(V.compress(df, parts=4, entries=3, rounds=2), *NAMES), brute(data, 4, 3, 2))


def test_fewer_rows_than_entries(spark):
    data = rows(5)
    same(rows_of(V.compress(spark.createDataFrame([(*r, "x", 0.5) for r in data], SCHEMA)), *NAMES), brute(data))


def test_vectors_that_do_not_fit_are_kept(spark):
    data = rows(40)
    odd = [(900, [1.0] * 8, 1), (901, [], 1), (902, [1e300] * 16, 2), (903, [-1e300] * 16, 77)]
    found = V.compress(spark.createDataFrame([(*r, "x", 0.5) for r in data + odd], SCHEMA))
    sha = brute(data)[0][-1]
    total = {r[2]: w[3] for r, w in zip(data, brute(data))}
    same(rows_of(found, *NAMES), brute(data) + [(i, None, None, total.get(label), sha) for i, _, label in odd])


def test_no_vectors(spark):
    for data in ([], [(1, None, 2, "x", 0.5)]):
        found = V.compress(spark.createDataFrame(data, SCHEMA))
        assert found.columns == list(NAMES) and found.collect() == []


def test_vectors_without_ids(spark):
    found = V.compress(spark.createDataFrame([(None, [1.0] * 16, 2, "x", 0.5)], SCHEMA)).collect()
    assert [tuple(r)[:4] for r in found] == [(None, None, None, None)]
