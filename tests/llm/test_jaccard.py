import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import jaccard
from tests.llm import brute
from tests.llm.conftest import SF

NAMES = ["doc_id", "class_id", "n_links", "group_id"]


def brute_force(rows, threshold=0.8):
    rows = [(i, t or "") for i, t in rows]
    sets, ids = {}, {}
    for i, t in rows:
        w = brute.words(t)
        sets[t] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        ids.setdefault(t, []).append(i)
    texts = list(sets)
    group = {t: {t} for t in texts}
    links = dict.fromkeys(texts, 0)
    for x, a in enumerate(texts):
        for b in texts[x + 1 :]:
            common = len(sets[a] & sets[b])
            if common and common * 10 >= threshold * 10 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                merged = group[a] | group[b]
                for t in merged:
                    group[t] = merged
    least = lambda ts: min((i for t in ts for i in ids[t] if i is not None), default=None)
    return [(i, least([t]), links[t], least(group[t])) for i, t in rows]


def test_whole_table(spark):
    found = brute.rows_of(jaccard.op3_jaccard(spark, SF), *NAMES)
    rows = brute.rows_of(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text")
    brute.same(found, brute_force(rows))
    assert any(r[2] for r in found)


@pytest.fixture(scope="module")
def family(spark):
    """A group of 600 near copies (several blocks), a chain, and pairs at the very threshold."""
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(600):
        text = list(base)
        for k in rng.integers(0, 200, 2):
            text[k] = f"x{i}"
        rows.append((i, " ".join(text)))
    chain = [f"c{i}" for i in range(160)]
    rows += [(1000 + i, " ".join(chain[i * 8 : i * 8 + 100])) for i in range(7)]
    rows += [(2000, " ".join(f"t{i}" for i in range(13))), (2001, " ".join([f"t{i}" for i in range(12)] + ["z"]))]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_blocks_and_thresholds(family):
    rows = brute.rows_of(family, "doc_id", "text")
    brute.same(brute.rows_of(jaccard.near_duplicates(family), *NAMES), brute_force(rows))


def test_awkward_rows(spark, awkward, no_documents):
    brute.same(brute.rows_of(jaccard.near_duplicates(awkward), *NAMES), brute_force(brute.rows_of(awkward, "doc_id", "text")))
    assert jaccard.near_duplicates(no_documents).count() == 0


def test_one_of_each_group_stays(spark, awkward):
    kept = jaccard.keep_one(awkward)
    assert kept.columns == awkward.columns
    wanted = {r[3] for r in brute_force(brute.rows_of(awkward, "doc_id", "text"))}
    assert kept.count() == len(wanted) and {r[0] for r in brute.rows_of(kept, "doc_id")} == wanted


def test_pruning_keeps_what_can_reach_the_threshold():
    least = jaccard.least_matches(0.8, 1e-8)
    assert len(least) == jaccard.HASHES // jaccard.STEP and all(a <= b for a, b in zip(least, least[1:]))
    assert least[-1] < 0.8 * jaccard.HASHES and least[-1] > 0.4 * jaccard.HASHES
    loose = jaccard.least_matches(0.8, 1e-2)
    assert all(a <= b for a, b in zip(least, loose))
