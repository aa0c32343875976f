"""Join of near-duplicate texts: Jaccard similarity of their sets of five-word shingles, at least ``THRESHOLD``.

Equal texts form one class, and only its first text goes on. Its MinHash signature is cut into bands; classes that share
a band belong to one cluster (connected components over the bands, linear in the number of texts). Within a cluster
pairs are compared in blocks of bounded size: MinHash values are compared in steps, and as soon as the posterior
probability (uniform prior) that a pair reaches the threshold falls below ``TOLERANCE`` it is dropped. The pairs that are
left are verified on the whole sets. A block gives the number of links of each class and a spanning forest of its links,
never the pairs themselves, so a group of thousands of near copies costs blocks of numbers, not millions of rows.

A band of four values finds a pair of similarity 0.8 with probability 0.41, so all 32 miss it with probability 5e-8.

Cases: a null text counts as empty; texts without words form classes of equal texts but have no links; texts of fewer
than five words have one shingle of all their words; repeated rows are copies of each other; a null doc_id is never the
id of a class or group that has another.
"""

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.components import with_roots
from palisade.llm.frames import Batches, fresh, map_batches, store, table, text_key
from palisade.llm.words import mix, pack_sorted, slices, unpack_sorted, words

WORDS = 5
THRESHOLD = 0.8
TOLERANCE = 1e-8
HASHES, BAND, STEP = 128, 4, 16
#: Texts of a block.
BLOCK = 256
_PART = 1_000_000

_random = np.random.default_rng(11)
_FACTORS = _random.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingles(data: np.ndarray, rows: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all shingles of concatenated texts, and the borders of the texts among them."""
    found = words(data, rows)
    n = np.diff(found.borders)
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    borders = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(n)), counts)
    first = found.borders[row] + np.arange(len(row)) - borders[row]
    last = found.borders[row + 1]
    h = np.zeros(len(row), np.uint64)
    padded = np.append(found.prints, np.uint64(0))
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(first + k < last, padded[np.minimum(first + k, len(padded) - 1)], np.uint64(k))
    return mix(h), borders


def signatures(prints: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """The MinHash values of each text (rows) as 32-bit numbers; texts without shingles get none that matter."""
    out = np.zeros((len(borders) - 1, HASHES), np.uint32)
    some = np.flatnonzero(np.diff(borders))
    for k in range(HASHES if len(some) else 0):
        out[some, k] = np.minimum.reduceat(prints * _FACTORS[k] + _TERMS[k], borders[some]) >> np.uint64(32)
    return out


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For each number of compared values, a multiple of STEP, the fewest matches at which a pair goes on.

    With a uniform prior the similarity given m matches of k is Beta(m + 1, k - m + 1), so the probability that it is at
    least t is that of at most m successes in k + 1 trials of probability t.
    """
    out = []
    for k in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        out.append(m)
    return out


def compare(left: np.ndarray, right: np.ndarray, least: list[int]) -> np.ndarray:
    """Which pairs of signatures survive all steps."""
    alive_a, alive_b = np.divmod(np.arange(len(left) * len(right)), len(right))
    matches = np.zeros(len(alive_a), np.int16)
    for step, needed in enumerate(least):
        at = slice(step * STEP, (step + 1) * STEP)
        own_a, own_b = left[:, at], right[:, at]
        for part in range(0, len(alive_a), _PART // STEP):
            p = slice(part, part + _PART // STEP)
            matches[p] += (own_a[alive_a[p]] == own_b[alive_b[p]]).sum(axis=1, dtype=np.int16)
        keep = matches >= needed
        alive_a, alive_b, matches = alive_a[keep], alive_b[keep], matches[keep]
    out = np.zeros((len(left), len(right)), bool)
    out[alive_a, alive_b] = True
    return out


def verify(left: list[np.ndarray], right: list[np.ndarray], possible: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the possible pairs reach the threshold, on whole sets (sorted arrays)."""
    sizes = np.array([len(r) for r in right])
    all_right = np.concatenate(right)
    out = np.zeros_like(possible)
    scale = round(threshold * 1_000_000)
    for i in np.flatnonzero(possible.any(axis=1)):
        some = np.flatnonzero(possible[i])
        values = all_right[np.repeat(possible[i], sizes)]
        at = np.minimum(np.searchsorted(left[i], values), len(left[i]) - 1)
        common = np.add.reduceat(left[i][at] == values, np.cumsum(sizes[some]) - sizes[some], dtype=np.int64)
        out[i, some] = common * 1_000_000 >= scale * (len(left[i]) + sizes[some] - common)
    return out


def forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the graph of ``pairs`` over ``n`` nodes."""
    parent, out = list(range(n)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs.tolist():
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            out.append((a, b))
    return out


def _classes(docs: DataFrame) -> DataFrame:
    """Stored: one row per different text with its key, smallest doc_id and signature (null without words)."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for first, end, data, borders in slices(batch.column("text")):
                prints, own = shingles(data, borders)
                sets = signatures(prints, own)
                some = np.diff(own) > 0
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id")[first:end], batch.column("node")[first:end],
                    pa.array([s.tobytes() if k else None for s, k in zip(sets, some)], pa.binary()),
                ], ["doc_id", "node", "signature"])

    picked = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), text_key().alias("node"))
    signed = map_batches(picked, run, f"doc_id {doc_type}, node binary, signature binary")
    return store(signed.groupBy("node").agg(F.min("doc_id").alias("class_id"), F.max("signature").alias("signature")), "jaccard-classes")


def _clusters(classes: DataFrame) -> DataFrame:
    """Stored (node, root): classes joined by a chain of shared bands."""
    bands = classes.where("signature is not null").select(
        "node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(HASHES // BAND - 1)), lambda b: F.xxhash64(
            b, F.substring("signature", b * (4 * BAND) + 1, F.lit(4 * BAND))))).alias("band", "value")
    )
    hubs = bands.groupBy("band", "value").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    edges = bands.join(hubs, ["band", "value"]).where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    return with_roots(edges, "jaccard-clusters")


def links(docs: DataFrame, classes: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """Stored rows (a, b, n): for b null, n links of class a; otherwise an edge of a spanning forest of the links."""
    clusters = _clusters(classes)
    sizes = clusters.groupBy("root").agg(F.count("*").alias("size"))
    members = clusters.join(sizes, "root").join(classes, "node").select(
        "node", "root", "class_id", "signature", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")
    )
    # Only the first text of a class; equal texts spread over the join by their ids.
    texts = docs.select(text_key().alias("node"), F.col("doc_id").alias("class_id"), "text")
    same = texts["node"].eqNullSafe(members["node"]) & texts["class_id"].eqNullSafe(members["class_id"])
    joined = texts.join(members, same).select(members["node"], "root", "signature", "blocks", "text")

    def sets(batches: Batches) -> Batches:
        for batch in batches:
            for first, end, data, borders in slices(batch.column("text")):
                prints, own = shingles(data, borders)
                packed = [pack_sorted(np.unique(prints[own[i] : own[i + 1]])) for i in range(end - first)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c)[first:end] for c in ("node", "root", "signature", "blocks")), pa.array(packed, pa.binary())],
                    ["node", "root", "signature", "blocks", "shingles"],
                )

    rows = map_batches(joined, sets, "node binary, root binary, signature binary, blocks int, shingles binary")
    own = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "signature", "shingles"
    )
    least = least_matches(threshold, tolerance)

    def block(group: pa.Table) -> pa.Table:
        seen = {}
        for row in group.to_pylist():
            seen[row["node"]] = row  # repeated rows are one text
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        sides = [sorted((r for r in seen.values() if r["own"] == side), key=lambda r: r["node"]) for side in (i, j)]
        a, b = [], []
        n = []
        if sides[0] and sides[1]:
            signed = [np.array([np.frombuffer(r["signature"], np.uint32) for r in side]) for side in sides]
            whole = [[unpack_sorted(r["shingles"]) for r in side] for side in sides]
            possible = compare(*signed, least)
            if i == j:
                possible = np.triu(possible, 1)
            linked = verify(*whole, possible, threshold)
            names = [[r["node"] for r in side] for side in sides]
            counts: dict[bytes, int] = {}
            for side, axis in ((0, 1), (1, 0)):
                for name, count in zip(names[side], linked.sum(axis=axis).tolist()):
                    counts[name] = counts.get(name, 0) + count
            for name, count in counts.items():
                if count:
                    a, b, n = [*a, name], [*b, None], [*n, count]
            both = names[0] + names[1]
            pairs = np.argwhere(linked) + ([0, 0] if i == j else [0, len(names[0])])
            for x, y in forest(pairs, len(both)):
                a, b, n = [*a, both[x]], [*b, both[y]], [*n, 0]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "n": pa.array(n, pa.int64())})

    return store(dealt.groupBy("root", "i", "j").applyInArrow(block, "a binary, b binary, n long"), "jaccard-links")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, node (its text), class_id (smallest id of equal texts), n_links (other texts that are
    similar to its text) and group_id (smallest id of all that links and copies join)."""
    classes = _classes(docs)
    found = links(docs, classes, threshold)
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    roots = with_roots(found.where("b is not null").select("a", "b"), "jaccard-groups")
    ids = roots.join(classes, "node").groupBy("root").agg(F.min("class_id").alias("group_id"))
    about = classes.select("node", "class_id").join(counts, "node", "left").join(
        roots.join(ids, "root").select("node", "group_id"), "node", "left"
    )
    rows = docs.select("doc_id", text_key().alias("node"))
    return rows.join(about, "node").select(
        "doc_id", "node", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id")
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, of each group of copies and near copies only the one of smallest id (of repeated rows one)."""
    node, told, turn = fresh(docs, "node"), fresh(docs, "told"), fresh(docs, "turn")
    told_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    winners = near_duplicates(docs, threshold).where(F.col("doc_id").eqNullSafe(F.col("group_id"))).select(
        F.col("node").alias(node), told_id.alias(told)
    ).distinct()
    keyed = docs.withColumn(node, text_key()).withColumn(told, told_id).join(winners, [node, told], "left_semi")
    first = Window.partitionBy(node, told).orderBy(F.lit(0))
    return keyed.withColumn(turn, F.row_number().over(first)).where(F.col(turn) == 1).select(*docs.columns)


def op3_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("node")
