"""Benchmark decontamination with a distributed positional inverted index.

The corpus is indexed in segments of bounded size, one stored row each: the segment's terms in order, how often each
occurs, and their postings (positions) one list after the other. Documents lie in a segment with a gap between them, so
that no phrase reaches from one into the next. Phrases are then looked up segment by segment: the postings of the term
that is rarest in the segment, less its place in the phrase, are the candidates, and each further term, in order of
rarity, keeps those that its own postings, less its place, contain. All phrases of a block of the test set are
intersected at once. A block has a bounded number of windows and is all that is broadcast.

Terms are 64-bit fingerprints of words. A word is a run of ASCII letters and digits and of all characters beyond ASCII.

Cases: null and empty texts have no words and are never hit; a test item shorter than a window is one window, an empty
one none; items and documents may repeat (an item_id counts once per document, a null one as an empty string); a
document longer than a segment is a segment of its own.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.frames import Batches, documents, fresh, map_batches, row_ids, store, table, text_key
from palisade.llm.words import pack, pack_sorted, slices, unpack, unpack_sorted, words

WINDOW = 10
#: Words of a segment (a longer document is a segment of its own).
SEGMENT = 60_000
#: Windows looked up at once: a block of this size is about 20 MB.
BLOCK = 200_000
#: Candidates held at once while a segment is searched.
_AT_ONCE = 4_000_000
_BITS = np.int64(32)


def build_index(docs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The stored index: one row per segment with its documents (doc_ids, keys, lengths) and postings."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        numbers = row_ids()
        for batch in batches:
            for first, end, data, borders in slices(batch.column("text")):
                found = words(data, borders)
                at = 0
                while at < end - first:
                    stop = max(at + 1, int(np.searchsorted(found.borders, found.borders[at] + segment, side="right")) - 1)
                    lengths = np.diff(found.borders[at : stop + 1])
                    terms = found.prints[found.borders[at] : found.borders[stop]]
                    # One free position behind each document.
                    places = np.arange(len(terms)) + np.repeat(np.arange(len(lengths)), lengths)
                    order = np.argsort(terms, kind="stable")
                    names, counts = np.unique(terms[order], return_counts=True)
                    rows = slice(first + at, first + stop)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([next(numbers)], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, stop - at], pa.int32()), batch.column("doc_id")[rows]),
                        pa.ListArray.from_arrays(pa.array([0, stop - at], pa.int32()), batch.column("text_key")[rows]),
                        pa.array([pack(lengths)], pa.binary()),
                        pa.array([pack_sorted(names)], pa.binary()),
                        pa.array([pack(counts)], pa.binary()),
                        pa.array([pack(places[order])], pa.binary()),
                    ], ["segment", "doc_ids", "keys", "lengths", "terms", "counts", "postings"])
                    at = stop

    schema = (
        f"segment long, doc_ids array<{doc_type}>, keys array<binary>, lengths binary, terms binary, counts binary, "
        "postings binary"
    )
    return store(map_batches(documents(docs, text_key().alias("text_key")), run, schema), "positional-index")


class Segment(NamedTuple):
    """One row of the index, with postings as one sorted list of (number of the term, position)."""

    starts: np.ndarray  # first position of each document
    lengths: np.ndarray
    terms: np.ndarray
    firsts: np.ndarray  # postings of term i: firsts[i] to firsts[i + 1]
    postings: np.ndarray
    pairs: np.ndarray

    @classmethod
    def read(cls, row: dict) -> "Segment":
        lengths = unpack(row["lengths"])
        counts = unpack(row["counts"])
        postings = unpack(row["postings"])
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1] if len(lengths) else np.zeros(0, np.int64)
        pairs = (np.repeat(np.arange(len(counts), dtype=np.int64), counts) << _BITS) | postings
        return cls(
            starts, lengths, unpack_sorted(row["terms"]), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64),
            postings, pairs,
        )

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The numbers of terms in this segment, -1 for those that do not occur."""
        if not len(self.terms):
            return np.full(len(terms), -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1


class Phrases(NamedTuple):
    """A block of windows over a small vocabulary of their own."""

    vocabulary: np.ndarray  # sorted fingerprints
    terms: np.ndarray  # windows x places, numbers in the vocabulary, -1 behind the end of a short window
    items: np.ndarray  # item number of each window
    names: list[str]  # id of each item


def _by_rarity(counts: np.ndarray, used: np.ndarray) -> np.ndarray:
    return np.argsort(np.where(used, counts, np.iinfo(np.int64).max), axis=1, kind="stable")


def _candidates(segment: Segment, phrases: Phrases):
    """Windows whose terms all occur, in parts of bounded work: window numbers, their term numbers and order of rarity."""
    number = segment.find(phrases.vocabulary)
    counts = np.where(number >= 0, np.diff(segment.firsts)[number] if len(segment.terms) else 0, 0)
    used = phrases.terms >= 0
    possible = np.flatnonzero((~used | (counts[phrases.terms] > 0)).all(axis=1) & used.any(axis=1))
    if not len(possible):
        return
    own = phrases.terms[possible]
    sizes = np.where(own >= 0, counts[own], 0)
    order = _by_rarity(sizes, own >= 0)
    work = np.cumsum(sizes[np.arange(len(own)), order[:, 0]])
    at = 0
    while at < len(own):
        done = work[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(work, done + _AT_ONCE, side="right")))
        yield possible[at:stop], np.where(own[at:stop] >= 0, number[own[at:stop]], -1), order[at:stop]
        at = stop


def phrase_matches(segment: Segment, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences: (window number, first position)."""
    windows, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for window, terms, order in _candidates(segment, phrases):
        rows = np.arange(len(window))
        term = terms[rows, order[:, 0]]
        sizes = segment.firsts[term + 1] - segment.firsts[term]
        which = np.repeat(rows, sizes)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        start = segment.postings[segment.firsts[term][which] + inside] - order[which, 0]
        keep = start >= 0
        which, start = which[keep], start[keep]
        for k in range(1, terms.shape[1]):
            place = order[which, k]
            term = terms[which, place]
            wanted = (term << _BITS) | (start + place)
            at = np.minimum(np.searchsorted(segment.pairs, wanted), len(segment.pairs) - 1)
            keep = (segment.pairs[at] == wanted) | (term < 0)
            which, start = which[keep], start[keep]
        windows.append(window[which])
        starts.append(start)
    return np.concatenate(windows), np.concatenate(starts)


def proximity_matches(segment: Segment, phrases: Phrases, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences in any order within ``slop`` words of the rarest term, in one document: (window number, its position)."""
    windows, anchors = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for window, terms, order in _candidates(segment, phrases):
        rows = np.arange(len(window))
        term = terms[rows, order[:, 0]]
        sizes = segment.firsts[term + 1] - segment.firsts[term]
        which = np.repeat(rows, sizes)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        anchor = segment.postings[segment.firsts[term][which] + inside]
        for k in range(1, terms.shape[1]):
            term = terms[which, order[which, k]]
            doc = segment.doc_of(anchor)
            low = np.maximum(anchor - slop, segment.starts[doc])
            high = np.minimum(anchor + slop, segment.starts[doc] + segment.lengths[doc] - 1)
            base = term << _BITS
            near = np.searchsorted(segment.pairs, base | low) < np.searchsorted(segment.pairs, base | high, side="right")
            keep = near | (term < 0)
            which, anchor = which[keep], anchor[keep]
        windows.append(window[which])
        anchors.append(anchor)
    return np.concatenate(windows), np.concatenate(anchors)


def test_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Stored windows of the test set: item, terms (binary), block number. A repeated window of an item stays once."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for first, end, data, borders in slices(batch.column("text")):
                found = words(data, borders)
                names, rows = [], []
                for i in range(end - first):
                    own = found.prints[found.borders[i] : found.borders[i + 1]]
                    for k in range(max(1, len(own) - window + 1) if len(own) else 0):
                        names.append(batch.column("item_id")[first + i].as_py())
                        rows.append(own[k : k + window].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(rows, pa.binary())], ["item_id", "terms"])

    picked = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    return store(map_batches(picked, run, "item_id string, terms binary").distinct(), "test-windows")


def blocks(windows: DataFrame, size: int = BLOCK):
    """The windows in blocks of about ``size``, one after the other on the driver."""
    n = max(1, -(-windows.count() // size))
    for b in range(n):
        rows = windows.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(n)) == b).toArrow().to_pylist()
        names = sorted({r["item_id"] for r in rows})
        number = {name: i for i, name in enumerate(names)}
        prints = [np.frombuffer(r["terms"], np.uint64) for r in rows]
        vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *prints]))
        terms = np.full((len(rows), max(map(len, prints), default=1)), -1, np.int64)
        for i, p in enumerate(prints):
            terms[i, : len(p)] = np.searchsorted(vocabulary, p)
        yield Phrases(vocabulary, terms, np.array([number[r["item_id"]] for r in rows], np.int64), names)


def hits(index: DataFrame, windows: DataFrame, block: int = BLOCK, slop: int | None = None) -> DataFrame:
    """Hit documents, per block: segment, number in it, covered stretches (start, end) and items.

    With ``slop``, windows match by proximity and the stretch is the rarest term's place.
    """
    spark = index.sparkSession

    def search(shared):
        def run(batches: Batches) -> Batches:
            phrases: Phrases = shared.value
            width = (phrases.terms >= 0).sum(axis=1)
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    segment = Segment.read(row)
                    if slop is None:
                        window, start = phrase_matches(segment, phrases)
                        length = width[window]
                    else:
                        window, start = proximity_matches(segment, phrases, slop)
                        length = np.ones(len(window), np.int64)
                    if not len(window):
                        continue
                    doc = segment.doc_of(start)
                    order = np.lexsort((start, doc))
                    out = []
                    for part in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1):
                        d = int(doc[part[0]])
                        own = (start[part] - segment.starts[d]).tolist()
                        stretches: list[list[int]] = []
                        for a, b in zip(own, (start[part] - segment.starts[d] + length[part]).tolist()):
                            if stretches and a <= stretches[-1][1]:
                                stretches[-1][1] = max(stretches[-1][1], b)
                            else:
                                stretches.append([a, b])
                        items = [phrases.names[i] for i in np.unique(phrases.items[window[part]])]
                        out.append({
                            "segment": row["segment"], "number": d, "items": items,
                            "stretches": [{"start": a, "stop": b} for a, b in stretches],
                        })
                    yield from pa.Table.from_pylist(out, schema=_HIT).combine_chunks().to_batches()

        return run

    parts = None
    for phrases in blocks(windows, block):
        part = map_batches(
            index.select("segment", "lengths", "terms", "counts", "postings"), search(spark.sparkContext.broadcast(phrases)),
            "segment long, number int, items array<string>, stretches array<struct<start:int,stop:int>>",
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts


_HIT = pa.schema([
    ("segment", pa.int64()), ("number", pa.int32()), ("items", pa.list_(pa.string())),
    ("stretches", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, text_key, words, hit words, items found and the digest of their ids."""
    index = build_index(docs)
    found = hits(index, test_windows(items, window), block)
    ordered = Window.partitionBy("segment", "number").orderBy("start", "stop")
    # Stretches of several blocks can overlap: count each word once.
    covered = (
        found.select("segment", "number", F.explode("stretches").alias("s")).select("segment", "number", "s.*")
        .withColumn("before", F.max("stop").over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
        .groupBy("segment", "number")
        .agg(F.sum(F.greatest(F.col("stop") - F.greatest("start", F.coalesce("before", F.lit(0))), F.lit(0))).alias("n_hit"))
    )
    named = (
        found.select("segment", "number", F.explode("items").alias("item")).groupBy("segment", "number")
        .agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    )

    def lengths(batches: Batches) -> Batches:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, keys = batch.column("doc_ids")[i].values, batch.column("keys")[i].values
                n = len(ids)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, batch.column("segment")[i].as_py())), pa.array(np.arange(n, dtype=np.int32)), ids, keys,
                    pa.array(unpack(batch.column("lengths")[i].as_py())),
                ], ["segment", "number", "doc_id", "text_key", "n_words"])

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    rows = map_batches(
        index.select("segment", "doc_ids", "keys", "lengths"), lengths,
        f"segment long, number int, doc_id {doc_type}, text_key binary, n_words long",
    )
    at = ["segment", "number"]
    return rows.join(covered, at, "left").join(named, at, "left").select(
        "doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("item_ids", F.array().cast("array<string>"))).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "item_ids"), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without those that hold a window of a test item. Equal texts share a verdict."""
    key, other, own = fresh(docs, "text_key"), fresh(docs, "hit_id"), fresh(docs, "hit_key")
    bad = decontaminate(docs, items).where("contaminated").select(
        F.col("doc_id").alias(other), F.col("text_key").alias(own)
    ).distinct()
    keyed = docs.withColumn(key, text_key())
    return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col(other)) & (F.col(key) == F.col(own)), "left_anti").drop(key)


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")
