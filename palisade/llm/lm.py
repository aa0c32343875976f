"""Language-model scores of whole texts by a weighted backoff automaton.

The model is a smoothed bigram model over all training tokens: p(w | u) = (c(u w) + K p(w)) / (c(u) + K), with
p(w) = (c(w) + 1) / (N + V + 1). As an automaton: one state per word (the history) and a root; an arc for each bigram
seen, weighted log p(w | u), and from each state a failure arc to the root, weighted log(K / (c(u) + K)), whose arcs
hold log p(w). A text is scored by one pass from left to right that carries the state and adds up weights.

Neither vocabulary nor bigrams fit into one machine, so the counts stay distributed. Texts are encoded once, in stored
segments of bounded size. Each segment sends its distinct words and bigrams (as sorted 64-bit fingerprints, with its own
training counts) to buckets of fingerprint ranges; a bucket adds up the counts of all segments and answers each of them.
A segment then holds all arcs that its own texts can take, and runs the automaton over them. What is sent grows with the
corpus; no bucket or segment does. Frequent words are one entry per segment, so no bucket is hot.

Within a segment all texts advance together, one token per step. Long texts are cut into lanes: the state behind a token
is known from that token, so a lane starts in the state that the one before it ends in.

Cases: null and empty texts have one token, the end; texts of any length count whole; repeated rows are all counted and
each get a row; without training documents N = V = 0 and every token is unknown.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.frames import Batches, documents, held_out, map_batches, row_ids, store, table
from palisade.llm.words import SOLID, mix, pack, pack_sorted, slices, unpack, unpack_sorted, words

#: Weight of the unigram model in every history, in tokens.
BACKOFF = 500.0
#: Bytes of text in a segment (a longer text is a segment of its own).
SEGMENT = 8 << 20
#: Entries of a bucket that counts are planned for.
BUCKET = 1 << 20
LANE = 512
END = np.uint64(0x9E3779B97F4A7C15)


def encode(docs: DataFrame, held: Column) -> DataFrame:
    """The stored corpus as numbers: per segment its doc_ids, held-out flags, lengths, distinct words and tokens."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        ids = row_ids()
        for batch in batches:
            for first, end, data, borders in slices(batch.column("text"), SEGMENT):
                found = words(data, borders, SOLID)
                lengths = np.diff(found.borders) + 1
                last = np.cumsum(lengths) - 1
                prints = np.empty(len(found.prints) + len(lengths), np.uint64)
                inner = np.ones(len(prints), bool)
                inner[last] = False
                prints[inner], prints[last] = found.prints, END
                names, tokens = np.unique(prints, return_inverse=True)
                rows = slice(first, end)
                flags = np.array(batch.column("held")[rows].to_pylist(), bool)
                yield pa.RecordBatch.from_arrays([
                    pa.array([next(ids)], pa.int64()), pa.array([len(prints)], pa.int64()),
                    pa.array([int(lengths[~flags].sum())], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, end - first], pa.int32()), batch.column("doc_id")[rows]),
                    pa.array([flags.astype(np.uint8).tobytes()], pa.binary()), pa.array([pack(lengths)], pa.binary()),
                    pa.array([pack_sorted(names)], pa.binary()), pa.array([pack(tokens)], pa.binary()),
                ], ["segment", "n", "n_train", "doc_ids", "held", "lengths", "words", "tokens"])

    schema = (
        f"segment long, n long, n_train long, doc_ids array<{doc_type}>, held binary, lengths binary, words binary, "
        "tokens binary"
    )
    return store(map_batches(documents(docs, held.alias("held")), run, schema), "lm-corpus")


class Segment(NamedTuple):
    lengths: np.ndarray
    held: np.ndarray
    words: np.ndarray  # sorted fingerprints
    tokens: np.ndarray  # numbers of words
    history: np.ndarray  # the word before each token; before a text's first one, the end
    bigrams: np.ndarray  # sorted fingerprints of the distinct bigrams
    place: np.ndarray  # bigram of each token, as a number in ``bigrams``

    @classmethod
    def read(cls, row: dict) -> "Segment":
        lengths, tokens = unpack(row["lengths"]), unpack(row["tokens"])
        names = unpack_sorted(row["words"])
        history = np.empty_like(tokens)
        history[1:] = tokens[:-1]
        history[np.cumsum(lengths) - lengths] = np.searchsorted(names, END)
        prints = mix(names[history] * np.uint64(0x2545F4914F6CDD1D) + names[tokens])
        bigrams, place = np.unique(prints, return_inverse=True)
        return cls(lengths, np.frombuffer(row["held"], np.uint8) > 0, names, tokens, history, bigrams, place)

    def train_counts(self) -> tuple[np.ndarray, np.ndarray]:
        learn = np.repeat(~self.held, self.lengths)
        return (
            np.bincount(self.tokens[learn], minlength=len(self.words)),
            np.bincount(self.place[learn], minlength=len(self.bigrams)),
        )


def _cuts(prints: np.ndarray, bits: int) -> np.ndarray:
    """Where the sorted fingerprints of each bucket begin, and the end."""
    edges = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(prints, edges), [len(prints)]])


def ask(corpus: DataFrame, bits: int) -> DataFrame:
    """What each segment asks of each bucket: its words and bigrams there with their counts in its training texts."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                own = Segment.read(row)
                counts = own.train_counts()
                cuts = [_cuts(own.words, bits), _cuts(own.bigrams, bits)]
                out = {"bucket": [], "segment": [], "words": [], "word_counts": [], "bigrams": [], "bigram_counts": []}
                for b in range(1 << bits):
                    at = [slice(c[b], c[b + 1]) for c in cuts]
                    if at[0].start < at[0].stop or at[1].start < at[1].stop:
                        for name, value in zip(out, (
                            b, row["segment"], pack_sorted(own.words[at[0]]), pack(counts[0][at[0]]),
                            pack_sorted(own.bigrams[at[1]]), pack(counts[1][at[1]]),
                        )):
                            out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema=_ASKED)

    return map_batches(
        corpus.select("segment", "held", "lengths", "words", "tokens"), run,
        "bucket int, segment long, words binary, word_counts binary, bigrams binary, bigram_counts binary",
    )


_ASKED = pa.schema([
    ("bucket", pa.int32()), ("segment", pa.int64()), ("words", pa.binary()), ("word_counts", pa.binary()),
    ("bigrams", pa.binary()), ("bigram_counts", pa.binary()),
])
_TOLD = pa.schema([
    ("segment", pa.int64()), ("bucket", pa.int32()), ("totals", pa.binary()), ("changed", pa.binary()), ("now", pa.binary()),
])


def _totals(prints: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    """For each list of fingerprints, the sums over all lists."""
    names, place = np.unique(np.concatenate(prints), return_inverse=True)
    sums = np.bincount(place, np.concatenate(counts), minlength=len(names)).astype(np.int64)
    return np.split(sums[place], np.cumsum([len(p) for p in prints])[:-1])


def answer(asked: DataFrame) -> DataFrame:
    """One row per question: the totals of its words, and those of its bigrams that others have as well."""

    def run(asked: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        prints = [unpack_sorted(r["words"]) for r in rows]
        totals = _totals(prints, [unpack(r["word_counts"]) for r in rows])
        own = [unpack(r["bigram_counts"]) for r in rows]
        sums = _totals([unpack_sorted(r["bigrams"]) for r in rows], own)
        changed = [np.flatnonzero(a != b) for a, b in zip(own, sums)]
        return pa.Table.from_pydict({
            "segment": asked["segment"], "bucket": asked["bucket"], "totals": [pack(t) for t in totals],
            "changed": [pack(c) for c in changed], "now": [pack(s[c]) for s, c in zip(sums, changed)],
        }, schema=_TOLD)

    return asked.groupBy("bucket").applyInArrow(run, "segment long, bucket int, totals binary, changed binary, now binary")


def vocabulary(corpus: DataFrame, bits: int) -> int:
    """V: how many distinct words the training texts of all segments have."""

    def lists(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                names, lengths = unpack_sorted(row["words"]), unpack(row["lengths"])
                learn = np.repeat(np.frombuffer(row["held"], np.uint8) == 0, lengths)
                seen = names[np.bincount(unpack(row["tokens"])[learn], minlength=len(names)) > 0]
                cuts = _cuts(seen, bits)
                own = [(b, pack_sorted(seen[cuts[b] : cuts[b + 1]])) for b in range(1 << bits) if cuts[b] < cuts[b + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _ in own], pa.int32()), pa.array([w for _, w in own], pa.binary())], ["bucket", "words"]
                )

    def distinct(sent: pa.Table) -> pa.Table:
        all_words = np.concatenate([unpack_sorted(w.as_py()) for w in sent["words"]])
        return pa.table({"n": pa.array([len(np.unique(all_words))], pa.int64())})

    sent = map_batches(corpus.select("held", "lengths", "words", "tokens"), lists, "bucket int, words binary")
    return sent.groupBy("bucket").applyInArrow(distinct, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class Automaton(NamedTuple):
    """States are words; arcs are sorted by (state, word)."""

    size: int
    arcs: np.ndarray
    weights: np.ndarray
    fail: np.ndarray  # weight of the failure arc of each state
    root: np.ndarray  # weight of each word's arc at the root

    @classmethod
    def build(cls, own: Segment, word_counts, bigram_counts, n: int, v: int, backoff: float) -> "Automaton":
        size = len(own.words)
        p = (word_counts + 1) / (n + v + 1)
        _, at = np.unique(own.place, return_index=True)
        history, word = own.history[at], own.tokens[at]
        seen = bigram_counts > 0
        arcs = (history * size + word)[seen]
        weights = np.log10((bigram_counts + backoff * p[word]) / (word_counts[history] + backoff))[seen]
        order = np.argsort(arcs)
        return cls(size, arcs[order], weights[order], np.log10(backoff / (word_counts + backoff)), np.log10(p))

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Weights of reading ``word`` in ``state``; the next state is the word."""
        if not len(self.arcs):
            return self.fail[state] + self.root[word]
        wanted = state * self.size + word
        at = np.minimum(np.searchsorted(self.arcs, wanted), len(self.arcs) - 1)
        return np.where(self.arcs[at] == wanted, self.weights[at], self.fail[state] + self.root[word])

    def scores(self, own: Segment) -> np.ndarray:
        """log10 probability of each text: all lanes read one token per step and carry their state."""
        firsts = np.cumsum(own.lengths) - own.lengths
        parts = -(-own.lengths // LANE)
        doc = np.repeat(np.arange(len(parts)), parts)
        begin = firsts[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * LANE
        length = np.minimum(LANE, firsts[doc] + own.lengths[doc] - begin)
        order = np.argsort(-length, kind="stable")
        doc, begin, length = doc[order], begin[order], length[order]
        state = own.history[begin]
        sums = np.zeros(len(doc))
        for step in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -step, side="left"))  # lanes longer than ``step``
            word = own.tokens[begin[:live] + step]
            sums[:live] += self.step(state[:live], word)
            state[:live] = word
        return np.bincount(doc, sums, minlength=len(parts))


def score(docs: DataFrame, held: Column, backoff: float = BACKOFF) -> DataFrame:
    """One row per document: held_out, tokens, known tokens, N, unigram score and the model's score."""
    corpus = encode(docs, held)
    total, n = corpus.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0))).first()
    bits = max(6, int(total // BUCKET).bit_length())
    v = vocabulary(corpus, bits)

    def run(key, segments: pa.Table, told: pa.Table) -> pa.Table:
        out = []
        for row in segments.to_pylist():
            own = Segment.read(row)
            word_counts, bigram_counts = own.train_counts()
            cuts = _cuts(own.bigrams, bits)
            replies = sorted(told.to_pylist(), key=lambda r: r["bucket"])
            word_counts = np.concatenate([unpack(r["totals"]) for r in replies])
            for r in replies:
                bigram_counts[cuts[r["bucket"]] + unpack(r["changed"])] = unpack(r["now"])
            automaton = Automaton.build(own, word_counts, bigram_counts, n, v, backoff)
            doc = np.repeat(np.arange(len(own.lengths)), own.lengths)
            out.append(pa.table({
                "doc_id": pa.array(row["doc_ids"], segments.schema.field("doc_ids").type.value_type),
                "held_out": own.held, "n_tokens": own.lengths,
                "n_known": np.bincount(doc, word_counts[own.tokens] > 0, len(own.lengths)).astype(np.int64),
                "train_tokens": np.full(len(own.lengths), n, np.int64),
                "base_score": np.bincount(doc, automaton.root[own.tokens], len(own.lengths)),
                "score": automaton.scores(own),
            }))
        return pa.concat_tables(out)

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    told = answer(ask(corpus, bits))
    return corpus.groupBy("segment").cogroup(told.groupBy("segment")).applyInArrow(
        run, f"doc_id {doc_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def op10_lm(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), held_out("doc_id", 7, 2))
