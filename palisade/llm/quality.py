"""Quality by weak supervision: a label model over heuristic labellers, then a hashed linear scorer.

Each heuristic votes good, bad or not at all on a text. The label model takes the votes as independent given the hidden
label and estimates by expectation-maximisation how often each labeller votes what under either label. It needs only
how often each pattern of votes occurs, and there is a fixed number of patterns, so it uses all documents at the price
of one small aggregation. The posterior of its pattern is a document's soft label. On a bounded sample (``SAMPLE`` rows,
chosen by a hash of the id and the text) these train a logistic regression on hashed features: the shapes of four
neighbouring characters, and the text's statistics in steps.

Cases: null and empty texts and texts without a word score 0 and are rejected; texts count whole; equal texts get equal
scores; if all documents vote alike there is nothing to learn and the posterior alone decides.
"""

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.frames import Batches, documents, fresh, map_batches, sample, table
from palisade.llm.words import mix

BITS = 14
#: Bound of the sample that the scorer is trained on.
SAMPLE = 8_000
EPOCHS, RATE = 4, 0.5
ROUNDS = 100
GOOD, BAD, NONE = 1, 0, 2
#: Texts of fewer words are too short for shares of words to mean much.
FEW = 12

SYMBOLS = set("#$%&*|~^<>{}[]\\=+@_")
_SHAPE = np.full(256, ord("a"), np.uint8)
_SHAPE[:128] = np.arange(128)
_SHAPE[65:91] = ord("A")
_SHAPE[97:123] = ord("a")
_SHAPE[48:58] = ord("9")
_SHAPE[9:14] = 32


class Stats(NamedTuple):
    words: int
    symbols: float  # symbols per word
    upper: float  # share of capitals among letters
    top: float  # share of the most frequent word
    again: float  # share of words that repeat the one before
    bars: float  # share of words that are no more than symbols
    short: float  # share of words of up to three characters
    ended: float  # share of words that end in a mark
    length: float  # mean length of a word
    lines: float  # share of lines that occurred before
    pairs: float  # share of pairs of neighbouring words that occurred before


def statistics(text: str) -> Stats:
    own = text.split()
    n = len(own)
    if not n:
        return Stats(0, *[0.0] * 10)
    counts = Counter(text)
    upper = sum(k for c, k in counts.items() if c.isupper())
    letters = sum(k for c, k in counts.items() if c.isalpha())
    lines = [x for x in text.split("\n") if x.strip()]
    return Stats(
        n, sum(counts[c] for c in SYMBOLS) / n, upper / max(1, letters), Counter(own).most_common(1)[0][1] / n,
        sum(a == b for a, b in zip(own, own[1:])) / n, sum(not w[0].isalnum() and len(w) < 3 for w in own) / n,
        sum(len(w) <= 3 for w in own) / n, sum(not w[-1].isalnum() for w in own) / n, sum(map(len, own)) / n,
        1 - len(set(lines)) / max(1, len(lines)), 1 - len(set(zip(own, own[1:]))) / (n - 1) if n > 1 else 0.0,
    )


def votes(s: Stats) -> list[int]:
    """One vote per labeller: bad beyond its limit, good within it, none on a text that is too short to tell."""
    long = s.words >= FEW
    limits = [
        (s.symbols, 0.4, s.words > 0), (s.upper, 0.5, long), (s.top, 0.15, long), (s.again, 0.08, long), (s.bars, 0.12, long),
        (-s.short, -0.06, long), (s.ended, 0.55, long), (abs(s.length - 6), 6, s.words > 0), (s.lines, 0.3, long), (s.pairs, 0.4, long),
    ]
    return [NONE if not enough else BAD if value > limit else GOOD for value, limit, enough in limits]


LABELLERS = len(votes(statistics("")))


class LabelModel(NamedTuple):
    """P(good), and for each labeller P(vote | label, it votes) as label x vote; no vote tells nothing."""

    prior: float
    tables: np.ndarray  # labellers x labels x votes

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        logs = np.log(self.tables)
        own = logs[np.arange(patterns.shape[1])[None, :], :, patterns].sum(axis=1)  # patterns x labels
        odds = own[:, GOOD] - own[:, BAD] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))

    def accuracies(self) -> np.ndarray:
        """Of each labeller, among the documents that it votes on."""
        right = self.prior * self.tables[:, GOOD, GOOD] + (1 - self.prior) * self.tables[:, BAD, BAD]
        wrong = self.prior * self.tables[:, GOOD, BAD] + (1 - self.prior) * self.tables[:, BAD, GOOD]
        return right / (right + wrong)


def fit_labels(patterns: np.ndarray, counts: np.ndarray) -> LabelModel:
    """Expectation-maximisation. At first a text is as bad as it has bad votes; half a vote is added to every cell."""
    q = 0.9 / (1 + 5.0 * (patterns == BAD).sum(axis=1))
    model = None
    for _ in range(ROUNDS):
        tables = np.ones((patterns.shape[1], 2, 3))
        for vote in (BAD, GOOD):
            here = (patterns == vote) * counts[:, None]
            tables[:, GOOD, vote] = 0.5 + (here * q[:, None]).sum(axis=0)
            tables[:, BAD, vote] = 0.5 + (here * (1 - q[:, None])).sum(axis=0)
        tables[:, :, :NONE] /= tables[:, :, :NONE].sum(axis=2, keepdims=True)
        prior = float(np.clip((q @ counts + 1) / (counts.sum() + 2), 1e-6, 1 - 1e-6))
        model = LabelModel(prior, tables)
        new = model.posterior(patterns)
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    return model


def features(text: str, s: Stats) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values: shapes of four characters (roots of their shares), and the step of each statistic."""
    shape = _SHAPE[np.frombuffer(text.encode(), np.uint8)]
    columns, values = np.zeros(0, np.int64), np.zeros(0)
    if len(shape) >= 4:
        quads = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(shape, 4)).view("<u4").ravel()
        hashed = (mix(quads.astype(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)
        counts = np.bincount(hashed, minlength=1 << BITS)
        columns = np.flatnonzero(counts)
        values = np.sqrt(counts[columns] / len(quads))
    steps = [min(10, int(v * 10)) for v in s[1:8]] + [min(20, int(s.length)), min(10, int(s.lines * 10)), min(10, int(s.pairs * 10))]
    names = np.array([i * 64 + step for i, step in enumerate(steps)], np.uint64)
    own = (mix(names + np.uint64(1 << 40)) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.concatenate([columns, own]), np.concatenate([values, np.full(len(own), 0.3)])


def read_votes(docs: DataFrame) -> DataFrame:
    """The pattern of votes of each document that has a word."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = [statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(["".join(map(str, votes(s))) for s in found if s.words], pa.string())], ["pattern"]
            )

    return map_batches(documents(docs).select("text"), run, "pattern string")


def label_model(docs: DataFrame) -> LabelModel | None:
    rows = read_votes(docs).groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()
    if not rows:
        return None
    return fit_labels(np.array([list(map(int, r["pattern"])) for r in rows]), np.array([r["n"] for r in rows], float))


class Scorer:
    """Logistic regression by Adagrad, with posteriors as targets."""

    def __init__(self, examples: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, seed: int = 3):
        self.weights, self.bias = np.zeros(1 << BITS), 0.0
        squares = np.full(1 << BITS, 1e-4)
        random = np.random.default_rng(seed)
        for _ in range(EPOCHS):
            for i in random.permutation(len(examples)):
                columns, values = examples[i]
                g = self.score(columns, values) - targets[i]
                step = g * values
                squares[columns] += step * step
                self.weights[columns] -= RATE * step / np.sqrt(squares[columns])
                self.bias -= 0.01 * g

    def score(self, columns: np.ndarray, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(values @ self.weights[columns] + self.bias, -700, 700))))


def train(docs: DataFrame, rows: int = SAMPLE) -> tuple[LabelModel, Scorer] | None:
    model = label_model(docs)
    if model is None:
        return None
    chosen = sample(documents(docs), rows, F.col("text"))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                s = statistics(text)
                if s.words:
                    columns, values = features(text, s)
                    out.append({"pattern": votes(s), "columns": columns.astype(np.int32).tobytes(), "values": values.astype(np.float32).tobytes()})
            yield from pa.Table.from_pylist(out, schema=_EXAMPLE).combine_chunks().to_batches()

    found = map_batches(chosen.select("text"), run, "pattern array<int>, columns binary, values binary").toArrow().to_pylist()
    found.sort(key=lambda r: (r["columns"], r["values"]))
    if not found:
        return None
    targets = model.posterior(np.array([r["pattern"] for r in found]))
    examples = [(np.frombuffer(r["columns"], np.int32), np.frombuffer(r["values"], np.float32).astype(float)) for r in found]
    return model, Scorer(examples, targets)


_EXAMPLE = pa.schema([("pattern", pa.list_(pa.int32())), ("columns", pa.binary()), ("values", pa.binary())])


def _judge(trained, text: str) -> tuple[float, float]:
    """Posterior of the votes and the scorer's score; 0 without a word."""
    s = statistics(text)
    if not s.words or trained is None:
        return 0.0, 0.0
    model, scorer = trained
    return float(model.posterior(np.array([votes(s)]))[0]), scorer.score(*features(text, s))


def classify(docs: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, posterior of its votes, score and whether it is kept (score of 0.5 or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, rows))
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = np.array([_judge(shared.value, t) for t in batch.column("text").to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(found[:, 1] >= 0.5)],
                ["doc_id", "posterior", "score", "keep"],
            )

    return map_batches(documents(docs), run, f"doc_id {doc_type}, posterior double, score double, keep boolean")


def keep_good(docs: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """The documents that the scorer keeps, with all their columns, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, rows))
    names, own = docs.columns, fresh(docs, "whole_text")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            keep = [_judge(shared.value, t)[1] >= 0.5 for t in batch.column(own).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_())).select(names)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return map_batches(docs.withColumn(own, text), run, docs.schema)


def op4_quality(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))
