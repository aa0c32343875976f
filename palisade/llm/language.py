"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all training texts. The weights are learned by follow-the-regularised-leader with
elastic-net penalties, one example after the other, on a bounded sample of the labelled texts (``PER_LANGUAGE`` rows of
each language, chosen by a hash of the id); most weights stay exactly zero. A fifth of the sample is kept back to set
one temperature, so that the probabilities of the classes mean what they say.

Cases: a null text or one without letters is ``und`` with score 0; texts without a label are predicted and not learned
from; without any label everything is ``und``; ties go to the language that comes first in the alphabet; texts count
whole, whatever their length.
"""

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.chargrams import grams
from palisade.llm.frames import Batches, documents, held_out, map_batches, sample, store, table

SIZES = (1, 2, 3)
BITS = 15
#: Bound of the sample that weights are learned from.
PER_LANGUAGE = 1500
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # columns x languages
    bias: np.ndarray
    temperature: float

    def probabilities(self, columns: np.ndarray, counts: np.ndarray) -> np.ndarray:
        z = (self.features(columns, counts) @ self.weights[columns] + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def features(self, columns: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return tf_idf(self.idf, columns, counts)


def tf_idf(idf: np.ndarray, columns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[columns]
    return x / np.sqrt(x @ x) if len(x) else x


def bags(texts: list[str]):
    """Per text: its distinct columns, their counts, and whether it has a letter."""
    for found, letters in grams(texts, SIZES, BITS):
        counts = np.bincount(found, minlength=1 << BITS)
        columns = np.flatnonzero(counts)
        yield columns, counts[columns], letters > 0


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """In how many texts each column occurs: one sum per column and task, added up by column."""

    def run(batches: Batches) -> Batches:
        sums = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for columns, _, _ in bags(batch.column("text").to_pylist()):
                sums[columns] += 1
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], ["column", "n"])

    rows = map_batches(docs.select("text"), run, "column int, n long").groupBy("column").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BITS, np.int64)
    out[rows["column"].to_numpy()] = rows["n"].to_numpy()
    return out


def sample_bags(chosen: DataFrame, label: str, run_bags, pieces: int = 1) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(label, columns, counts) of the rows of a bounded sample, fetched in so many pieces, one after the other."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            rows = [
                {"label": y, "columns": c.astype(np.int32).tobytes(), "counts": np.minimum(n, MOST).astype(np.uint16).tobytes()}
                for y, (c, n, *_) in zip(batch.column(label).to_pylist(), run_bags(batch.column("text").to_pylist()))
            ]
            yield from pa.Table.from_pylist(rows, schema=_BAG).combine_chunks().to_batches()

    found = map_batches(chosen.select("text", F.col(label).cast("string").alias(label)), run, "label string, columns binary, counts binary")
    if pieces > 1:
        found = store(found, "bags")
        piece = F.pmod(F.crc32("columns"), F.lit(pieces))
        found = pa.concat_tables([found.where(piece == i).toArrow() for i in range(pieces)])
    else:
        found = found.toArrow()
    view = lambda x, kind: np.frombuffer(x.as_buffer(), kind)  # noqa: E731  the table's own memory
    rows = [(y.as_py(), view(c, np.int32), view(n, np.uint16)) for y, c, n in zip(found["label"], found["columns"], found["counts"])]
    # The order in which rows arrive must not matter.
    return sorted(rows, key=lambda r: (zlib.crc32(r[1]), zlib.crc32(r[2]), r[0]))


#: Counts of the sample travel in 16 bits; higher ones count as this.
MOST = 65_535
_BAG = pa.schema([("label", pa.string()), ("columns", pa.binary()), ("counts", pa.binary())])


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for a softmax; a weight is zero while |z| is at most L1."""

    def __init__(self, columns: int, classes: int):
        self.z, self.n = np.zeros((columns, classes)), np.zeros((columns, classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, x: np.ndarray, target: int) -> None:
        w = self.weights(at)
        score = x @ w
        p = np.exp(score - score.max())
        p /= p.sum()
        p[target] -= 1
        g = x[:, None] * p
        old = self.n[at]
        new = old + g * g
        self.z[at] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w
        self.n[at] = new


def temperature(scores: np.ndarray, targets: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not len(scores):
        return 1.0

    def loss(log_t: float) -> float:
        z = scores / np.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), targets]))

    low, high, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model learned from the rows of ``docs`` that have a text and a language; None if there are none."""
    labelled = docs.where("text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    idf = np.log((1 + sum(counts.values())) / (1 + document_frequencies(labelled))) + 1
    rows = sample_bags(sample(labelled, per_language, F.col("text"), "lang"), "lang", bags)
    order = np.random.default_rng(1).permutation(len(rows))
    kept_back = order[::5] if len(rows) >= 50 else order[:0]
    learned = np.setdiff1d(order, kept_back)
    model = Ftrl((1 << BITS) + 1, len(languages))
    number = {k: i for i, k in enumerate(languages)}

    def example(i: int) -> tuple[np.ndarray, np.ndarray, int]:
        label, columns, n = rows[i]
        x = tf_idf(idf, columns, n)
        return np.append(columns, 1 << BITS), np.append(x, 1.0), number[label]  # the last column is the bias

    random = np.random.default_rng(2)
    for _ in range(EPOCHS):
        for i in random.permutation(learned):
            model.learn(*example(i))
    w = model.weights()
    kept = [example(i) for i in kept_back]
    scores = np.array([x @ w[c] for c, x, _ in kept]).reshape(len(kept), len(languages))
    t = temperature(scores, np.array([y for *_, y in kept], np.int64))
    return Model(languages, idf, w[:-1], w[-1], t)


def predict(docs: DataFrame, model: Model | None, held: Column) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred and the calibrated probability of that language."""
    spark, doc_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)  # 2^15 columns: a few MB

    def run(batches: Batches) -> Batches:
        model: Model | None = shared.value
        for batch in batches:
            names, scores = [], []
            for columns, counts, letters in bags(batch.column("text").to_pylist()):
                if model is None or not letters:
                    names.append("und")
                    scores.append(0.0)
                else:
                    p = model.probabilities(columns, counts)
                    names.append(model.languages[int(p.argmax())])
                    scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    picked = documents(docs, held.alias("held_out")).select("doc_id", "held_out", "text")
    return map_batches(picked, run, f"doc_id {doc_type}, held_out boolean, lang_pred string, score double")


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), held_out("doc_id", 5, 0)
    return predict(docs, train(docs.where(~held)), held)
