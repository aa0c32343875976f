"""Toxicity: averaged embeddings of subwords under a linear softmax, both learned together in numpy.

A text is the bag of the character n-grams of its words; the mean of their vectors goes through a softmax over the two
classes. As vectors belong to n-grams and not to words, a misspelling that was never seen shares most of its vectors
with the word it comes from. N-grams weigh by the root of their count, so that a word repeated a thousand times does
not outweigh the rest of its text.

Vectors are learned on a bounded sample of the labelled rows (at most ``TOXIC`` and ``CLEAN`` ids, those of smallest
hash); n-grams that fewer than ``LEAST`` of its texts have are left out. As the mean and the layer above are linear, a text is scored
with one number per n-gram.

Cases: null and empty texts have an empty bag and get the score of the intercept; labels that are null, doubled or
without a document are no trouble (the highest label counts); without labels all scores are 0.5 and predicted is 1.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.chargrams import grams
from palisade.llm.frames import Batches, documents, held_out, map_batches, store, table
from palisade.llm.language import sample_bags

SIZES = (3, 4, 5)
BITS = 18
DIMENSIONS = 8
#: Bounds of the sample.
TOXIC, CLEAN = 3000, 9000
LEAST = 5
EPOCHS, RATE = 4, 0.25


def bags(texts: list[str]):
    """Per text: its distinct columns and their counts."""
    for found, _ in grams(texts, SIZES, BITS, "isalnum"):
        yield np.unique(found, return_counts=True)


def weights_of(counts: np.ndarray) -> np.ndarray:
    root = np.sqrt(counts)
    return (root / root.sum() if len(root) else root).astype(np.float32)


class Model:
    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, odds: float | None = None, seed: int = 7):
        """``odds``: of label 1 among all labelled rows, where the sample is not drawn evenly."""
        random = np.random.default_rng(seed)
        seen = np.zeros(1 << BITS, np.int64)
        for columns, _ in bags:
            seen[columns] += 1
        self.kept = seen >= LEAST
        self.vectors = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BITS, DIMENSIONS))
        self.layer = random.normal(0, 0.1, (DIMENSIONS, 2))
        self.bias = np.zeros(2)
        total, done = EPOCHS * len(bags), 0
        for _ in range(EPOCHS):
            for i in random.permutation(len(bags)):
                columns, counts = bags[i]  # views of what the tasks sent: nothing is copied for all texts at once
                some = self.kept[columns]
                self._learn(columns[some], weights_of(counts[some]), labels[i], RATE * (1 - done / total))
                done += 1
        ones = int(labels.sum())
        if odds and 0 < ones < len(labels):
            self.bias[1] += np.log(odds / (ones / (len(labels) - ones)))

    def _learn(self, columns: np.ndarray, weights: np.ndarray, label: int, rate: float) -> None:
        mean = weights @ self.vectors[columns]
        z = mean @ self.layer + self.bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[label] -= 1
        back = self.layer @ p
        self.layer -= np.clip(rate * np.outer(mean, p), -0.1, 0.1)
        self.bias -= 0.05 * rate * p
        # The share of one n-gram in a long text is small: its step grows with the root of the bag's size.
        self.vectors[columns] -= (10 * rate * np.sqrt(len(columns)) * weights)[:, None] * back

    def margins(self) -> tuple[np.ndarray, float]:
        """The difference of the two class scores as one number per column (0 for those left out), and the intercept."""
        each = self.vectors @ (self.layer[:, 1] - self.layer[:, 0])
        return np.where(self.kept, each, 0.0), float(self.bias[1] - self.bias[0])


def train(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> Model | None:
    """A model from the labelled rows of ``docs``; None without labels.

    The ids of the sample are chosen before texts are touched: exactly the ``toxic`` and ``clean`` ids of smallest hash
    meet the documents in a broadcast join, so no other text is shuffled. An id of several texts is there with the first
    of them in order.
    """
    known = (
        labels.where("toxic is not null and doc_id is not null").groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where("toxic in (0, 1)")
    )
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    first = lambda value, n: known.where(F.col("toxic") == value).orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(n)
    chosen = store(first(1, toxic).unionByName(first(0, clean)), "toxicity-sample")
    joined = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    once = joined.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("string").alias("toxic"))
    rows = sample_bags(once, "toxic", bags, pieces=8)
    if not rows:
        return None
    odds = counts.get(1, 0) / counts[0] if counts.get(0) else None
    return Model([r[1:] for r in rows], np.array([int(r[0]) for r in rows]), odds)


def predict(docs: DataFrame, model: Model | None, held: Column) -> DataFrame:
    """One row per document: doc_id, held_out, score (higher: label 1 is likelier) and predicted."""
    spark, doc_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    margins, intercept = model.margins() if model else (np.zeros(1 << BITS), 0.0)
    shared = spark.sparkContext.broadcast((margins, model.kept if model else np.zeros(1 << BITS, bool)))  # about 2 MB

    def run(batches: Batches) -> Batches:
        margins, kept = shared.value
        for batch in batches:
            sums = []
            for columns, counts in bags(batch.column("text").to_pylist()):
                some = kept[columns]
                sums.append(float(weights_of(counts[some]) @ margins[columns[some]]))
            scores = 1 / (1 + np.exp(-np.clip(np.array(sums) + intercept, -700, 700)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    picked = documents(docs, held.alias("held_out")).select("doc_id", "held_out", "text")
    return map_batches(picked, run, f"doc_id {doc_type}, held_out boolean, score double, predicted int")


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = held_out("doc_id", 5, 0)
    model = train(docs.where(~held), labels.where(~held))
    return predict(docs, model, held)
