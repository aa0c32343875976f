"""Product quantisation of vectors in whole numbers, with exact products on float64 matrix units.

A component becomes floor(4096 x). Vectors are cut into equal consecutive parts; each part position has a codebook that
rounds of assignment and means refine. Distances need dot products of whole numbers: each number is broken into limbs so
short that a float64 matrix product of two limbs stays below 2**53, hence is exact; the products are put together again
in int64, and the first smallest entry is taken. Nothing is rounded, so the result depends neither on the order of
summation nor on how rows are dealt to tasks.

A round is one pass over the stored numbers: a task adds up its rows by part and entry and sends at most one number per
part, entry and component; the codebooks (``ENTRIES`` vectors) are all that returns to the driver.

Cases: rows whose vector is null or holds null or non-finite components are dropped. The codebooks start from the
``ENTRIES`` smallest distinct non-null ids (fewer, if there are fewer); of several vectors of one id the smallest
component by component starts. Equal rows all count. Vectors that cannot be coded beside the first start vector (another
length, a length that ``parts`` does not divide, components so large that a sum of squares could leave 63 bits) and, where
no row has an id, all vectors are kept with null code and error. A label whose error leaves 63 bits gets a null sum; so do
labels of uncoded rows alone. A table without kept rows gives no rows. Only vec_id, embedding and label are looked at.
"""

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.frames import Batches, map_batches, store, table
from palisade.operators.skew import hot_keys, salted_join

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows of a matrix product.
ROWS = 8192


def most(size: int) -> int:
    """Largest magnitude for which the squared differences of a vector of ``size`` components sum up below 2**63."""
    return isqrt((2**63 - 1) // max(1, size)) // 2


def limb_bits(size: int) -> int:
    """Bits of a limb: ``size`` products of two limbs sum up below 2**53."""
    return (53 - int(size - 1).bit_length()) // 2


def limbs(x: np.ndarray, bits: int, count: int) -> list[np.ndarray]:
    """``x`` as float64 limbs, lowest first: all but the last in [0, 2**bits), the last one signed."""
    out = []
    for _ in range(count - 1):
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def products(x: np.ndarray, y: np.ndarray, top: int) -> np.ndarray:
    """All dot products of rows of ``x`` and ``y`` (int64, magnitudes up to ``top``), exactly."""
    bits = limb_bits(x.shape[1])
    count = max(1, -(-(int(top).bit_length() + 1) // bits))
    out = np.zeros((len(x), len(y)), np.int64)
    right = limbs(y, bits, count)
    for i, a in enumerate(limbs(x, bits, count)):
        for j, b in enumerate(right):
            out += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, book: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the first nearest entry of each row, and the squared distance to it."""
    far = (book * book).sum(axis=1) - 2 * products(x, book, top)
    code = far.argmin(axis=1)
    return code, far[np.arange(len(x)), code] + (x * x).sum(axis=1)


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id, label and components of the rows that take part (values that no long holds become the nearest long)."""
    x = F.col("embedding")
    kept = vectors.select("vec_id", "label", "embedding").where(
        x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    )
    return kept.select("vec_id", "label", F.transform(x, lambda v: F.floor(v.cast("double") * SCALE)).alias("x"))


def blocks(column: pa.Array, size: int):
    """Rows of lists of ``size`` as int64 matrices: the row numbers and the matrix, a bounded number of rows at a time."""
    for at in range(0, len(column), ROWS):
        own = column.slice(at, ROWS)
        yield at, own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), size).astype(np.int64)


def start(numbers: DataFrame, entries: int = ENTRIES) -> np.ndarray:
    """Components of the vectors of the smallest ids, a row each."""
    ids = numbers.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries)
    ids = [r["vec_id"] for r in ids.collect()]
    rows = numbers.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id").collect()
    size = len(rows[0]["x"]) if rows else 0
    usable = [r["x"] for r in rows if len(r["x"]) == size and max(map(abs, r["x"]), default=0) <= most(size)]
    return np.array(usable, np.int64).reshape(len(usable), size)


def refine(coded: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: ``books`` (parts x entries x components) moved to the floors of their parts' means."""
    parts, entries, width = books.shape
    top = most(parts * width)
    shared = coded.sparkSession.sparkContext.broadcast(books)

    def add(batches: Batches) -> Batches:
        books = shared.value
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for _, x in blocks(batch.column("x"), parts * width):
                for p in range(parts):
                    own = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
                    code, _ = nearest(own, books[p], top)
                    counts[p] += np.bincount(code, minlength=entries)
                    np.add.at(sums[p], code, own)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p), pa.array(e), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["p", "e", "n", "sums"]
        )

    wide = "decimal(38,0)"
    found = map_batches(coded.select("x"), add, "p long, e long, n long, sums array<long>").groupBy("p", "e").agg(
        F.sum(F.col("n").cast(wide)).alias("n"),
        F.array(*[F.sum(F.get("sums", F.lit(i)).cast(wide)) for i in range(width)]).alias("sums"),
    )
    moved = books.copy()
    for r in found.collect():  # at most a row per part and entry
        moved[r["p"], r["e"]] = [int(s) // int(r["n"]) for s in r["sums"]]
    return moved


def train(coded: DataFrame, first: np.ndarray, parts: int = PARTS, rounds: int = ROUNDS) -> np.ndarray:
    books = np.ascontiguousarray(first.reshape(len(first), parts, -1).transpose(1, 0, 2))
    for _ in range(rounds):
        books = refine(coded, books)
    return books


def encode(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of vectors that the codebooks fit."""
    parts, _, width = books.shape
    top = most(parts * width)
    shared = coded.sparkSession.sparkContext.broadcast(books)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            code, error = np.zeros((batch.num_rows, parts), np.uint8), np.zeros(batch.num_rows, np.int64)
            for at, x in blocks(batch.column("x"), parts * width):
                for p in range(parts):
                    own = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
                    code[at : at + len(x), p], far = nearest(own, shared.value[p], top)
                    error[at : at + len(x)] += far
            text = code.tobytes().hex()
            texts = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(texts, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in coded.schema}
    return map_batches(coded.select("vec_id", "label", "x"), run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row of vec_id, embedding, label."""
    if entries > 256:
        raise ValueError("a code has two hex digits")
    numbers = store(whole_numbers(vectors), "codes-numbers")
    first = start(numbers, entries)
    size = first.shape[1]
    fits = (F.size("x") == size) & F.forall("x", lambda v: v.between(-most(size), most(size))) if len(first) and size and size % parts == 0 else F.lit(False)
    books = train(numbers.where(fits), first, parts, rounds) if size and size % parts == 0 else np.zeros((parts, 0, 0), np.int64)
    rest = numbers.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    done = encode(numbers.where(fits), books).unionByName(rest) if books.size else rest
    # A null label is a label of its own.
    done = store(done.withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce(F.col("label").cast("string"), F.lit(""))}), "codes")
    keys = ["_none", "_label"]
    sums = store(done.groupBy(*keys).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count("*").alias("rows")), "codes-labels")
    joined = salted_join(done, sums.select(*keys, "total"), keys, hot_keys(sums, keys, "rows"), ["vec_id", "code"])
    return joined.select(
        "vec_id", "code", "error", F.col("total").try_cast("long").alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256")
    )


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))
