"""Token ids in compressed binary files: one canonical Huffman code from global counts, blocks that stand alone.

A folder holds three tables. ``blocks``: in each shard (a partition of the order by id) the ids of its documents one
after the other, cut every ``BLOCK`` ids; a row has the bits of a block, the bit offset of every ``STRIDE``-th id, and
which documents lie where in it. ``codebook``: id, count and code length; the code itself follows from the lengths.
``shards``: how many ids stand before each shard. Rows are written by Spark's Parquet writer, so a folder may be in any
store that Spark reaches.

Code lengths are the best ones of at most ``LIMIT`` bits (package merge), so decoding is one table look-up per id. A
batch is decoded in lanes, one per checkpoint, that advance together in numpy.

Cases: a null or empty text is a document of the end id alone; documents of null id come first; of one id, by a hash of
their ids, equal rows are documents of their own; a document longer than a block goes on in the next; a table without
documents gives no rows; other columns are not looked at.
"""

import json
import os
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.llm.frames import Batches, documents, map_batches, store, table
from palisade.storage import new_path

TOKENIZER, END = "word_bpe_49k.json", 1
BLOCK, STRIDE, LIMIT = 1 << 16, 1 << 8, 18
#: Pieces of words that a worker remembers, and characters of the longest one.
MEMORY, LONGEST = 800_000, 64
#: Words that are looked up at once.
WORDS = 1 << 20
BLOCKS = (
    "shard int, first long, n int, checkpoints array<int>, bits binary, "
    "documents array<struct<doc_id: long, row: long, at: int, n: int, after: long>>"
)
DOCUMENT = pa.struct([("doc_id", pa.int64()), ("row", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("after", pa.int64())])
ARROW_BLOCKS = pa.schema([
    ("shard", pa.int32()), ("first", pa.int64()), ("n", pa.int32()), ("checkpoints", pa.list_(pa.int32())), ("bits", pa.binary()),
    ("documents", pa.list_(DOCUMENT)),
])


# -- texts to ids ----------------------------------------------------------------------------------


def gathered(flat: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that start at ``begin``, one after the other."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(begin - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


class Words:
    """Ids of texts by way of their different words and the words' different pieces.

    The tokenizer drops white space and never looks across it, so a text's ids are those of its words in a row. A word of
    ASCII and Latin-1 letters is cut where the tokenizer's own pattern cuts it (for these characters its normalisation is
    lower case alone), and the library encodes each piece once per worker: many as one text, which is parted again at the
    ids that end a piece. Other words, and those that may hold a special token, are encoded one by one; with a tokenizer
    of another pattern whole texts are.
    """

    #: The pattern that this way holds for.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    PLAIN = "^[!-~À-ÖØ-öø-ÿ]*$"
    PIECES = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+)"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library, self.cut = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.cut.normalizer = normalizers.Sequence([])
        self.cut.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ])
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = [step["type"] for step in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.known = steps == ["NFC", "Replace", "Lowercase"] and cuts[0].get("pattern") == {"Regex": self.PATTERN}
        self.kind = width(path)
        self.pieces: dict[str, bytes] = {}
        self.ends = np.zeros(1 << 16 if self.kind == "<u2" else self.library.get_vocab_size(), bool)
        self.ends[[i for token, i in self.library.get_vocab().items() if token.endswith("</w>")]] = True

    def packed(self, texts: list[str], library=None) -> list[bytes]:
        found = (library or self.library).encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def piece_ids(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of different pieces."""
        new = [p for p in pieces if p not in self.pieces]
        if len(self.pieces) + len(new) > MEMORY:
            self.pieces.clear()
            new = pieces
        for at in range(0, len(new), 1000):
            some = [p for p in new[at : at + 1000] if p]
            raw = self.packed([" ".join(some)], self.cut)[0]
            ids = np.frombuffer(raw, self.kind)
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
            if len(ends) != len(some):
                raise ValueError("the ids of a piece do not end with its last one")
            self.pieces.update(zip(some, [raw[a:b] for a, b in zip([0, *ends], ends)]))
        out = [self.pieces[p] if p else b"" for p in pieces]
        for p in new:
            if len(p) > LONGEST:
                del self.pieces[p]
        return out

    def word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different words: their ids in a row, and where those of each word begin and how many they are."""
        size = np.dtype(self.kind).itemsize
        plain = pc.and_(pc.match_substring_regex(words, self.PLAIN), pc.invert(pc.match_substring(words, "<|")))
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(words.filter(plain)), self.PIECES, r"\1 "))
        pieces = cut.flatten().dictionary_encode()
        packed = self.piece_ids(pieces.dictionary.to_pylist())
        lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // size
        which = pieces.indices.to_numpy()
        own = gathered(np.frombuffer(b"".join(packed), self.kind), (np.cumsum(lengths) - lengths)[which], lengths[which])
        totals = np.cumsum(np.concatenate([[0], lengths[which]]))
        edges = totals[np.cumsum(np.concatenate([[0], pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)]))]
        other = self.packed(words.filter(pc.invert(plain)).to_pylist())
        plain = plain.to_numpy(zero_copy_only=False)
        counts = np.empty(len(words), np.int64)
        counts[plain], counts[~plain] = np.diff(edges), [len(x) // size for x in other]
        begin = np.empty(len(words), np.int64)
        begin[plain], begin[~plain] = edges[:-1], len(own) + np.cumsum(counts[~plain]) - counts[~plain]
        return np.concatenate([own, np.frombuffer(b"".join(other), self.kind)]), begin, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text's end."""
        if not self.known:
            packed = self.packed(texts.to_pylist())
            return np.frombuffer(b"".join(packed), self.kind), np.cumsum([len(x) for x in packed], dtype=np.int64) // np.dtype(self.kind).itemsize
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten()
        ids, counts = [np.zeros(0, self.kind)], [np.zeros(1, np.int64)]
        for at in range(0, len(words), WORDS):
            some = words.slice(at, WORDS).dictionary_encode()
            flat, begin, sizes = self.word_ids(some.dictionary)
            which = some.indices.to_numpy()
            counts.append(sizes[which])
            ids.append(gathered(flat, begin[which], counts[-1]))
        places = np.cumsum(np.concatenate(counts))
        return np.concatenate(ids), places[np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))]


_words: dict[str, Words] = {}


def words_of(path: str) -> Words:
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def width(path: str) -> str:
    """The smallest unsigned type that holds every id of a tokenizer file."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    top = max([END, *spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])
    return "<u2" if top < 1 << 16 else "<u4"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenize(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """doc_id and the packed ids of each whole text, ``end`` last."""
    def run(batches: Batches) -> Batches:
        own = words_of(path)
        last = np.array([end], own.kind).tobytes()
        for batch in batches:
            found, ends = own.encode(batch.column("text"))
            ids = [found[a:b].tobytes() + last for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return map_batches(documents(docs).withColumn("doc_id", F.col("doc_id").cast("long")), run, "doc_id long, ids binary")


# -- the code --------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of the best prefix code of at most ``limit`` bits (or as many as the number of ids needs), by package merge."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    limit = max(limit, int(n - 1).bit_length())
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    layers, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        weight = np.concatenate([leaves, packages])
        merged = np.argsort(weight, kind="stable")
        layers.append(merged < n)
        pairs = weight[merged][: len(merged) // 2 * 2]
        packages = pairs[::2] + pairs[1::2]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for own in reversed(layers):
        own = own[:take]
        some = int(own.sum())
        lengths[order[:some]] += 1
        take = 2 * (len(own) - some)
    return lengths


class Codebook(NamedTuple):
    """Canonical codes: shorter ones first, of one length by id."""

    code: np.ndarray
    length: np.ndarray
    table: np.ndarray  # by the next ``limit`` bits: the id and, in the lowest six bits, the length of its code
    limit: int

    @classmethod
    def build(cls, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        ids, lengths = ids[order], lengths[order].astype(np.int64)
        limit = max(1, int(lengths.max(initial=1)))
        # Each code covers so many entries of the decoding table; codes are the running totals.
        span = np.int64(1) << (limit - lengths)
        starts = np.cumsum(span) - span
        code, length = np.zeros(int(ids.max(initial=0)) + 1, np.uint64), np.zeros(int(ids.max(initial=0)) + 1, np.int64)
        code[ids], length[ids] = starts >> (limit - lengths), lengths
        table = np.ones(1 << limit, np.int64)
        table[: int(span.sum())] = np.repeat(ids.astype(np.int64) << 6 | lengths, span)
        return cls(code, length, table, limit)


def pack(ids: np.ndarray, book: Codebook) -> tuple[bytes, np.ndarray]:
    """Bits of the ids, and the bit offset of every ``STRIDE``-th of them."""
    length = book.length[ids]
    starts = np.cumsum(length) - length
    word = starts >> 5
    placed = book.code[ids] << (64 - length - (starts & 31)).astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    both = np.add.reduceat(placed, first)  # codes that begin in one word: their bits do not meet
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    out[word[first]] += both >> np.uint64(32)
    out[word[first] + 1] += both & np.uint64(0xFFFFFFFF)
    bits = int(starts[-1] + length[-1])
    return out.astype(">u4").tobytes()[: -(-bits // 8)], starts[::STRIDE].astype(np.int32)


def unpack(bits: list[bytes], checkpoints: list[np.ndarray], counts: list[int], book: Codebook) -> list[np.ndarray]:
    """The ids of blocks: ``counts`` of each, from its bits and the offsets of its lanes' beginnings."""
    padded = [b + bytes(-len(b) % 4) for b in bits]
    spare = bytes(STRIDE * book.limit // 8 + 8)  # lanes that are done run on until the others are
    words = np.frombuffer(b"".join([*padded, spare, b"\0" * (-len(spare) % 4)]), ">u4").astype(np.uint64)
    pairs = words << np.uint64(32)
    pairs[:-1] |= words[1:]
    pairs = pairs.view(np.int64)
    begin = np.cumsum([0, *map(len, padded)])[:-1] * 8
    at = np.concatenate([c.astype(np.int64) + b for c, b in zip(checkpoints, begin)])
    sizes = np.concatenate([np.minimum(STRIDE, n - STRIDE * np.arange(len(c))) for c, n in zip(checkpoints, counts)])
    out = np.empty((STRIDE, len(at)), np.int64)
    mask, left = (1 << book.limit) - 1, 64 - book.limit
    for step in range(int(sizes.max(initial=0))):
        out[step] = found = book.table[(pairs[at >> 5] >> (left - (at & 31))) & mask]
        at += found & 63
    flat = (out.T >> 6)[np.arange(STRIDE) < sizes[:, None]].astype(np.uint32)
    return np.split(flat, np.cumsum(counts)[:-1])


# -- files -----------------------------------------------------------------------------------------


def count_ids(tokens: DataFrame, kind: str) -> DataFrame:
    """id and count, over all documents; a task sends one row per id."""
    def run(batches: Batches) -> Batches:
        total = np.zeros(0, np.int64)
        for batch in batches:
            raw = b"".join(x.as_py() for x in batch.column("ids"))
            own = np.bincount(np.frombuffer(raw, kind), minlength=len(total))
            own[: len(total)] += total
            total = own
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "count"])

    return map_batches(tokens.select("ids"), run, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))


def write(tokens: DataFrame, folder: str, kind: str) -> None:
    """Write a stored table of doc_id and packed ids (each document at least one) in ascending order of doc_id."""
    spark = tokens.sparkSession
    counts = count_ids(tokens, kind).orderBy("id").toArrow()  # at most a row per id of the vocabulary
    ids, n = counts["id"].to_numpy(), counts["count"].to_numpy()
    lengths = code_lengths(n)
    spark.createDataFrame(
        pa.table({"id": pa.array(ids, pa.int64()), "count": pa.array(n, pa.int64()), "length": pa.array(lengths, pa.int32())})
    ).coalesce(1).write.parquet(f"{folder}/codebook")
    book = spark.sparkContext.broadcast(Codebook.build(ids, lengths))

    def run(batches: Batches) -> Batches:
        shard, row, first = TaskContext.get().partitionId(), 0, 0
        parts: list[np.ndarray] = []
        inside: list[dict] = []
        filled = 0

        def block() -> pa.RecordBatch:
            bits, checkpoints = pack(np.concatenate(parts), book.value)
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([first]), pa.array([filled], pa.int32()), pa.array([checkpoints], pa.list_(pa.int32())),
                pa.array([bits]), pa.array([inside], pa.list_(DOCUMENT)),
            ], schema=ARROW_BLOCKS)

        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                own, at = np.frombuffer(raw.as_buffer(), kind), 0
                while at < len(own):
                    take = min(BLOCK - filled, len(own) - at)
                    inside.append({"doc_id": doc_id, "row": row, "at": filled, "n": take, "after": len(own) - at - take})
                    parts.append(own[at : at + take])
                    filled, at = filled + take, at + take
                    if filled == BLOCK:
                        yield block()
                        parts, inside, first, filled = [], [], first + filled, 0
                row += 1
        if filled:
            yield block()

    by = ["doc_id", "_tie", "_row"]
    ordered = tokens.withColumns({"_tie": F.xxhash64("ids"), "_row": F.monotonically_increasing_id()}).repartitionByRange(*by).sortWithinPartitions(*by)
    map_batches(ordered.select("doc_id", "ids"), run, BLOCKS).write.parquet(f"{folder}/blocks")
    sizes = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").groupBy("shard").agg(F.sum("n").cast("long").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as the shuffle has partitions
    sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), "n").write.parquet(f"{folder}/shards")


def read_codebook(spark: SparkSession, folder: str) -> Codebook:
    rows = spark.read.schema("id long, count long, length int").parquet(f"{folder}/codebook").toArrow()
    return Codebook.build(rows["id"].to_numpy(), rows["length"].to_numpy())


def decoded(batches: Batches, book: Codebook, some: int = 16) -> Iterator[tuple[dict, np.ndarray]]:
    """Blocks with their ids, a few blocks at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, some):
            rows = batch.slice(at, some).to_pylist()
            every = unpack([r["bits"] for r in rows], [np.array(r["checkpoints"]) for r in rows], [r["n"] for r in rows], book)
            yield from zip(rows, every)


def times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32, lowest power in the highest bit."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def followed(crc: int, more: int) -> int:
    """What the crc of a piece adds, by exclusive or, to that of the whole if ``more`` bytes follow the piece."""
    step = 1 << 23  # x to the 8: one byte
    while more:
        if more & 1:
            crc = times(crc, step)
        step, more = times(step, step), more >> 1
    return crc


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as the files have it: doc_id, start, n_tokens, ids_crc32. Blocks are decoded independently."""
    book = spark.sparkContext.broadcast(read_codebook(spark, folder))

    def run(batches: Batches) -> Batches:
        for block, ids in decoded(batches, book.value):
            raw = memoryview(ids.astype("<u4").tobytes())
            found = block["documents"]
            crc = [followed(zlib.crc32(raw[4 * d["at"] : 4 * (d["at"] + d["n"])]), 4 * d["after"]) for d in found]
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([block["shard"]] * len(found), pa.int32()), "row": [d["row"] for d in found], "doc_id": pa.array([d["doc_id"] for d in found], pa.int64()),
                "at": [block["first"] + d["at"] for d in found], "n": [d["n"] for d in found], "crc": crc,
            })

    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    pieces = map_batches(blocks, run, "shard int, row long, doc_id long, at long, n long, crc long")
    whole = pieces.groupBy("shard", "row").agg(
        F.min("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32")
    )
    shards = spark.read.schema("shard int, before long, n long").parquet(f"{folder}/shards")
    return whole.join(shards.select("shard", "before"), "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_range(spark: SparkSession, folder: str, start: int, stop: int) -> DataFrame:
    """place and id of the ids ``start`` to ``stop`` of the whole sequence: only lanes that hold some of them are decoded."""
    book = spark.sparkContext.broadcast(read_codebook(spark, folder))
    shards = spark.read.schema("shard int, before long, n long").parquet(f"{folder}/shards")
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").drop("documents").join(shards.drop("n"), "shard")
    at = F.col("before") + F.col("first")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                low, high = max(start - row["place"], 0), min(stop - row["place"], row["n"])
                lane = low // STRIDE
                lanes = np.array(row["checkpoints"][lane : -(-high // STRIDE)])
                ids = unpack([row["bits"]], [lanes], [min(row["n"], len(lanes) * STRIDE + lane * STRIDE) - lane * STRIDE], book.value)[0]
                ids = ids[low - lane * STRIDE : high - lane * STRIDE]
                yield pa.RecordBatch.from_arrays([pa.array(row["place"] + low + np.arange(len(ids))), pa.array(ids.astype(np.int64))], ["place", "id"])

    near = blocks.withColumn("place", at).where((F.col("place") < stop) & (F.col("place") + F.col("n") > start))
    return map_batches(near.select("place", "n", "checkpoints", "bits"), run, "place long, id long")


def op12_token_files(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = tokenizer or tokenizer_path()
    folder = new_path(spark, "token-files")
    write(store(tokenize(table(spark, sf_dir, "documents"), path), "tokens"), folder, width(path))
    return read_documents(spark, folder)
