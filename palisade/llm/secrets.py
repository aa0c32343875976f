"""Secret scan with corpus-wide ownership.

Three patterns find candidates in every whole text. The hash of each candidate's value is then aggregated over the
corpus by the distinct repositories and owners that hold it in different texts (copies of a text count once, for the
first owner that has it): a value that several owners have, none of them nearly alone, is a copied example; another one
that looks random is a live credential. Values that are known from a key word somewhere
are also found where they stand bare ("reuse" spans).

Cases: null and empty texts have no spans; repeated rows each get a row, and count once in ownership; a null repository
or owner counts as one unknown one; no length limit on texts.
"""

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.frames import Batches, documents, fresh, map_batches, row_ids, store, table, text_key

# The patterns, their least lengths and their order.
ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, so the least length can be part of the pattern
KINDS = ("assign", "access", "hex", "reuse")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
#: Bare values: runs of the characters of a value that hold a digit.
BARE = re.compile(r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*[0-9])[A-Za-z0-9+/_.=-]{12,}")
#: Every text with a candidate matches this.
POSSIBLE = r"(?i)[0-9]|password|passwd|secret|token|api_?key|akia|[a-f]{16}"
#: A value that so many owners have is an example.
COPIED_OWNERS = 3
#: Unless one owner has more than this share of its repositories.
MAIN_SHARE = 0.9
#: Bits per character from which a value looks random.
LIVE_BITS = 2.5

_SPAN = "struct<kind:int,start:int,stop:int,value:binary,bits:double>"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of the three patterns, leftmost and not overlapping per kind, in code points."""
    found = []
    for m in ASSIGN.finditer(text):
        if m.end(1) - m.start(1) >= LEAST_ASSIGN:
            found.append((0, m.start(), m.end(), m.group(1)))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST_ACCESS:
                found.append((1, m.start(), m.end(), m.group()))
    for m in HEX.finditer(text):
        found.append((2, m.start(), m.end(), m.group()))
    return sorted(found, key=lambda s: (s[1], s[0]))


def bare_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Bare values outside the base spans."""
    taken = [(start, end) for _, start, end, _ in base]
    return [
        (3, m.start(), m.end(), m.group()) for m in BARE.finditer(text)
        if not any(start < m.end() and m.start() < end for start, end in taken)
    ]


def bits(value: str) -> float:
    """Entropy of the characters of a value."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def span_text(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end, *_ in spans)


def scan(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """One stored row per document: row number, doc_id, text key, repository, owner, counts, digest of base spans, candidates."""
    picked = documents(
        docs, repository.cast("string").alias("repository"), owner.cast("string").alias("owner"), text_key().alias("text_key")
    )
    doc_id = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        numbers = row_ids()
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py()
                base = base_spans(text)
                kinds = Counter(s[0] for s in base)
                rows.append({
                    "row": next(numbers), "n_assign": kinds[0], "n_access": kinds[1], "n_hex": kinds[2],
                    "base_sha256": hashlib.sha256(span_text(base).encode()).hexdigest(),
                    "candidates": [
                        {"kind": k, "start": a, "stop": b, "value": hashlib.sha256(v.encode()).digest()[:16], "bits": bits(v)}
                        for k, a, b, v in base + bare_spans(text, base)
                    ],
                })
            out = pa.Table.from_pylist(rows, schema=_SCHEMA).combine_chunks().to_batches()
            for part in out:
                columns = [batch.column(i) for i in (0, 2, 3, 4)] + part.columns
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "repository", "owner", "text_key", *part.schema.names])

    schema = (
        f"doc_id {doc_id}, repository string, owner string, text_key binary, row long, n_assign long, n_access long, n_hex long, "
        f"base_sha256 string, candidates array<{_SPAN}>"
    )
    return store(map_batches(picked, run, schema), "secret-scan")


_SCHEMA = pa.schema([
    ("row", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
    ("base_sha256", pa.string()),
    ("candidates", pa.list_(pa.struct([
        ("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.binary()), ("bits", pa.float64()),
    ]))),
])


def candidates(scanned: DataFrame) -> DataFrame:
    return scanned.where(F.size("candidates") > 0).select(
        "row", "text_key", "repository", "owner", F.explode("candidates").alias("c")
    ).select("row", "text_key", "repository", "owner", "c.*")


def ownership(found: DataFrame, copied_owners: int = COPIED_OWNERS, main_share: float = MAIN_SHARE, live_bits: float = LIVE_BITS) -> DataFrame:
    """One row per value: distinct repositories and owners, whether a key word or pattern names it, and its class.

    Distinct counts are made by grouping step by step, each time combined before the shuffle, so a value that every document
    holds is no hot group.
    """
    none = F.lit("")
    by_text = found.groupBy("value", "text_key").agg(
        F.min(F.struct(F.coalesce("owner", none).alias("owner"), F.coalesce("repository", none).alias("repository"))).alias("first"),
        F.max(F.col("kind") != 3).alias("named"), F.max("bits").alias("bits"), F.count("*").alias("n"),
    )
    each = by_text.groupBy("value", F.col("first.owner").alias("owner"), F.col("first.repository").alias("repository")).agg(
        F.max("named").alias("named"), F.max("bits").alias("bits"), F.sum("n").alias("n")
    )
    by_owner = each.groupBy("value", "owner").agg(
        F.count("*").alias("repositories"), F.max("named").alias("named"), F.max("bits").alias("bits"), F.sum("n").alias("n")
    )
    return by_owner.groupBy("value").agg(
        F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.max("repositories").alias("main"), F.max("named").alias("named"),
        F.max("bits").alias("bits"), F.sum("n").alias("occurrences"),
    ).withColumn(
        "class",
        F.when((F.col("owners") >= copied_owners) & (F.col("main") <= main_share * F.col("repositories")), "copied").when(F.col("bits") >= live_bits, "live").otherwise("weak"),
    )


def spans(scanned: DataFrame) -> DataFrame:
    """Every span with its row number and the class of its value; bare values only if they are named elsewhere."""
    found = store(candidates(scanned), "secret-candidates")
    known = ownership(found).where("named").select("value", "owners", "repositories", "class")
    return found.select("row", "text_key", "kind", "start", "stop", "value").join(known, "value")


def find_secrets(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """One row per document: digests of the spans, and how many values are copied, live or weak."""
    scanned = scan(docs, repository, owner)
    names = F.array(*[F.lit(k) for k in KINDS])
    by_row = spans(scanned).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "stop"))).alias("all"),
        F.sum((F.col("class") == "copied").cast("long")).alias("n_copied"),
        F.sum((F.col("class") == "live").cast("long")).alias("n_live"),
    )
    told = F.concat_ws(",", F.transform(
        "all", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))
    ))
    return scanned.select("row", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256").join(by_row, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(told, F.lit("")).alias("spans"),
        F.coalesce("n_copied", F.lit(0)).alias("n_copied"), F.coalesce("n_live", F.lit(0)).alias("n_live"),
    )


def redact(docs: DataFrame, repository: Column, owner: Column, mark: str = "<secret>") -> DataFrame:
    """The documents with every span whose value is no copied example replaced by ``mark``; n_chars follows the text.

    All other documents stay as they are; those that cannot hold a candidate are not even shuffled.
    """
    possible = F.coalesce(F.col("text").rlike(POSSIBLE), F.lit(False))
    key, cuts = fresh(docs, "text_key"), fresh(docs, "cuts")
    asked = docs.where(possible)
    found = spans(scan(asked, repository, owner)).where(F.col("class") != "copied")
    # Equal texts have equal spans, so one list per text serves all its copies.
    by_text = found.select("text_key", "start", "stop").distinct().groupBy("text_key").agg(
        F.array_sort(F.collect_list(F.struct("start", "stop"))).alias(cuts)
    ).withColumnRenamed("text_key", key)
    joined = asked.withColumn(key, text_key()).join(by_text, key, "left").drop(key)
    names = docs.columns

    def run(batches: Batches) -> Batches:
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            texts = [cut(t.as_py(), c.as_py(), mark) for t, c in zip(columns["text"], columns.pop(cuts))]
            changed = {"text": pa.array(texts, columns["text"].type)}
            if "n_chars" in columns:
                changed["n_chars"] = pa.array([None if t is None else len(t) for t in texts], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([changed.get(n, columns[n]) for n in names], names)

    hit = map_batches(joined.where(F.col(cuts).isNotNull()).select(*names, cuts), run, docs.schema)
    return docs.where(~possible).unionByName(joined.where(F.col(cuts).isNull()).select(*names)).unionByName(hit)


def cut(text: str, spans: list[dict], mark: str) -> str:
    """Replace spans, given by start; overlapping ones become one mark."""
    out, at = [], 0
    for span in spans:
        if span["start"] >= at:
            out += [text[at : span["start"]], mark]
        at = max(at, span["stop"])
    return "".join(out) + text[at:]


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    """Every document is a repository of its own; its source owns it."""
    return find_secrets(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("source"))
