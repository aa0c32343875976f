"""A Merkle manifest of a table whose parents keep the hash states before each child slot.

A parent's digest is SHA-256 over its children's digests as hex text. While a parent is built, the running state is copied
before each child and kept (``states``): to fold a replaced child, the state of its slot is resumed with the replacement
and the siblings to its right; what stands left of it is in the state. States are eight numbers (`sha_states`), so they
are stored with the tree and resumed in any task.

Rows get their places by one range-partitioned sort per table. A tree is built in bands: a group of ``SPAN`` neighbouring
nodes becomes one subtree in one task, then the roots of subtrees are the next band's nodes, so a tree of any size takes
few rounds of bounded groups. On the way down each subtree learns the path from its root to the top; the rows of a
bottom subtree are then folded together.

Cases: a null column is ``-`` in its leaf, different from an empty text; rows without an id come first; rows of one id are
ordered by leaf, equal rows are leaves of their own; a row of null id is not tampered with; a table without rows has no
root and gives no rows; columns besides the five are not looked at.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm import sha_states as S
from palisade.llm.frames import Batches, map_batches, store, table
from palisade.shipping import ship

#: Children of a parent, and nodes that one task joins to a subtree: 2 ** 12.
FANOUT = 2
BITS = 12
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SUBTREE = "tree string, pos long, total long, root binary, digests binary, states binary"
STEPS = "array<struct<state: binary, left: binary, right: binary>>"
STEP = pa.struct([("state", pa.binary()), ("left", pa.binary()), ("right", pa.binary())])
HEAD_PATHS = pa.schema([("pos", pa.int64()), ("steps", pa.list_(STEP))])
PATHS = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("subroot", pa.binary()), ("steps", pa.list_(STEP))])


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def tree_key(group: Column) -> Column:
    """A text that is never null and sorts null groups first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with their place ``pos`` in their ``tree`` by ``order``, and the tree's ``total``.

    Rows alike in everything are still spread over partitions, by their place in the input.
    """
    by = ["tree", *order, "_row"]
    dealt = store(
        rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_row")
        .withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "merkle-sorted",
    )
    runs = dealt.groupBy("tree", "_part").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    own = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = store(runs.select("tree", "_part", (before - F.col("first")).alias("shift"), F.sum("n").over(own).alias("total")), "merkle-runs")
    return dealt.join(runs, ["tree", "_part"]).withColumn("pos", F.col("_at") + F.col("shift")).drop("_part", "_at", "shift")


class Shape(NamedTuple):
    """How trees of this fan-out are cut into subtrees of ``span`` nodes and ``levels`` levels."""

    fanout: int
    levels: int

    @property
    def span(self) -> int:
        return self.fanout**self.levels

    def heights(self, n: int, total: int) -> list[int]:
        """Nodes of each level of a subtree over ``n`` nodes of a band of ``total``: the whole height unless it is the top."""
        out, goal = [n], self.levels if total > self.span else 0
        while out[-1] > 1 or len(out) <= goal:
            out.append(-(-out[-1] // self.fanout))
        return out


def shape(fanout: int = FANOUT) -> Shape:
    return Shape(fanout, max(1, int(BITS / np.log2(fanout))))


def parents(nodes: np.ndarray, fanout: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the parents of consecutive nodes (8 x n), and the states before each of their slots (8 x parents x fanout)."""
    n = nodes.shape[1]
    count = -(-n // fanout)
    blocks, state = S.hex_block(nodes), np.repeat(S.START, count, axis=1)
    kept = np.zeros((8, count, fanout), np.uint32)
    for slot in range(min(fanout, n)):
        kept[:, :, slot] = state
        has = -(-(n - slot) // fanout)  # the last parent may lack this child
        state[:, :has] = S.absorb(state[:, :has], blocks[:, slot::fanout])
    last = n - (count - 1) * fanout
    out = np.empty_like(state)
    if count > 1:
        out[:, :-1] = S.absorb(state[:, :-1], S.ending(fanout))
    out[:, -1:] = S.absorb(state[:, -1:], S.ending(last))
    return out, kept


def grow(items: DataFrame, form: Shape) -> list[DataFrame]:
    """Bands of subtrees over items (tree, pos, total, digest), stored, from the bottom up.

    A band's row: its place ``pos`` among ``total`` subtrees of the tree, its root, and level by level from the bottom all
    digests and, for each parent, the states before its slots.
    """
    def build(group: pa.Table) -> pa.Table:
        order = np.argsort(group["pos"].to_numpy(), kind="stable")
        nodes = S.words(b"".join(group["digest"].to_pylist()))[:, order]
        total = group["total"][0].as_py()
        digests, states = [nodes], []
        for _ in form.heights(nodes.shape[1], total)[1:]:
            up, kept = parents(digests[-1], form.fanout)
            digests.append(up)
            states.append(kept.reshape(8, -1))
        return pa.table({
            "tree": group["tree"][:1], "pos": [group["pos"][int(order[0])].as_py() // form.span], "total": [-(-total // form.span)],
            "root": [S.raw(digests[-1])], "digests": [b"".join(map(S.raw, digests))], "states": [b"".join(map(S.raw, states))],
        })

    ship(items.sparkSession)
    bands = []
    while True:
        groups = items.select("tree", "pos", "total", "digest", F.floor(F.col("pos") / form.span).alias("_subtree")).groupBy("tree", "_subtree")
        bands.append(store(groups.applyInArrow(build, SUBTREE), "merkle-band"))
        if (bands[-1].agg(F.max("total")).first()[0] or 0) <= 1:
            return bands
        items = bands[-1].where("total > 1").select("tree", "pos", "total", F.col("root").alias("digest"))


def tops(bands: list[DataFrame]) -> DataFrame:
    """tree and root of every tree."""
    found = bands[0]
    for band in bands[1:]:
        found = found.unionByName(band)
    return found.where("total = 1").select("tree", "root")


class Subtree(NamedTuple):
    """The stored levels of a subtree as arrays."""

    fanout: int
    heights: list[int]
    digests: list[np.ndarray]
    states: list[np.ndarray]

    @classmethod
    def read(cls, form: Shape, digests: bytes, states: bytes):
        every, kept = S.words(digests), S.words(states)
        n, heights = every.shape[1], []
        # The bottom level is what the other levels leave of all nodes; a state row per slot tells the parents.
        above = kept.shape[1] // form.fanout
        heights = [n - above]
        while sum(heights) < n:
            heights.append(-(-heights[-1] // form.fanout))
        cuts = np.cumsum(heights)[:-1]
        slots = np.cumsum([h * form.fanout for h in heights[1:]])[:-1]
        levels = [k.reshape(8, -1, form.fanout) for k in np.split(kept, slots, axis=1)] if len(heights) > 1 else []
        return cls(form.fanout, heights, np.split(every, cuts, axis=1), levels)

    def path(self, at: int) -> list[dict]:
        """From one bottom node to the root: the kept state, and the siblings left and right of it."""
        out = []
        for level, kept in enumerate(self.states):
            parent, slot = divmod(at, self.fanout)
            first, last = parent * self.fanout, min((parent + 1) * self.fanout, self.heights[level])
            own = self.digests[level]
            out.append({"state": S.raw(kept[:, parent : parent + 1, slot]), "left": S.raw(own[:, first:at]), "right": S.raw(own[:, at + 1 : last])})
            at = parent
        return out


def paths_down(bands: list[DataFrame], above: DataFrame, form: Shape) -> DataFrame:
    """For every bottom subtree its levels and the path from its root to the top: tree, pos, root of the tree, steps.

    ``above``: tree, root, steps from the tree's root upwards.
    """
    schema = f"tree string, pos long, subroot binary, steps {STEPS}"
    known = ["tree", "pos", "digests", "states", "subroot", "steps"]
    lower = None
    for number in range(len(bands) - 1, -1, -1):
        band = bands[number]
        full = band.where("total = 1").join(above, "tree").select(known)
        if lower is not None:
            full = full.unionByName(band.where("total > 1").join(lower, ["tree", "pos"]).select(known))
        if number == 0:
            return full

        def spell(batches: Batches) -> Batches:
            for batch in batches:
                for row in batch.to_pylist():
                    tree = Subtree.read(form, row["digests"], row["states"])
                    for at in range(0, tree.heights[0], 256):
                        some = range(at, min(at + 256, tree.heights[0]))
                        yield pa.RecordBatch.from_pylist([
                            {"tree": row["tree"], "pos": row["pos"] * form.span + i, "subroot": row["subroot"], "steps": tree.path(i) + row["steps"]}
                            for i in some
                        ], PATHS)

        lower = store(map_batches(full, spell, schema), "merkle-paths")
    raise ValueError("no bands")


def resumed(state: np.ndarray, node: np.ndarray, right: list[tuple[np.ndarray | slice, np.ndarray]], size: np.ndarray) -> np.ndarray:
    """The parent's digest from the state before a slot, the node in it and its right siblings.

    ``right``: which columns have one more sibling, and its block; ``size``: children of the parent of each column.
    """
    state = S.absorb(state, S.hex_block(node))
    for who, block in right:
        state[:, who] = S.absorb(state[:, who], block)
    for n in np.unique(size):
        who = size == n
        state[:, who] = S.absorb(state[:, who], S.ending(int(n)))
    return state


class Proofs:
    """Running hashes of each column's siblings."""

    def __init__(self, n: int):
        self.state, self.blocks = np.repeat(S.START, n, axis=1), np.zeros(n, np.int64)

    def add(self, who: np.ndarray | slice, block: np.ndarray) -> None:
        self.state[:, who] = S.absorb(self.state[:, who], block)
        self.blocks[who] += 1

    def digests(self) -> np.ndarray:
        out = np.empty_like(self.state)
        for n in np.unique(self.blocks):
            who = self.blocks == n
            out[:, who] = S.absorb(self.state[:, who], S.ending(int(n)))
        return out


def fold(tree: Subtree, steps: list[dict], at: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots that follow if the bottom nodes ``at`` are ``nodes``, each alone, and digests over all their siblings."""
    proofs = Proofs(len(at))
    for level, kept in enumerate(tree.states):
        parent, slot = np.divmod(at, tree.fanout)
        blocks = S.hex_block(tree.digests[level])
        size = np.minimum(tree.heights[level] - parent * tree.fanout, tree.fanout)
        right = []
        for child in range(tree.fanout):
            who = np.flatnonzero((child != slot) & (child < size))
            if len(who):
                proofs.add(who, blocks[:, parent[who] * tree.fanout + child])
            who = np.flatnonzero((child > slot) & (child < size))
            if len(who):
                right.append((who, blocks[:, parent[who] * tree.fanout + child]))
        nodes = resumed(kept[:, parent, slot], nodes, right, size)
        at = parent
    for step in steps:  # the same for all rows of the subtree
        left, right = (S.hex_block(S.words(step[side])) for side in ("left", "right"))
        for block in (*left.T, *right.T):
            proofs.add(slice(None), block[:, None])
        size = np.full(len(at), left.shape[1] + 1 + right.shape[1])
        state = np.repeat(S.words(step["state"]), len(at), axis=1)
        nodes = resumed(state, nodes, [(slice(None), block[:, None]) for block in right.T], size)
    return nodes, proofs.digests()


class Manifest(NamedTuple):
    """Stored bands of the trees of each group and of the tree over their roots; ``root`` is None for an empty table."""

    form: Shape
    leaves: DataFrame
    bands: list[DataFrame]
    top: list[DataFrame]
    root: bytes | None


def manifest(leaves: DataFrame, *order: str, fanout: int = FANOUT) -> Manifest:
    """``leaves``: tree, digest, and the columns ``order`` that say how leaves follow each other in a tree; more may follow."""
    form = shape(fanout)
    leaves = store(placed(leaves, *order), "merkle-leaves")
    bands = grow(leaves, form)
    heads = tops(bands).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    heads = store(placed(heads, "name"), "merkle-heads")
    top = grow(heads, form)
    root = tops(top).first()
    return Manifest(form, leaves, bands, [heads, *top], bytes(root["root"]) if root else None)


def folded(own: Manifest, keep: str) -> DataFrame:
    """For each leaf ``keep``, its digest, its tree's root, the digest over its siblings and the root that its ``replaced`` digest gives."""
    form, (heads, *top) = own.form, own.top
    nothing = F.array().cast(STEPS)
    start = tops(top).select("tree", F.col("root").alias("subroot"), nothing.alias("steps"))

    def head_paths(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                tree = Subtree.read(form, row["digests"], row["states"])
                for i in range(tree.heights[0]):
                    yield pa.RecordBatch.from_pylist(
                        [{"pos": row["pos"] * form.span + i, "steps": tree.path(i) + row["steps"]}], HEAD_PATHS
                    )

    found = map_batches(paths_down(top, start, form), head_paths, f"pos long, steps {STEPS}")
    above = store(heads.join(found, "pos").select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "steps"), "merkle-above")
    subtrees = paths_down(own.bands, above, form)

    def check(rows: pa.Table, around: pa.Table) -> pa.Table:
        info = around.slice(0, 1).to_pylist()[0]
        at = rows["pos"].to_numpy() % form.span
        nodes = S.words(b"".join(rows["replaced"].to_pylist()))
        roots, proofs = fold(Subtree.read(form, info["digests"], info["states"]), info["steps"], at, nodes)
        cut = lambda raw: [raw[i : i + 32] for i in range(0, len(raw), 32)]
        return pa.table({
            keep: rows[keep], "digest": rows["digest"], "subroot": [info["subroot"]] * len(at),
            "proof": cut(S.raw(proofs)), "folded": cut(S.raw(roots)),
        })

    left = own.leaves.withColumn("_subtree", F.floor(F.col("pos") / form.span)).groupBy("tree", "_subtree")
    kind = own.leaves.schema[keep].dataType.simpleString()
    return left.cogroup(subtrees.groupBy("tree", "pos")).applyInArrow(
        check, f"`{keep}` {kind}, digest binary, subroot binary, proof binary, folded binary"
    )


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    return verify(table(spark, sf_dir, "documents"))


def verify(docs: DataFrame) -> DataFrame:
    """A manifest of documents by language, with every seventh id's row tampered with and folded again."""
    by = [F.col(c) for c in COLUMNS]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    changed = leaf(*[F.col(c).cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in COLUMNS])
    leaves = docs.select(
        "doc_id", tree_key(F.col("lang")).alias("tree"), leaf(*by).alias("digest"), F.when(hit, changed).otherwise(leaf(*by)).alias("replaced")
    )
    own = manifest(leaves, "doc_id", "digest")
    text = lambda name: F.lower(F.hex(name))
    if own.root is None:
        return leaves.select("doc_id", *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(True).alias("verified")).where("false")
    root = F.lit(own.root.hex())
    return folded(own, "doc_id").select(
        "doc_id", text("digest").alias("leaf"), text("subroot").alias("subroot"), root.alias("root"), text("proof").alias("proof_sha256"),
        text("folded").alias("folded_root"), (text("folded") == root).alias("verified"),
    )
