"""Merkle manifest of a dataset with a proof for every row (operator 13).

Rows are leaves, three consecutive nodes make a parent, and every source has a
tree of its own below the tree of sources. A tree is cut into aligned blocks
of 3**LEVELS leaves. Within a block, treehash stacks run ahead of the leaf at
hand and have the next run of siblings ready on each level when it is reached,
so a block's proofs come leaf by leaf while a few nodes of each level are held.
The roots of blocks are the leaves of the next stage, treated alike, until one
root is left; what lies above a block is shared by its leaves and appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import positions
from .storage import Scratch, staged

ARITY = 3
#: Levels of a block; its 729 leaves are what one call holds, as digests.
LEVELS = 6
PATH = "path array<binary>"


def digest(*parts: bytes) -> bytes:
    """Lowercase hex SHA-256 of the parts one after another."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def height(leaves: int, most: int) -> int:
    """Levels above `leaves` nodes until one remains, `most` if that is fewer."""
    level = 0
    while level < most and ARITY**level < leaves:
        level += 1
    return level


class TreeHash:
    """The digest of one node from its leaves in order; of each level below, at most two nodes wait."""

    def __init__(self, level: int):
        self.waiting: list[list[bytes]] = [[] for _ in range(level)]
        self.done: bytes | None = None

    def push(self, node: bytes) -> None:
        for nodes in self.waiting:
            nodes.append(node)
            if len(nodes) < ARITY:
                return
            node = digest(*nodes)
            nodes.clear()
        self.done = node

    def finish(self) -> bytes:
        """The digest; where leaves have ended early, runs are shorter."""
        node = self.done
        if node is None:
            for nodes in self.waiting:
                if node is not None:
                    nodes.append(node)
                if nodes:
                    node = digest(*nodes)
        return node


class Runs:
    """Runs of siblings on one level, made from the leaves fed one at a time."""

    def __init__(self, level: int, leaves: list[bytes]):
        self.level, self.leaves, self.fed = level, leaves, 0
        self.nodes: list[bytes] = []
        self.tree = TreeHash(level)

    def feed(self) -> None:
        if self.fed == len(self.leaves):
            return
        self.tree.push(self.leaves[self.fed])
        self.fed += 1
        if self.fed % ARITY**self.level == 0 or self.fed == len(self.leaves):
            self.nodes.append(self.tree.finish())
            self.tree = TreeHash(self.level)

    def take(self) -> list[bytes]:
        """The run that is ready; the next one begins."""
        nodes, self.nodes = self.nodes, []
        return nodes


def block_root(leaves: list[bytes], levels: int) -> bytes:
    tree = TreeHash(levels)
    for leaf in leaves:
        tree.push(leaf)
    return tree.finish()


def proofs(leaves: list[bytes], levels: int) -> Iterator[list[bytes]]:
    """For each leaf of a block, its siblings from below: on each level those before it, joined, and those after it.

    Each level's stack takes one leaf a step. A run on level h lasts 3**(h+1)
    steps, which is as many leaves as the next run has, so that is ready in time.
    """
    ahead = [Runs(level, leaves) for level in range(levels)]
    current: list[list[bytes]] = []
    for level, runs in enumerate(ahead):
        for _ in range(ARITY ** (level + 1)):
            runs.feed()
        current.append(runs.take())
    path = [b""] * (2 * levels)
    for i in range(len(leaves)):
        for level, runs in enumerate(ahead):
            width = ARITY**level
            if i % width:
                break
            if i and i % (ARITY * width) == 0:
                current[level] = runs.take()
            k = i // width % ARITY
            path[2 * level], path[2 * level + 1] = b"".join(current[level][:k]), b"".join(current[level][k + 1 :])
        yield path
        for runs in ahead:
            runs.feed()


def fold(leaf: bytes, path: list[bytes]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for before, after in zip(path[::2], path[1::2], strict=True):
        leaf = digest(before, leaf, after)
    return leaf


# --- stages ---------------------------------------------------------------------------


def _leaves(nodes: pa.Table, most: int) -> tuple[pa.Table, list[bytes], int]:
    """A block's rows in order, their digests as hex, and the levels up to the block's root."""
    nodes = nodes.sort_by("position")
    return nodes, [d.hex().encode() for d in nodes["digest"].to_pylist()], height(nodes["n"][0].as_py(), most)


def _block(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"position div {ARITY**levels}"))


def with_paths(nodes: DataFrame, above: DataFrame, keep: str, block_levels: int) -> DataFrame:
    """`keep` (names and types) of nodes, with path and root: siblings within the block, then what `above` has for it."""
    names = [c.split()[0] for c in keep.split(", ")]

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        left, leaves, levels = _leaves(left, block_levels)
        upper = right["path"][0].as_py()
        paths = [[*path, *upper] for path in proofs(leaves, levels)]
        return pa.table([*(left[c] for c in names), pa.array(paths, pa.list_(pa.binary())), pa.array([right["root"][0].as_py()] * len(leaves), pa.binary())], [*names, "path", "root"])

    keyed = _block(nodes, block_levels)
    return keyed.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(one, f"{keep}, {PATH}, root binary")


def above_blocks(nodes: DataFrame, scratch: Scratch, block_levels: int) -> DataFrame:
    """(tree, block, path, root) for the blocks of `nodes` (tree, position, n, digest): the path from a block's root up to its tree's, as hex."""

    def one(part: pa.Table) -> pa.Table:
        rows, leaves, levels = _leaves(part, block_levels)
        n = -(-rows["n"][0].as_py() // ARITY**block_levels)
        return pa.table([rows["tree"].slice(0, 1), rows["block"].slice(0, 1), pa.array([n], pa.int64()), pa.array([bytes.fromhex(block_root(leaves, levels).decode())], pa.binary())], ["tree", "block", "n", "digest"])

    keyed = _block(nodes.select("tree", "position", "n", "digest"), block_levels)
    roots = scratch.staged(keyed.groupBy("tree", "block").applyInArrow(one, "tree string, block long, n long, digest binary"), "block-roots")
    done = roots.where("n = 1").select("tree", "block", F.array().cast("array<binary>").alias("path"), F.lower(F.hex("digest")).cast("binary").alias("root"))
    rest = roots.where("n > 1").withColumnRenamed("block", "position")
    if rest.isEmpty():
        return done
    upper = with_paths(rest, above_blocks(rest, scratch, block_levels), "tree string, position long", block_levels)
    return scratch.staged(done.unionByName(upper.withColumnRenamed("position", "block")), "upper-paths")


# --- documents ------------------------------------------------------------------------


def leaf_of(*columns):
    """SHA-256 (32 bytes) of the columns: `-` for a null, else the UTF-8 bytes' number, a colon and the value."""
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns)), 256))


def manifest(docs: DataFrame, tampered=None, block_levels: int = LEVELS) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves are made of doc_id, source, lang, n_chars and text; each source's
    ascend by doc_id (null first, ties by leaf) and its root is a leaf of the
    tree of sources, null first, else bytewise. `tampered` is a column of the
    texts that are to be verified against the manifest; where it differs from
    the text, the fold starts from it. Nulls differ from empty texts; repeated
    rows are leaves each; other columns aren't read; texts of any length are
    hashed where they are read and don't travel; an empty table has no rows.
    A block has 3**block_levels leaves.
    """
    spark = docs.sparkSession
    row = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text")
    changed = F.lit(None).cast("binary") if tampered is None else F.when(~tampered.eqNullSafe(text), leaf_of(*row, tampered))
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-"))
    with Scratch(spark) as scratch:
        leaves = scratch.staged(docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(*row, text).alias("digest"), changed.alias("changed")), "leaves")
        nodes = scratch.staged(positions(leaves, "tree", ["doc_id", "digest"], scratch), "placed-leaves")
        above = above_blocks(nodes, scratch, block_levels)
        sources = scratch.staged(above.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.unhex(F.col("root").cast("string")).alias("digest")), "subroots")
        placed = scratch.staged(positions(sources, "tree", ["source"], scratch), "placed-subroots")
        top = with_paths(placed, above_blocks(placed, scratch, block_levels), "source string", block_levels)
        shared = above.withColumnRenamed("root", "subroot").join(top.select(F.col("source").alias("tree"), F.col("path").alias("_top"), "root"), "tree")
        shared = shared.select("tree", "block", F.concat("path", "_top").alias("path"), "subroot", "root")

        def one(left: pa.Table, right: pa.Table) -> pa.Table:
            left, leaves, levels = _leaves(left, block_levels)
            upper, subroot, root = (right[c][0].as_py() for c in ("path", "subroot", "root"))
            text = lambda values: pa.array([v.decode() for v in values], pa.string())
            proof, folded = [], []
            for leaf, changed, path in zip(leaves, left["changed"].to_pylist(), proofs(leaves, levels), strict=True):
                whole = [*path, *upper]
                proof.append(digest(*whole))
                folded.append(fold(leaf if changed is None else changed.hex().encode(), whole))
            n = len(leaves)
            columns = [left["doc_id"], text(leaves), text([subroot] * n), text([root] * n), text(proof), text(folded), pa.array([f == root for f in folded])]
            return pa.table(columns, ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

        done = _block(nodes, block_levels).groupBy("tree", "block").cogroup(shared.groupBy("tree", "block"))
        return staged(done.applyInArrow(one, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"), "manifest")
