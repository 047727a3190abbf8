"""A Merkle manifest of a table: a digest for each row, a tree for each group of rows, and a proof for every row.

The leaves of a tree are cut into aligned blocks of 4096. A task walks the tree over a block in postorder: a call returns
the digest of its subtree and, while it unwinds, appends the digest of each half to the paths of all leaves in the
other half. The roots of the blocks are the nodes of the next, 4096 times smaller traversal, until every tree has one
node; paths are then joined downwards, block by block. No task holds more than a block, and no tree is held whole.

Digests are lowercase hex SHA-256 of their inputs put together, digests among the inputs as hex text. Every two
consecutive nodes become one; a last node without a partner becomes the digest of itself alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trivane.llm.workspace import materialise, ship
from trivane.operators.ranking import ranked

#: Levels of the tree that are walked within a block.
HEIGHT = 12
#: The columns of a row that make its leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def part(value: Column) -> Column:
    """A value as input of a leaf: ``-`` for null, else its UTF-8 bytes, a colon and the value; integers in decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(part, values)), 256)


def walked(digests: list[bytes], height: int) -> tuple[bytes, list[list[bytes]]]:
    """(root, path of each leaf) of the tree of 2**height places over the digests, of which there is one at least.

    A path has a step for each level, upwards: empty where a node has no sibling, else the sibling's digest after a byte
    that is 1 if the sibling stands on the left.
    """
    paths: list[list[bytes]] = [[] for _ in digests]

    def subtree(at: int, height: int) -> bytes:
        if height == 0:
            return digests[at]
        half = 1 << (height - 1)
        middle, end = at + half, min(at + 2 * half, len(digests))
        left = subtree(at, height - 1)
        if middle >= end:
            for path in paths[at:end]:
                path.append(b"")
            return sha256(left.hex().encode()).digest()
        right = subtree(middle, height - 1)
        for path in paths[at:middle]:
            path.append(b"\0" + right)
        for path in paths[middle:end]:
            path.append(b"\1" + left)
        return sha256((left.hex() + right.hex()).encode()).digest()

    return subtree(0, height), paths


def _block(table: pa.Table, height: int) -> pa.Table:
    """The nodes of one block, with their path inside it and, beside its first node, the block's root."""
    table = table.take(pa.array(np.argsort(table["slot"].to_numpy())))
    size = table["size"][0].as_py()
    root, paths = walked(table["digest"].to_pylist(), min(height, (size - 1).bit_length()))
    roots = pa.array([root] + [None] * (len(paths) - 1), pa.binary())
    return table.append_column("path", pa.array(paths, pa.list_(pa.binary()))).append_column("root", roots)


def forest(nodes: DataFrame, kept: Sequence[str] = (), height: int = HEIGHT) -> DataFrame:
    """(tree, slot, root, path) and the columns ``kept`` of all nodes (tree, slot, size, digest): slots from 0 to size - 1
    in each tree.

    ``tree`` is a text, not null. A tree of one node is its own root, with an empty path. Each traversal is written.
    """
    ship(nodes.sparkSession)
    levels = []
    while True:
        own = kept if not levels else ()
        held = nodes.select("tree", "slot", "size", "digest", *own)
        made = T.StructType([*held.schema.fields, T.StructField("path", T.ArrayType(T.BinaryType())), T.StructField("root", T.BinaryType())])
        levels.append(materialise(held.groupBy("tree", F.shiftright("slot", height)).applyInArrow(lambda block: _block(block, height), made), "walked"))
        if levels[-1].filter(F.col("size") > 1 << height).isEmpty():
            break
        above = F.shiftright(F.col("size") - 1, height) + 1
        nodes = levels[-1].filter("root is not null").select("tree", F.shiftright("slot", height).alias("slot"), above.alias("size"), F.col("root").alias("digest"))
    tops = levels[-1].filter("root is not null").select("tree", "root")
    own = kept if len(levels) == 1 else ()
    out = levels.pop().drop("root").join(tops, "tree").select("tree", "slot", "root", "path", *own)
    while levels:
        own = kept if len(levels) == 1 else ()
        upper = out.select("tree", F.col("slot").alias("_block"), "root", F.col("path").alias("_upper"))
        lower = levels.pop().drop("root").withColumn("_block", F.shiftright("slot", height))
        out = lower.join(upper, ["tree", "_block"]).select("tree", "slot", "root", F.concat("path", "_upper").alias("path"), *own)
    return out


def _slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``slot`` and ``size`` within each ``tree``: written, so that Spark knows that the trees are few if they are."""
    placed = materialise(ranked(rows, [F.col(c) for c in ("tree", *order)], rank="_rank"), "placed")
    trees = materialise(placed.groupBy("tree").agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("size")), "trees")
    return placed.join(trees, "tree").withColumn("slot", F.col("_rank") - F.col("_first")).drop("_rank", "_first")


def manifest(docs: DataFrame, group: str = "lang", tampered: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """A row for each row of ``docs``: doc_id, slot, leaf, other, subroot, root and path.

    Rows of one value of ``group`` are a tree, in the order of doc_id (null first), equal ids in that of their leaves; the
    subroots, in the order of the group (null first, then bytewise), are the leaves of the tree that gives the
    root. ``path`` is that of the leaf up to the root, as ``walked`` gives it. ``other`` is the leaf with the columns
    of ``tampered`` in place of the row's own. Nulls in any column are part of the leaf, as is an empty or very long text;
    equal rows are leaves of their own. Further columns of ``docs`` are left out; an empty table gives none.
    Texts are read once and not shuffled; what goes on is a row of two digests for each document.
    """
    changed = [(tampered or {}).get(c, F.col(c)) for c in FIELDS]
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree")
    rows = docs.select("doc_id", tree, leaf([F.col(c) for c in FIELDS]).alias("leaf"), leaf(changed).alias("other"))
    # equal rows are told apart by a number, so that a row which repeats very often does not fall to one task
    rows = materialise(rows.withColumn("_copy", F.monotonically_increasing_id()), "leaves")
    nodes = _slots(rows, ["doc_id", "leaf", "_copy"]).withColumn("digest", F.unhex("leaf"))
    leaves = forest(nodes, ["doc_id", "leaf", "other"], height)

    subroots = materialise(leaves.filter("slot = 0").select("tree", "root"), "subroots")
    top = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("_group"), F.col("root").alias("digest"))
    above = materialise(forest(_slots(top, ["_group"]), ["_group"], height), "above")
    above = above.select(F.col("_group").alias("tree"), F.col("root").alias("_root"), F.col("path").alias("_above"))
    hexed = lambda c: F.lower(F.hex(c))
    out = leaves.join(above, "tree")
    return out.select("doc_id", "slot", "leaf", "other", hexed("root").alias("subroot"), hexed("_root").alias("root"), F.concat("path", "_above").alias("path"))


def siblings(path: Column) -> Column:
    """The digests of a path, in hex, from the leaf to the root."""
    return F.transform(F.filter(path, lambda step: F.octet_length(step) > 0), lambda step: F.lower(F.hex(F.substring(step, 2, 32))))


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and a path lead to."""

    def up(held: Column, step: Column) -> Column:
        sibling = F.lower(F.hex(F.substring(step, 2, 32)))
        both = F.when(F.substring(step, 1, 1) == F.lit(b"\1"), F.concat(sibling, held)).otherwise(F.concat(held, sibling))
        return F.sha2(F.when(F.octet_length(step) == 0, held).otherwise(both), 256)

    return F.aggregate(path, digest, up)


def digest(rows: DataFrame) -> DataFrame:
    """What a manifest's rows prove: the digest of the siblings, and the root that the other leaf leads to."""
    proof = F.sha2(F.array_join(siblings(F.col("path")), ""), 256)
    out = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.col("other"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
