"""A Merkle manifest of a dataset, kept as blocks in van Emde Boas layout.

Leaves are digests of rows. Within a group they stand in order, and every two consecutive nodes
of a level become one until one is left; the groups' roots are joined in the same way. The tree
is cut into aligned subtrees of BLOCK_BITS levels. A block is one row of a table: its digests lie
in van Emde Boas order (a tree of so many levels is its upper half, then the subtrees of its
lower half, each laid out alike), so that a way from leaf to root touches few places, and a
node's place follows from its depth and index by arithmetic. The roots of a storey of blocks
are the leaves of the next, so a table of any size is built in as many rounds as its logarithm
to base 2^BLOCK_BITS, and a proof is put together from the blocks above a leaf.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.runtime import broadcast_if_small, materialize

#: Levels of hashing in a block: 1,024 leaves, 64 KB.
BLOCK_BITS = 10
#: Fields of a document's leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_DIGEST = 32


def joined(*nodes: bytes) -> bytes:
    """The digest of digests, taken as lower-case hex text."""
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places in van Emde Boas order of the nodes at a depth (0: root) of a tree of so many levels."""
    place, index = np.zeros_like(index), index.copy()
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        depth -= upper
        levels -= upper
        place += (1 << upper) - 1 + (index >> depth) * ((1 << levels) - 1)
        index &= (1 << depth) - 1
    return place


@lru_cache(maxsize=256)
def _places(height: int, level: int) -> np.ndarray:
    """Places of all nodes so many levels above the leaves of a tree of that height."""
    return address(height + 1, height - level, np.arange(1 << (height - level), dtype=np.int64))


def lay(leaves: list[bytes], height: int) -> bytes:
    """The block over at most 2^height leaves; places without a node are zero."""
    store = np.zeros((2 << height) - 1, dtype=f"V{_DIGEST}")
    level = leaves
    for up in range(height + 1):
        store[_places(height, up)[: len(level)]] = np.frombuffer(b"".join(level), f"V{_DIGEST}")
        if up < height:
            level = [joined(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return store.tobytes()


def siblings(block: bytes, height: int, width: int, index: int) -> tuple[list[bytes], str]:
    """A leaf's siblings in a block with so many leaves, from below, and their sides: L, R, or - where there is none."""
    found, sides = [], ""
    for up in range(height):
        other = (index >> up) ^ 1
        if other < -(-width >> up):
            at = int(_places(height, up)[other]) * _DIGEST
            found.append(block[at : at + _DIGEST])
            sides += "L" if other < index >> up else "R"
        else:
            sides += "-"
    return found, sides


def fold(leaf: bytes, way: list[bytes], sides: str) -> bytes:
    """The root that follows from a leaf, its siblings and their sides."""
    rest = iter(way)
    for side in sides:
        leaf = joined(next(rest), leaf) if side == "L" else joined(leaf, next(rest)) if side == "R" else joined(leaf)
    return leaf


class Tree(NamedTuple):
    """nodes: (g, pos, n, node, ...) of each storey; blocks: (g, block, n, height, width, layout); tops: (g, node) of each group."""

    nodes: list[DataFrame]
    blocks: list[DataFrame]
    tops: DataFrame


def leaf_digest(columns: list[Column]) -> Column:
    """Lower-case hex SHA-256 of fields, each its byte count, a colon and its text, or - where null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)).cast("binary"), 256)


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with pos, the place in its group by that order from 0, and n, the rows of its group.

    Rows are dealt by range and sorted, and each range counts its own rows; only the counts of a
    group's ranges meet in one task.
    """
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    lined = materialize(dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    counts = lined.groupBy(group, "part").agg(F.count("*").alias("held"), F.min("at").alias("first"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("held").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(counts.select(group, "part", (F.col("first") - before).alias("shift"), F.sum("held").over(whole).alias("n")))
    return lined.join(broadcast_if_small(starts), [group, "part"]).select(*rows.columns, (F.col("at") - F.col("shift")).alias("pos"), "n")


def build(nodes: DataFrame, bits: int = BLOCK_BITS) -> Tree:
    """The tree of each group g of nodes (g, pos, n, node), storey by storey."""

    def lay_block(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        width, n = len(rows), rows["n"][0].as_py()
        height = bits if n > 1 << bits else (width - 1).bit_length()
        layout = lay(rows["node"].to_pylist(), height)
        return pa.table({"g": [rows["g"][0].as_py()], "block": pa.array([rows["block"][0].as_py()], pa.int64()), "n": pa.array([n], pa.int64()), "height": pa.array([height], pa.int32()), "width": pa.array([width], pa.int32()), "layout": pa.array([layout], pa.binary())})

    storeys, blocks, tops = [nodes], [], None
    while True:
        keyed = storeys[-1].select("g", F.shiftright("pos", bits).alias("block"), "pos", "n", "node")
        laid = materialize(keyed.groupBy("g", "block").applyInArrow(lay_block, "g string, block long, n long, height int, width int, layout binary"))
        roots = laid.select("g", F.col("block").alias("pos"), "n", F.substring("layout", 1, _DIGEST).alias("node"))
        blocks.append(laid)
        done = roots.where(F.col("n") <= 1 << bits).select("g", "node")
        tops = done if tops is None else tops.union(done)
        onward = materialize(roots.where(F.col("n") > 1 << bits).withColumn("n", F.ceil(F.col("n") / (1 << bits)).cast("long")))
        if not onward.count():
            return Tree(storeys, blocks, materialize(tops))
        storeys.append(onward)


def ways_above(tree: Tree, upper: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """(g, block, way, sides): siblings above each block of the lowest storey; upper is (g, way, sides) above each group."""

    def down(key: tuple, rows: pa.Table, block: pa.Table) -> pa.Table:
        layout, height, width, way, sides = (block[c][0].as_py() for c in ("layout", "height", "width", "way", "sides"))
        places = rows["pos"].to_pylist()
        found = [siblings(layout, height, width, pos & ((1 << bits) - 1)) for pos in places]
        return pa.table({"g": rows["g"], "block": pa.array(places, pa.int64()), "way": pa.array([b"".join(w) + way for w, _ in found], pa.binary()), "sides": pa.array([s + sides for _, s in found], pa.string())})

    known = None
    for storey in reversed(range(len(tree.blocks))):
        blocks = tree.blocks[storey]
        top = blocks.where(F.col("n") <= 1 << bits).select("g", "block").join(upper, "g")
        known = materialize(top if known is None else top.unionByName(known))
        if storey:
            rows = tree.nodes[storey].select("g", F.shiftright("pos", bits).alias("block"), "pos")
            held = blocks.join(known, ["g", "block"])
            known = rows.groupBy("g", "block").cogroup(held.groupBy("g", "block")).applyInArrow(down, "g string, block long, way binary, sides string")
    return known


def manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, claimed: dict[str, Column] | None = None, bits: int = BLOCK_BITS) -> DataFrame:
    """Leaf, roots and checked proof of every row: (order, leaf, subroot, root, proof_sha256, folded_root, verified).

    claimed replaces fields as a holder of the row claims them; folded_root is what the claimed
    leaf gives with the manifest's own siblings, and verified whether that is root. Null groups
    come first, the others by their UTF-8 bytes. A null in order comes first, and rows that tie
    stand by their leaves, so repeated rows change places without effect. Null fields are leaves
    of their own, unlike empty ones. An empty table gives no rows.
    """
    claimed = claimed or {}
    columns = [F.col(c) for c in fields]
    claims = [claimed.get(c, F.col(c)) for c in fields]
    same = F.lit(True)
    for c in claimed:
        same = same & claimed[c].eqNullSafe(F.col(c))
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"),
        F.col(order).cast("long").alias("id"),
        F.unhex(leaf_digest(columns)).alias("node"),
        F.when(~same, F.unhex(leaf_digest(claims))).alias("claim"),
    )
    leaves = ranked(materialize(rows), "g", ["id", "node"])
    tree = build(leaves, bits)
    joint = build(ranked(tree.tops.select(F.lit("").alias("g"), F.col("g").alias("name"), "node"), "g", ["name"]), bits)
    none = joint.tops.select("g", F.lit(b"").alias("way"), F.lit("").alias("sides"))
    upper = _proved(joint, ways_above(joint, none, bits), bits)
    above = ways_above(tree, upper, bits)
    held = tree.blocks[0].join(above, ["g", "block"]).join(tree.tops.withColumnRenamed("node", "subroot"), "g")
    root = next((bytes(r.node) for r in joint.tops.collect()), b"")  # one row

    def check(key: tuple, rows: pa.Table, block: pa.Table) -> pa.Table:
        layout, height, width, way, sides, subroot = (block[c][0].as_py() for c in ("layout", "height", "width", "way", "sides", "subroot"))
        above = [way[i : i + _DIGEST] for i in range(0, len(way), _DIGEST)]
        proofs, folded = [], []
        for pos, node, claim in zip(rows["pos"].to_pylist(), rows["node"].to_pylist(), rows["claim"].to_pylist()):
            found, inside = siblings(layout, height, width, pos & ((1 << bits) - 1))
            proofs.append(joined(*found, *above).hex())
            folded.append(fold(claim or node, found + above, inside + sides))
        n = len(proofs)
        return pa.table({"id": rows["id"], "leaf": [x.hex() for x in rows["node"].to_pylist()], "subroot": [subroot.hex()] * n, "root": [root.hex()] * n, "proof_sha256": proofs, "folded_root": [x.hex() for x in folded], "verified": [x == root for x in folded]})

    lowest = leaves.select("g", F.shiftright("pos", bits).alias("block"), "pos", "id", "node", "claim")
    done = lowest.groupBy("g", "block").cogroup(held.groupBy("g", "block")).applyInArrow(check, "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return done.withColumnRenamed("id", order)


def _proved(joint: Tree, above: DataFrame, bits: int) -> DataFrame:
    """(g, way, sides) of each group's root in the joint tree."""

    def down(key: tuple, rows: pa.Table, block: pa.Table) -> pa.Table:
        layout, height, width, way, sides = (block[c][0].as_py() for c in ("layout", "height", "width", "way", "sides"))
        found = [siblings(layout, height, width, pos & ((1 << bits) - 1)) for pos in rows["pos"].to_pylist()]
        return pa.table({"g": rows["name"], "way": pa.array([b"".join(w) + way for w, _ in found], pa.binary()), "sides": pa.array([s + sides for _, s in found], pa.string())})

    rows = joint.nodes[0].select("g", F.shiftright("pos", bits).alias("block"), "pos", "name")
    held = joint.blocks[0].join(above, ["g", "block"])
    return materialize(rows.groupBy("g", "block").cogroup(held.groupBy("g", "block")).applyInArrow(down, "g string, way binary, sides string"))
