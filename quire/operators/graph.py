"""Content-addressed graphs: hashes, nodes and edges that deduplicate across documents, and walks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.sheets import order_key
from quire.runtime import materialize


def canonical_json(fields: dict[str, Column]) -> Column:
    """A JSON object with keys in sorted order; fields that are null are left out."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))


def content_hash(fields: dict[str, Column]) -> Column:
    """SHA-256, in hex, of the canonical JSON of a value."""
    return F.sha2(canonical_json(fields).cast("binary"), 256)


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the smallest in an order. Rows are reduced before the shuffle."""
    others = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.min(order).alias(order), *(F.min_by(c, order).alias(c) for c in others)).select(*df.columns)


def containment(children: DataFrame, parent: str, child: str, ordinal: str, kind: str = "CONTAINS") -> DataFrame:
    """Edges (from_id, to_id, kind, order_key) of a parent-child table, each once."""
    rows = children.select(F.col(parent).alias("from_id"), F.col(child).alias("to_id"), F.lit(kind).alias("kind"), order_key(F.col(ordinal)).alias("order_key"))
    return rows.distinct()


def merkle_ids(leaves: DataFrame, levels: Sequence[str], own: str) -> list[DataFrame]:
    """Content ids bottom-up: (group columns, id) of each level, the innermost first.

    An inner node's id is the hash of its children's ids in order, so equal subtrees have equal
    ids in every document. A node's children are gathered as ids, 64 characters each.
    """
    out, rows = [], leaves.select(*levels, F.col(own).alias("id"), F.col(own).alias("ord"))
    for n in range(len(levels), 0, -1):
        keys = list(levels[:n])
        kids = F.transform(F.sort_array(F.collect_list(F.struct("ord", "id"))), lambda s: s["id"])
        made = rows.groupBy(*keys).agg(F.sha2(F.array_join(kids, ",").cast("binary"), 256).alias("id"))
        out.append(made)
        rows = made.select(*keys[:-1], "id", F.col(keys[-1]).cast("string").alias("ord"))
    return out


def walk(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """Every path from the roots (node): (root, node, depth, path, keys), nodes in order of keys under a root.

    A node that is reached again by another path is visited again; a path never enters a node
    that is already on it, so walks end. Levels are joined one after the other, each written before the next.
    With a depth, paths of more steps are left out.
    """
    level = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"), F.array("node").alias("path"), F.array().cast("array<string>").alias("keys"))
    steps = edges.select(F.col("from_id").alias("node"), "to_id", "order_key")
    out = level
    n = 0
    while depth is None or n < depth:
        n += 1
        grown = level.join(steps, "node").where(~F.array_contains("path", F.col("to_id")))
        level = materialize(grown.select("root", F.col("to_id").alias("node"), F.lit(n).alias("depth"), F.concat("path", F.array("to_id")).alias("path"), F.concat("keys", F.array("order_key")).alias("keys")))
        if not level.limit(1).count():
            break
        out = out.unionByName(level)
    return out
