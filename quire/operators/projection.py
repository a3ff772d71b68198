"""Trees of any depth as a content-addressed graph, with a choice of which nodes are shared and which stay inline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.factoring import with_chains
from quire.runtime import materialize


def canonical_text(json: Column) -> Column:
    """JSON text in canonical form: keys of all objects in order of their UTF-16 code units, no spaces, arrays as they are.

    Text that is not JSON, or that repeats a key in an object, is refused.
    """
    return F.to_json(F.parse_json(json))


def canonical_hash(json: Column) -> Column:
    """SHA-256, in hex, of the canonical form: equal for values written in different orders."""
    return F.sha2(canonical_text(json).cast("binary"), 256)


def project(nodes: DataFrame, shared: Column, doc: str = "doc", key: str = "node", parent: str = "parent", place: str = "place", kind: str = "kind", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Graph of a forest of nodes (doc, node, parent, place, kind, content JSON): (id, kind, face) and (from_id, to_id, path).

    A node's face is the JSON of its children in order of place, its content in canonical form, and its kind; its id
    is the hash of the face, so equal subtrees are one node in all documents. Children that are
    shared stand in the face by their id, others as their own face. Roots are shared. An edge
    goes from a shared node to each shared node that is reached through inline ones only, path
    being the places on the way. Levels are done from the deepest up, all documents at once.
    """
    levels, none = _levels(nodes, shared, doc, key, parent, place, kind, content)
    return _faces(levels, none), _links(levels, none)


def shared_nodes(nodes: DataFrame, shared: Column, doc: str = "doc", key: str = "node", parent: str = "parent", place: str = "place", kind: str = "kind", content: str = "content") -> DataFrame:
    """The first table of project() alone."""
    return _faces(*_levels(nodes, shared, doc, key, parent, place, kind, content))


def shared_edges(nodes: DataFrame, shared: Column, doc: str = "doc", key: str = "node", parent: str = "parent", place: str = "place", kind: str = "kind", content: str = "content") -> DataFrame:
    """The second table of project() alone."""
    return _links(*_levels(nodes, shared, doc, key, parent, place, kind, content))


def _levels(nodes: DataFrame, shared: Column, doc: str, key: str, parent: str, place: str, kind: str, content: str) -> tuple[list[DataFrame], DataFrame]:
    """Nodes (d, k, up, place, kind, shared, face, id, token) of each level, the deepest first; and the nodes, none of them."""
    body = F.coalesce(canonical_text(F.col(content)), F.lit("null"))
    own = nodes.select(F.col(doc).alias("d"), F.col(key).alias("k"), F.col(parent).alias("above"), F.col(place).cast("long").alias("place"), F.col(kind).alias("kind"), body.alias("content"), shared.alias("shared"))
    tree = with_chains(own, "d", "k", "above")
    placed = tree.withColumns({"depth": F.size("chain"), "up": F.get("chain", F.size("chain") - 2)}).drop("above", "chain")
    rows = placed.withColumn("shared", F.coalesce("shared", F.lit(False)) | F.col("up").isNull())
    depth = rows.agg(F.max("depth")).first()[0] or 0
    levels: list[DataFrame] = []
    for level in range(depth, 0, -1):
        at = rows.where(F.col("depth") == level)
        if levels:
            tokens = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "k", "token"))), lambda c: c["token"]), ",")
            at = at.join(levels[-1].groupBy("d", F.col("up").alias("k")).agg(tokens.alias("tokens")), ["d", "k"], "left")
        else:
            at = at.withColumn("tokens", F.lit(None).cast("string"))
        face = F.concat(F.lit('{"children":['), F.coalesce("tokens", F.lit("")), F.lit('],"content":'), "content", F.lit(',"kind":'), F.to_json(F.struct(F.col("kind").alias("k"))), F.lit("}"))
        named = at.withColumn("face", F.regexp_replace(face, r'"kind":\{"k":(.*)\}\}$', '"kind":$1}')).withColumn("id", F.sha2(F.col("face").cast("binary"), 256))
        token = F.when(F.col("shared"), F.concat(F.lit('{"ref":"'), "id", F.lit('"}'))).otherwise(F.col("face"))
        levels.append(materialize(named.select("d", "k", "up", "place", "kind", "shared", "face", "id", token.alias("token"))))
    return levels, rows.where("false")


def _faces(levels: list[DataFrame], none: DataFrame) -> DataFrame:
    faces = none.select(F.lit("").alias("id"), "kind", F.lit("").alias("face"))
    for done in levels:
        faces = faces.union(done.where("shared").select("id", "kind", "face"))
    return faces.groupBy("id").agg(F.first("kind").alias("kind"), F.first("face").alias("face"))


def _links(levels: list[DataFrame], none: DataFrame) -> DataFrame:
    edges = none.select(F.lit("").alias("from_id"), F.lit("").alias("to_id"), F.array("place").alias("path"))
    ways = None
    for done in levels:
        # a way is a shared node that is still looking for the shared node above it
        onward = None
        if ways is not None:
            arrived = ways.join(done.select("d", "k", F.col("shared").alias("_s"), F.col("id").alias("_id"), "up", "place"), ["d", "k"])
            edges = edges.union(arrived.where("_s").select(F.col("_id").alias("from_id"), "to_id", "path"))
            onward = arrived.where("NOT _s").select("d", F.col("up").alias("k"), "to_id", F.concat(F.array("place"), "path").alias("path"))
        started = done.where("shared AND up IS NOT NULL").select("d", F.col("up").alias("k"), F.col("id").alias("to_id"), F.array("place").alias("path"))
        ways = materialize(started if onward is None else started.union(onward)) if done is not levels[-1] else None
    return edges.distinct()
