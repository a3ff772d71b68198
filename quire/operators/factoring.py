"""Styles factored out of a tree: each wrapper names the tuple that most of the leaves below it share, and back.

Wrappers are settled from the outside in, all those of a depth at once. Leaves are dealt by document
once, and each level is a pass of windows over them, which are sorted and not dealt again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from quire.runtime import discard, materialize

#: Wrappers of a document whose links one task holds at most.
HELD = 200_000
#: Rows of one batch that leaves a task.
BATCH_ROWS = 10_000
#: Levels of a forest that are settled between two lineage cuts.
LEVELS = 4


def chains(wrappers: DataFrame, doc: str, key: str, parent: str) -> DataFrame:
    """(doc, key, chain): the ways from the root down to each wrapper, itself last. A parent that is not there makes a root; a cycle is refused.

    The links of a document of at most HELD wrappers pass through one task, which holds them.
    Ways up of larger documents double each round, so a depth of n takes log n joins.
    """
    rows = wrappers.select(F.col(doc).alias("d"), F.col(key).alias("k"), F.col(parent).alias("up"))
    return with_chains(rows, "d", "k", "up").select(F.col("d").alias(doc), F.col("k").alias(key), "chain")


def with_chains(nodes: DataFrame, doc: str, key: str, parent: str) -> DataFrame:
    """nodes with chain, see chains()."""
    rows = materialize(nodes)
    large = materialize(rows.groupBy(doc).agg(F.count("*").alias("n")).where(F.col("n") > HELD).select(doc))
    some = large.count() > 0
    held = rows.join(F.broadcast(large), rows[doc].eqNullSafe(large[doc]), "left_anti") if some else rows
    schema = StructType([*rows.schema.fields, StructField("chain", ArrayType(rows.schema[key].dataType))])

    def ways(table: pa.Table) -> Iterator[pa.RecordBatch]:
        docs, keys, ups = (table.column(c).to_pylist() for c in (doc, key, parent))
        above = dict(zip(zip(docs, keys), ups))
        found: dict[tuple, list | None] = {}
        for at in zip(docs, keys):
            todo, seen = [], set()
            while at not in found and at in above and at not in seen:
                seen.add(at)
                todo.append(at)
                at = (at[0], above[at])
            way = None if at in seen else found.get(at, [])
            for at in reversed(todo):
                found[at] = way = None if way is None else [*way, at[1]]
        made = pa.array((found[at] for at in zip(docs, keys)), pa.list_(table.schema.field(key).type))
        yield from table.append_column("chain", made).to_batches(BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # of documents that may not have ended
        for batch in batches:
            column = batch.column(doc)
            last, n = column[-1].as_py(), len(column)
            while n and column[n - 1].as_py() == last:
                n -= 1
            if n or (kept and kept[-1].column(doc)[-1].as_py() != last):
                yield from ways(pa.Table.from_batches([*kept, batch.slice(0, n)]))
                kept = []
            kept.append(batch.slice(n))
        if kept:
            yield from ways(pa.Table.from_batches(kept))

    dealt = held.withColumn("_dealt", F.xxhash64(doc)).repartition("_dealt").sortWithinPartitions(doc).drop("_dealt")
    made = materialize(dealt.mapInArrow(run, schema))
    if made.where("chain IS NULL").limit(1).count():
        raise ValueError(f"{parent} has a cycle")
    if some:
        rest = rows.join(F.broadcast(large), rows[doc].eqNullSafe(large[doc]), "left_semi")
        ways_up = _doubled(rest, doc, key, parent).select(F.col(doc).alias("_d"), F.col(key).alias("_k"), "chain")
        made = materialize(made.unionByName(rest.join(ways_up, F.col(doc).eqNullSafe(F.col("_d")) & (F.col(key) == F.col("_k"))).drop("_d", "_k")))
    discard(rows)
    return made


def _doubled(nodes: DataFrame, doc: str, key: str, parent: str) -> DataFrame:
    """As chains, by joins only."""
    rows = materialize(nodes.select(F.col(doc).alias("d"), F.col(key).alias("k"), F.array(F.col(key)).alias("chain"), F.col(parent).alias("up")))
    rounds = rows.count().bit_length() + 1
    while rows.where("up IS NOT NULL").limit(1).count():
        if not rounds:
            raise ValueError(f"{parent} has a cycle")
        above = rows.select(F.col("d").alias("_d"), F.col("k").alias("_k"), F.col("chain").alias("_before"), F.col("up").alias("_next"))
        joined = rows.join(above, F.col("d").eqNullSafe(F.col("_d")) & (F.col("up") == F.col("_k")), "left")
        grown = materialize(joined.select("d", "k", F.when(F.col("_before").isNull(), F.col("chain")).otherwise(F.concat("_before", "chain")).alias("chain"), F.col("_next").alias("up")))
        discard(rows)
        rows, rounds = grown, rounds - 1
    return rows.select(F.col("d").alias(doc), F.col("k").alias(key), "chain")


def factor(wrappers: DataFrame, leaves: DataFrame, properties: Sequence[str], doc: str = "doc", wrapper: str = "wrapper", parent: str = "parent", leaf: str = "leaf", order: str = "place") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(styles, refs, rest) of leaves (doc, leaf, wrapper, order, properties) below a forest of wrappers (doc, wrapper, parent, order).

    A wrapper looks at all leaves below it and at the properties that every one of them has and
    that no wrapper above has taken. Among leaves that none above has matched, the tuple of these
    properties that at least two have, most often and else first, becomes its style; leaves with
    that tuple leave those properties to it. styles (doc, style, properties) are numbered s1, s2
    ... within a document by the leaves that they match, then by their first wrapper; refs (doc,
    wrapper, style) name them; rest are the leaves with what they keep. Equal tuples are one style.
    """
    names = [c for c in leaves.columns if c not in properties]
    tree = chains(wrappers.select(doc, wrapper, parent), doc, wrapper, parent)
    deepest = tree.agg(F.max(F.size("chain"))).first()[0] or 0
    none = F.array().cast("array<string>")
    picked = F.array().cast(f"array<struct<at:{tree.schema[wrapper].dataType.simpleString()},k:array<string>,t:string,n:bigint>>")
    rows = leaves.join(tree, [doc, wrapper]).withColumns({"_frozen": none, "_taken": none, "_matched": F.lit(False), "_picked": picked}).repartition(doc)
    for depth in range(deepest):
        at = F.get("chain", F.lit(depth))
        below = Window.partitionBy(doc, "_at")
        shared = F.array_compact(F.array(*(F.when(F.min(F.col(p).isNotNull()).over(below) & ~F.array_contains("_frozen", p), F.lit(p)) for p in properties)))
        known = rows.withColumn("_at", at).withColumn("_keys", shared).withColumn("_tuple", F.when(F.col("_at").isNotNull() & (F.size("_keys") > 0), _tuple(properties)))
        alike = Window.partitionBy(doc, "_at", "_tuple", "_matched")
        known = known.withColumns({"_n": F.count("*").over(alike), "_early": -F.min(order).over(alike)})
        best = F.max(F.when(F.col("_tuple").isNotNull() & ~F.col("_matched") & (F.col("_n") > 1), F.struct("_n", "_early", "_tuple", "_keys"))).over(below)
        known = known.withColumn("_b", best)
        chosen = F.struct(F.col("_at").alias("at"), F.col("_b._keys").alias("k"), F.col("_b._tuple").alias("t"), F.col("_b._n").alias("n"))
        hit = F.coalesce(~F.col("_matched") & (F.col("_tuple") == F.col("_b._tuple")), F.lit(False))
        settled = {
            "_frozen": F.concat("_frozen", F.coalesce("_b._keys", none)),
            "_taken": F.when(hit, F.col("_b._keys")).otherwise(F.col("_taken")),
            "_matched": F.col("_matched") | hit,
            "_picked": F.when(F.col("_b").isNotNull(), F.array_append("_picked", chosen)).otherwise(F.col("_picked")),
        }
        rows = known.withColumns(settled).drop("_at", "_keys", "_tuple", "_n", "_early", "_b")
        if depth % LEVELS == LEVELS - 1 and depth < deepest - 1:
            rows = materialize(rows).repartition(doc)
    rows = materialize(rows.drop("chain", "_frozen", "_matched"))
    each = rows.where(F.size("_picked") > 0).select(doc, "_picked").distinct().select(doc, F.explode("_picked").alias("p"))
    found = materialize(each.groupBy(doc, F.col("p.at").alias("_at")).agg(F.first("p.t").alias("_t"), F.first("p.n").alias("n")))
    placed = found.join(wrappers.select(doc, F.col(wrapper).alias("_at"), F.col(order).alias("_visit")), [doc, "_at"])
    entries = placed.groupBy(doc, "_t").agg(F.sum("n").alias("n"), F.min("_visit").alias("visit"))
    number = F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("n"), "visit"))
    named = materialize(entries.select(doc, "_t", F.concat(F.lit("s"), number.cast("string")).alias("style")))
    kinds = {p: leaves.schema[p].dataType for p in properties}
    schema = ", ".join(f"`{p}` {kinds[p].simpleString()}" for p in properties)
    styles = named.select(doc, "style", F.from_json("_t", schema).alias("v")).select(doc, "style", "v.*")
    refs = found.join(named, [doc, "_t"]).select(doc, F.col("_at").alias(wrapper), "style")
    rest = rows.select(*names, *(F.when(~F.array_contains("_taken", p), F.col(p)).alias(p) for p in properties))
    return styles, refs, rest


def _tuple(properties: Sequence[str]) -> Column:
    """The JSON of those properties that _keys names."""
    return F.to_json(F.struct(*(F.when(F.array_contains("_keys", p), F.col(p)).alias(p) for p in properties)))


def resolve(wrappers: DataFrame, rest: DataFrame, styles: DataFrame, refs: DataFrame, properties: Sequence[str], doc: str = "doc", wrapper: str = "wrapper", parent: str = "parent", leaf: str = "leaf") -> DataFrame:
    """The leaves with all properties again: their own, else those of the nearest wrapper above whose style has them."""
    tree = chains(wrappers.select(doc, wrapper, parent), doc, wrapper, parent)
    named = refs.join(styles, [doc, "style"]).select(doc, F.col(wrapper).alias("_at"), *(F.col(p).alias(f"_{p}") for p in properties))
    steps = tree.select(doc, wrapper, F.posexplode("chain").alias("_depth", "_at")).join(named, [doc, "_at"])
    nearest = (F.max_by(f"_{p}", F.when(F.col(f"_{p}").isNotNull(), F.col("_depth"))).alias(f"_{p}") for p in properties)
    above = steps.groupBy(doc, wrapper).agg(*nearest)
    own = {p: F.coalesce(p, f"_{p}") for p in properties}
    return rest.join(above, [doc, wrapper], "left").select(*(own.get(c, F.col(c)).alias(c) for c in rest.columns))
