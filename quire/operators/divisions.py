"""Divisions of a document as balanced start and end marks around its blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shared_length(a: Column, b: Column) -> Column:
    """How many leading elements two arrays have in common."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    apart = F.array_position(same, False)
    return F.when(apart > 0, apart - 1).otherwise(F.size(same)).cast("int")


def shared_chain(items: DataFrame, keys: list[str], chain: str) -> DataFrame:
    """(keys, chain): what the chains of a block's items begin with in common.

    The smallest and the largest chain in array order have no more in common than all others, so
    two values a block are reduced before the shuffle, however many items it has.
    """
    held = items.groupBy(*keys).agg(F.min(chain).alias("_a"), F.max(chain).alias("_b"))
    return held.select(*keys, F.slice("_a", F.lit(1), shared_length(F.col("_a"), F.col("_b"))).alias(chain))


def division_marks(blocks: DataFrame, items: DataFrame, doc: str, block: str, order: str, chain: str) -> DataFrame:
    """(doc, order, kind, division, block, step): blocks in order with constructStart and constructEnd where divisions change.

    items name the divisions around them, outermost first; a block lies in those that all its
    items share, and a block without items leaves open what is open. Before a block, divisions
    that it is not in end, innermost first, and those that it is in start, outermost first;
    after a document's last block all end. step orders the rows of one block.
    """
    known = blocks.select(doc, block, order).join(shared_chain(items, [doc, block], chain), [doc, block], "left")
    along = Window.partitionBy(doc).orderBy(order, block)
    before = F.last(chain, ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    none = F.array().cast(items.schema[chain].dataType)
    rows = known.withColumn("_was", F.coalesce(before, none)).withColumn("_now", F.coalesce(chain, "_was")).withColumn("_end", F.lead(block).over(along).isNull())
    kept = shared_length(F.col("_was"), F.col("_now"))
    mark = lambda kind: lambda d: F.struct(F.lit(kind).alias("kind"), d.cast("string").alias("division"))
    ends = F.transform(F.reverse(F.slice("_was", kept + 1, F.size("_was"))), mark("constructEnd"))
    starts = F.transform(F.slice("_now", kept + 1, F.size("_now")), mark("constructStart"))
    own = F.array(F.struct(F.lit("block").alias("kind"), F.lit(None).cast("string").alias("division")))
    after = F.when(F.col("_end"), F.transform(F.reverse("_now"), mark("constructEnd"))).otherwise(F.slice(own, 1, 0))
    listed = rows.select(doc, order, block, F.posexplode(F.concat(ends, starts, own, after)).alias("step", "m"))
    return listed.select(doc, order, "m.kind", "m.division", F.when(F.col("m.kind") == "block", F.col(block)).alias(block), "step")
