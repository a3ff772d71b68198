"""Styles: inheritance along chains, overlays and the common tuples worth a style of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.runtime import materialize


def inherit(styles: DataFrame, key: str, parent: str, properties: Sequence[str]) -> DataFrame:
    """(key, properties): each style with the properties that it lacks from the nearest style up its chain.

    Ancestors are doubled each round, so a chain of n styles takes log n joins. A missing parent
    ends a chain, and so does a style that a chain meets again: in a cycle each looks once round.
    """
    rows = materialize(styles.select(key, F.col(parent).alias("_up"), *properties))
    rounds = rows.count().bit_length()  # as many reach past all styles; what is then left goes round in a cycle
    while rounds and rows.where("_up IS NOT NULL").limit(1).count():
        up = rows.select(F.col(key).alias("_up"), F.col("_up").alias("_next"), *(F.col(p).alias(f"_{p}") for p in properties))
        joined = rows.join(up, "_up", "left")
        rows = materialize(joined.select(key, F.col("_next").alias("_up"), *(F.coalesce(p, f"_{p}").alias(p) for p in properties)))
        rounds -= 1
    return rows.drop("_up")


def overlay(rows: DataFrame, styles: DataFrame, ref: str, key: str, properties: Sequence[str]) -> DataFrame:
    """Rows with the properties that they lack from the style that they name; their own win."""
    named = styles.select(F.col(key).alias(ref), *(F.col(p).alias(f"_{p}") for p in properties))
    joined = rows.join(named, ref, "left")
    own = {p: F.coalesce(p, f"_{p}") for p in properties}
    return joined.select(*(own.get(c, F.col(c)).alias(c) for c in rows.columns))


def common_tuples(rows: DataFrame, keys: Sequence[str], properties: Sequence[str], order: str) -> DataFrame:
    """(keys, properties, n, first): property tuples that occur at least twice, for style tables."""
    counts = rows.groupBy(*keys, *properties).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.where("n >= 2")


def chain_edges(rows: DataFrame, ref: str, styles: DataFrame, key: str, parent: str) -> DataFrame:
    """Rows once for each style of the chain that they name, with style and place: 0 for the outermost.

    One join a level of the longest chain; a chain that meets a style again is refused.
    """
    known = materialize(styles.select(F.col(key).alias("_k"), F.col(parent).alias("_up")))
    longest = known.count()
    step = materialize(rows.where(F.col(ref).isNotNull()).join(known, F.col(ref) == F.col("_k")).select(*rows.columns, F.col("_k").alias("style"), "_up", F.lit(0).alias("_depth")))
    found, depth = step, 0
    while step.where("_up IS NOT NULL").limit(1).count():
        depth += 1
        if depth > longest:
            raise ValueError(f"{parent} has a cycle")
        step = materialize(step.drop("style").withColumnRenamed("_up", "_ref").join(known, F.col("_ref") == F.col("_k")).select(*rows.columns, F.col("_k").alias("style"), "_up", F.lit(depth).alias("_depth")))
        found = found.unionByName(step)
    outermost = F.max("_depth").over(Window.partitionBy(*rows.columns))
    return found.select(*rows.columns, "style", (outermost - F.col("_depth")).cast("int").alias("place"))
