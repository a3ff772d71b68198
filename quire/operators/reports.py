"""Banded reports: nested group breaks, scoped totals and the stream of bands.

Two forms. Where rows are ordered by their group columns, an instance of a group is a
combination of values, so totals are one rollup: pre-aggregated before the shuffle, and no
group passes through one task. Where breaks depend on another row order, they follow from
comparing each row with the one before it; such windows are partitioned by columns on which
every level breaks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.cells import number_text


class BadReport(ValueError):
    """A report definition that has no single meaning."""


def has_changed(column: Column, order: Sequence[Column], within: Sequence[Column]) -> Column:
    """Whether a value differs from the row before it; true on the first row, and null equals null."""
    along = Window.partitionBy(*within).orderBy(*order)
    return (F.row_number().over(along) == 1) | ~column.eqNullSafe(F.lag(column).over(along))


def left(text: Column, n: int) -> Column:
    """The first n code points; null stays null."""
    return F.substring(text, 1, n)


def break_ids(df: DataFrame, levels: Sequence[str], order: Sequence[str], within: Sequence[str]) -> DataFrame:
    """Add break_1.. and group_1..: where each level breaks, outermost first, and the number of its instance.

    A level breaks with the row's own change or with a break further out. Instances are
    numbered from 1 within the partition columns, on which the outermost level must break.
    """
    sort, parts = [F.col(c) for c in order], [F.col(c) for c in within]
    own = df.withColumns({f"_own_{i}": has_changed(F.col(c), sort, parts) for i, c in enumerate(levels, 1)})
    out, cascade = own, F.lit(False)
    for i in range(1, len(levels) + 1):
        cascade = cascade | F.col(f"_own_{i}")
        out = out.withColumn(f"break_{i}", cascade)
    running = Window.partitionBy(*parts).orderBy(*sort).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumns({f"group_{i}": F.sum(F.col(f"break_{i}").cast("long")).over(running) for i in range(1, len(levels) + 1)})
    return out.drop(*(f"_own_{i}" for i in range(1, len(levels) + 1)))


def scoped(df: DataFrame, totals: Mapping[str, Column], within: Sequence[str], level: int) -> DataFrame:
    """Add totals over the instance of a level that a row is in, after break_ids; every row of it gets the whole total."""
    instance = Window.partitionBy(*within, *(f"group_{i}" for i in range(1, level + 1)))
    return df.withColumns({name: total.over(instance) for name, total in totals.items()})


def rollup_totals(df: DataFrame, groups: Sequence[str], totals: Mapping[str, Column]) -> DataFrame:
    """One row for each instance of each level and one for the report: level (0 is the report), groups, totals.

    The report's row is there even without input. Group columns below a row's level are null.
    """
    if len(set(groups)) != len(groups) or set(groups) & set(totals):
        raise BadReport("a name is used twice")
    made = [total.alias(name) for name, total in totals.items()]
    level = sum((1 - F.grouping(g) for g in groups), F.lit(0)).cast("int").alias("level")
    inner = df.rollup(*groups).agg(level, *made).where("level > 0") if groups else None
    whole = df.agg(*made).select(F.lit(0).alias("level"), *(F.lit(None).cast(df.schema[g].dataType).alias(g) for g in groups), *totals)
    return whole if inner is None else whole.unionByName(inner.select("level", *groups, *totals))


def bands(df: DataFrame, groups: Sequence[str], totals: Mapping[str, Column], detail: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The bands of a report over rows ordered by groups, then order.

    Columns are band, level, the groups, the totals (headers and footers) and the detail
    columns. Sorting by band_order gives the stream: a report header; headers outermost first;
    details; footers innermost first; a report footer. Nulls sort last within a group.
    """
    sums = rollup_totals(df, groups, totals)
    nothing = lambda names: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names]
    headers = sums.select(F.when(F.col("level") == 0, "report header").otherwise("group header").alias("band"), "level", *groups, *totals, *nothing(c for c in detail if c not in groups))
    footers = headers.withColumn("band", F.replace("band", F.lit("header"), F.lit("footer")))
    shown = sums.schema
    lines = df.select(F.lit("detail").alias("band"), F.lit(len(groups)).alias("level"), *groups, *(F.lit(None).cast(shown[t].dataType).alias(t) for t in totals), *(c for c in detail if c not in groups))
    everything = headers.unionByName(lines).unionByName(footers)
    footer = F.col("band").endswith("footer")
    steps = []
    for i, g in enumerate(groups, 1):
        # Below its own level a header stands before, and a footer after, all that the level holds.
        outside = F.col("level") < i
        steps.append(F.struct(F.when(outside & footer, 2).when(outside, 0).otherwise(1).alias("side"), F.col(g).isNull().alias("null"), F.col(g).alias("value")))
    place = F.when(F.col("band") == "detail", 1).when(footer, 2).otherwise(0)
    last = F.struct(place.alias("place"), *(F.col(c).alias(f"by_{c}") for c in order if c in detail or c in groups))
    return everything.withColumn("band_order", F.struct(*(s.alias(f"level_{i}") for i, s in enumerate(steps, 1)), last.alias("rows")))


def band_text(bands_: DataFrame, totals: Sequence[str]) -> DataFrame:
    """Add text: what a header or footer shows, its totals as short numbers."""
    shown = [F.concat(F.lit(f"{t}="), F.coalesce(number_text(F.col(t).cast("double")), F.lit(""))) for t in totals]
    return bands_.withColumn("text", F.when(F.col("band") != "detail", F.concat_ws(" ", *shown)))
