"""Joins beyond equality: as-of, nearest, largest overlap, outer with defaults, nearest ancestor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.runtime import materialize


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the values of the last right row of its keys at or before its time, null where none is.

    Both sides go through one shuffle as a union and one window, so no pairs are formed. Right
    rows of one time count by their values' order, the largest last; a null time matches nothing.
    """
    taken = F.struct(*(F.col(v) for v in values))
    row = F.struct(*(F.col(c) for c in left.columns))
    both = left.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), row.alias("_row"), F.lit(None).cast(right.select(taken.alias("v")).schema["v"].dataType).alias("_taken"))
    offered = right.where(F.col(at).isNotNull()).select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(row.alias("r")).schema["r"].dataType).alias("_row"), taken.alias("_taken"))
    along = Window.partitionBy(*keys).orderBy(F.col("_at").asc_nulls_first(), "_side", "_taken").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = both.unionByName(offered).withColumn("_last", F.last("_taken", ignorenulls=True).over(along)).where("_side = 1")
    return filled.select("_row.*", *(F.col("_last")[v].alias(f"{v}_as_of") for v in values))


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """Add nearest and distance: the value of the right row of the same keys whose position is closest, the lower of equals.

    Positions are numbers. Like as_of, a union and two windows, one along and one against the
    order, each of which carries the last offer on.
    """
    row = F.struct(*(F.col(c) for c in left.columns))
    offer = F.struct(F.col(at).cast("double").alias("at"), F.col(value).alias("value"))
    none_row, none_offer = (F.lit(None).cast(d.select(c.alias("x")).schema["x"].dataType) for d, c in ((left, row), (right, offer)))
    both = left.select(*keys, F.col(at).cast("double").alias("_at"), row.alias("_row"), none_offer.alias("_offer"))
    both = both.unionByName(right.where(F.col(at).isNotNull()).select(*keys, F.col(at).cast("double").alias("_at"), none_row.alias("_row"), offer.alias("_offer")))
    along = Window.partitionBy(*keys).orderBy("_at", F.col("_row").isNotNull(), "_offer")
    below = F.last("_offer", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    against = Window.partitionBy(*keys).orderBy(F.col("_at").desc(), F.col("_row").isNotNull().desc(), F.col("_offer").desc())
    above = F.last("_offer", ignorenulls=True).over(against.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = both.withColumns({"_below": below, "_above": above}).where("_row IS NOT NULL")
    down, up = F.col("_at") - F.col("_below.at"), F.col("_above.at") - F.col("_at")
    lower = up.isNull() | (down <= up)
    return seen.select("_row.*", F.when(lower, F.col("_below.value")).otherwise(F.col("_above.value")).alias("nearest"), F.when(lower, down).otherwise(up).alias("distance"))


def largest_overlap(boxes: DataFrame, areas: DataFrame, keys: Sequence[str], box: str, area: str, cell: float) -> DataFrame:
    """(box, area, shared): for each box the area with the largest intersection, the smallest name of equals.

    Both sides hold x1, y1, x2, y2. They meet in the square cells that they cover, so rows grow
    with covered cells, not with pairs; an intersection counts in its first common cell only.
    Boxes that meet no area have no row.
    """

    def covering(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(*keys, F.col(name), *(F.col(c).cast("double").alias(f"_{name}_{c}") for c in ("x1", "y1", "x2", "y2")))
        for axis in "xy":
            low, high = (F.floor(F.col(f"_{name}_{axis}{i}") / cell) for i in (1, 2))
            rows = rows.withColumn(f"_c{axis}", F.explode(F.sequence(low, F.greatest(low, high))))
        return rows

    met = covering(boxes, box).join(covering(areas, area), [*keys, "_cx", "_cy"])
    corner = {f"{axis}{i}": f(F.col(f"_{box}_{axis}{i}"), F.col(f"_{area}_{axis}{i}")) for axis in "xy" for i, f in ((1, F.greatest), (2, F.least))}
    first = (F.floor(corner["x1"] / cell) == F.col("_cx")) & (F.floor(corner["y1"] / cell) == F.col("_cy"))
    shared = (corner["x2"] - corner["x1"]) * (corner["y2"] - corner["y1"])
    kept = met.where((corner["x2"] > corner["x1"]) & (corner["y2"] > corner["y1"]) & first).select(*keys, box, area, shared.alias("shared"))
    best = kept.groupBy(*keys, box).agg(F.min_by(area, F.struct(-F.col("shared"), F.col(area))).alias(area), F.max("shared").alias("shared"))
    return best.select(*keys, box, area, "shared")


def outer_with_default(left: DataFrame, right: DataFrame, keys: Sequence[str], defaults: dict[str, Column]) -> DataFrame:
    """A full outer join on keys; columns of rows that only the right side has take the given defaults."""
    marked = left.withColumn("_here", F.lit(True))
    joined = marked.join(right, list(keys), "full_outer")
    made = {c: F.when(F.col("_here").isNull(), value).otherwise(F.col(c)) for c, value in defaults.items()}
    return joined.withColumns(made).drop("_here")


def with_fallback(rows: DataFrame, table: DataFrame, first: Sequence[str], second: Sequence[str], value: str) -> DataFrame:
    """Add value from the table's row with the same first keys, else from the smallest with the same second keys."""
    exact = table.groupBy(*first).agg(F.min(value).alias("_exact"))
    loose = table.groupBy(*second).agg(F.min(value).alias("_loose"))
    return rows.join(exact, list(first), "left").join(loose, list(second), "left").withColumn(value, F.coalesce("_exact", "_loose")).drop("_exact", "_loose")


def nearest_ancestor(nodes: DataFrame, key: str, parent: str, chosen: str) -> DataFrame:
    """(key, ancestor): each node's nearest chosen node on its way up, itself included; null where none is.

    Every round doubles the way up that is known (pointer jumping), so a depth of n takes log n
    joins. Nodes on a cycle without a chosen node end when all others have.
    """
    rows = materialize(nodes.select(F.col(key).alias("k"), F.when(F.col(chosen), F.col(key)).alias("ancestor"), F.when(~F.coalesce(F.col(chosen), F.lit(False)), F.col(parent)).alias("up")))
    left = rows.where("up IS NOT NULL").count()
    rounds = max(1, rows.count().bit_length() + 1)
    while left and rounds:
        above = rows.select(F.col("k").alias("up"), F.col("ancestor").alias("_found"), F.col("up").alias("_next"))
        joined = rows.join(above, "up", "left")
        rows = materialize(joined.select("k", F.coalesce("ancestor", "_found").alias("ancestor"), F.when(F.coalesce("ancestor", "_found").isNull(), F.col("_next")).alias("up")))
        left, rounds = rows.where("up IS NOT NULL").count(), rounds - 1
    return rows.select(F.col("k").alias(key), "ancestor")


def repeated_ids(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of the ids that occur more than once; require_unique refuses them."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(rows: DataFrame, key: str) -> DataFrame:
    """The rows as they are; the job fails where an id repeats."""
    found = repeated_ids(rows, key).limit(1).collect()
    if found:
        raise ValueError(f"{key} {found[0][key]!r} occurs {found[0]['n']} times")
    return rows
