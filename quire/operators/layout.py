"""Structure from positions: modes, gaps, interval merges, grids and first-fit lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def modes(df: DataFrame, keys: Sequence[str], value: str, bucket: float = 1.0) -> DataFrame:
    """(keys, mode, n): the bucket with the most rows; the smallest of equals. Halves round up."""
    place = (F.floor(F.col(value) / bucket + 0.5) * bucket).cast("double")
    counts = df.groupBy(*keys, place.alias("mode")).agg(F.count("*").alias("n"))
    best = F.max_by(F.struct("mode", "n"), F.struct("n", (-F.col("mode")).alias("low")))
    return counts.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.mode", "b.n")


def heading_levels(df: DataFrame, keys: Sequence[str], size: str, above: float = 2.0) -> DataFrame:
    """(keys, size, level): sizes at least so far above the most common one, ranked from the largest, at most 6."""
    common = modes(df, keys, size)
    sizes = df.groupBy(*keys, size).agg(F.count("*").alias("_n")).join(common.select(*keys, "mode"), list(keys))
    large = sizes.where(F.col(size) >= F.col("mode") + above)
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(F.col(size).desc()))
    return large.select(*keys, size, F.least(rank, F.lit(6)).alias("level"))


def runs_by_gap(df: DataFrame, keys: Sequence[str], order: Sequence[str], gap: Column) -> DataFrame:
    """Add run: a new one, from 0, at each row whose gap to the row before it is true. Use F.lag in gap over the same keys."""
    along = Window.partitionBy(*keys).orderBy(*order)
    flagged = df.withColumn("_new", F.coalesce(gap, F.lit(False)).cast("long"))
    return flagged.withColumn("run", F.sum("_new").over(along)).drop("_new")


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, slack: float = 0) -> DataFrame:
    """(keys, start, end, n): intervals that overlap, or lie within slack of each other, as one."""
    along = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(along.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.withColumn("_reach", reach)
    new = (F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + slack)).cast("long")
    islands = flagged.withColumn("_new", new).withColumn("_island", F.sum("_new").over(along))
    return islands.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


def assign_to_grid(points: DataFrame, bounds: DataFrame, keys: Sequence[str], value: str, low: str, high: str, cell: float) -> DataFrame:
    """Points with the interval [low, high) that holds them, by equi-join on cells of a fixed width.

    An interval is entered in each cell that it touches, so choose cells about as wide as the
    intervals; points in no interval have no row.
    """
    last = F.when(F.pmod(F.col(high), F.lit(cell)) == 0, F.floor(F.col(high) / cell) - 1).otherwise(F.floor(F.col(high) / cell))
    entered = bounds.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(low) / cell), F.greatest(last, F.floor(F.col(low) / cell)))))
    placed = points.withColumn("_cell", F.floor(F.col(value) / cell))
    joined = placed.join(entered, [*keys, "_cell"])
    return joined.where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_cell")


def lines_by_leader(items: DataFrame, keys: Sequence[str], y: str, size: str, order: str, share: float = 0.5) -> DataFrame:
    """Add line: an item joins the first line whose leader's baseline is within a share of its own size.

    First fit depends on the order of items and does not chain, so it is not a window; the
    items of one page are folded in one row of arrays.
    """
    row = F.struct(*(F.col(c) for c in items.columns)).alias("r")
    pages = items.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), row))).alias("_rows"))
    start = F.struct(F.array().cast("array<double>").alias("leaders"), F.array().cast("array<bigint>").alias("out"))

    def place(a: Column, item: Column) -> Column:
        at, reach = item["r"][y].cast("double"), item["r"][size] * share
        hit = F.array_position(F.transform(a["leaders"], lambda leader: F.abs(leader - at) <= reach), True)
        line = F.when(hit > 0, hit - 1).otherwise(F.size(a["leaders"]))
        leaders = F.when(hit > 0, a["leaders"]).otherwise(F.array_append(a["leaders"], at))
        return F.struct(leaders.alias("leaders"), F.array_append(a["out"], line.cast("long")).alias("out"))

    placed = pages.select("_rows", F.aggregate("_rows", start, place, lambda a: a["out"]).alias("_lines"))
    listed = placed.select(F.explode(F.arrays_zip("_rows", "_lines")).alias("z"))
    return listed.select("z._rows.r.*", F.col("z._lines").alias("line"))


def boundaries(rules: DataFrame, keys: Sequence[str], slack: float = 0.5, least: float = 4.0) -> DataFrame:
    """(keys, axis, n, at, next): distinct positions of long straight rules (x1, y1, x2, y2), in order.

    axis is y for level rules and x for upright ones. A position within slack of the leader of
    the cluster before it joins that cluster; this does not chain. next is the position after,
    null at the last. Rules shorter than least, or slanted, are left out.
    """
    level = (F.abs(F.col("y2") - F.col("y1")) <= slack) & (F.abs(F.col("x2") - F.col("x1")) >= least)
    upright = (F.abs(F.col("x2") - F.col("x1")) <= slack) & (F.abs(F.col("y2") - F.col("y1")) >= least)
    placed = rules.select(*keys, F.when(level, "y").when(upright, "x").alias("axis"), F.when(level, F.col("y1")).when(upright, F.col("x1")).cast("double").alias("at"))
    sorted_ = placed.where("axis IS NOT NULL").groupBy(*keys, "axis").agg(F.sort_array(F.collect_set("at")).alias("ats"))
    start = F.array().cast("array<double>")

    def lead(found: Column, at: Column) -> Column:
        fresh = (F.size(found) == 0) | (at - F.coalesce(F.try_element_at(found, F.lit(-1)), at) > slack)
        return F.when(fresh, F.array_append(found, at)).otherwise(found)

    leaders = sorted_.select(*keys, "axis", F.aggregate("ats", start, lead).alias("ats"))
    listed = leaders.select(*keys, "axis", F.posexplode("ats").alias("n", "at"), F.col("ats").alias("_all"))
    return listed.select(*keys, "axis", "n", "at", F.get("_all", F.col("n") + 1).alias("next"))


def lattice(rules: DataFrame, keys: Sequence[str], least_lines: int = 3) -> DataFrame:
    """(keys, row, column, x1, y1, x2, y2): the cells between neighbouring boundaries of each page.

    A page needs at least so many boundaries on each axis. Cells are joined within a page only.
    """
    found = boundaries(rules, keys)
    counted = found.withColumn("_lines", F.count("*").over(Window.partitionBy(*keys, "axis"))).where(F.col("_lines") >= least_lines).where("next IS NOT NULL")
    rows = counted.where("axis = 'y'").select(*keys, F.col("n").alias("row"), F.col("at").alias("y1"), F.col("next").alias("y2"))
    columns = counted.where("axis = 'x'").select(*keys, F.col("n").alias("column"), F.col("at").alias("x1"), F.col("next").alias("x2"))
    return rows.join(columns, list(keys)).select(*keys, "row", "column", "x1", "y1", "x2", "y2")


def line_spacing(lines: DataFrame, keys: Sequence[str], y: str, size: str, order: str, bucket: float = 0.5) -> DataFrame:
    """(keys, spacing): a page's ordinary step from line to line.

    The most common step in buckets of half a point, the first met of equals; the smallest step
    where none recurs. A page of fewer than three lines has 1.2 times its first most common size.
    """
    along = Window.partitionBy(*keys).orderBy(order)
    known = lines.select(*keys, order, F.col(size).alias("_size"), (F.lag(y).over(along) - F.col(y)).alias("_step"))

    def common(value: str, name: str) -> DataFrame:
        place = (F.floor(F.col(value) / bucket + 0.5) * bucket).cast("double")
        counts = known.where(F.col(value).isNotNull()).groupBy(*keys, place.alias("at")).agg(F.count("*").alias("n"), F.min(order).alias("met"))
        first = F.max_by("at", F.struct("n", (-F.col("met")).alias("early")))
        return counts.groupBy(*keys).agg(first.alias(name), F.max("n").alias(f"{name}_n"))

    least = known.groupBy(*keys).agg(F.count("*").alias("_lines"), F.min("_step").alias("_least"))
    found = least.join(common("_size", "_mode"), list(keys)).join(common("_step", "_gap"), list(keys), "left")
    spacing = F.when(F.col("_lines") < 3, F.col("_mode") * 1.2).when(F.col("_gap_n") > 1, F.col("_gap")).otherwise(F.col("_least"))
    return found.select(*keys, spacing.alias("spacing"))


def paragraphs(lines: DataFrame, keys: Sequence[str], y: str, x: str, size: str, order: str, gap: float = 1.25) -> DataFrame:
    """Add paragraph: a new one, from 0, where the step down, the size or the indent of a line breaks from the one before.

    The step is measured against gap times the page's line_spacing, sizes are close within half a
    point, and an indent is more than one em off the page's most common left edge after a line
    that is at that edge. y falls down the page; order is a number. Windows are within a page.
    """
    along = Window.partitionBy(*keys).orderBy(order)
    step = lines.withColumn("_step", F.lag(y).over(along) - F.col(y))
    spacing = line_spacing(lines, keys, y, size, order).withColumnRenamed("spacing", "_spacing")
    edges = modes(lines, keys, x).select(*keys, F.col("mode").alias("_edge"))
    known = step.join(spacing, list(keys), "left").join(edges, list(keys), "left")
    off = F.abs(F.col(x) - F.col("_edge"))
    indented = (off > F.col(size)) & (F.abs(F.lag(x).over(along) - F.col("_edge")) <= F.col(size))
    breaks = (F.col("_step") > gap * F.col("_spacing")) | (F.abs(F.col(size) - F.lag(size).over(along)) > 0.5) | indented
    return runs_by_gap(known, keys, [order], breaks).withColumnRenamed("run", "paragraph").drop("_step", "_spacing", "_edge")


def spaced_text(items: DataFrame, keys: Sequence[str], x: str, width: str, size: str, text: str, order: Sequence[str], tab: float = 2.0, space: float = 0.5) -> DataFrame:
    """(keys, text): a line's items in order; a gap over tab em gives a tab, one over space points a space."""
    along = Window.partitionBy(*keys).orderBy(x, *order)
    gap = F.col(x) - F.lag(F.col(x) + F.coalesce(F.col(width), F.lit(0.0))).over(along)
    between = F.when(gap > tab * F.col(size), "\t").when(gap > space, " ").otherwise("")
    parts = items.select(*keys, F.struct(F.row_number().over(along).alias("n"), F.concat(between, F.coalesce(F.col(text), F.lit(""))).alias("t")).alias("_p"))
    ordered = F.transform(F.sort_array(F.collect_list("_p")), lambda p: p["t"])
    return parts.groupBy(*keys).agg(F.array_join(ordered, "").alias("text"))


def page_bands(rows: DataFrame, keys: Sequence[str], order: str, size: str, room: float, breaks: str | None = None) -> DataFrame:
    """Add band: rows fill pages of that room in order; one that no longer fits, or a manual break, opens the next.

    A row larger than the room has a band to itself. The fill depends on all rows before, so
    each group's rows (one sheet's) are folded in one row of arrays.
    """
    fields = [F.col(order).alias("o"), F.col(size).cast("double").alias("s"), (F.col(breaks) if breaks else F.lit(False)).alias("b")]
    sheets = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_rows"))
    start = F.struct(F.lit(-1).cast("long").alias("band"), F.lit(0.0).alias("used"), F.array().cast("array<bigint>").alias("out"))

    def fill(a: Column, r: Column) -> Column:
        fresh = (a["band"] < 0) | r["b"] | (a["used"] + r["s"] > room)
        band = F.when(fresh, a["band"] + 1).otherwise(a["band"])
        return F.struct(band.alias("band"), F.when(fresh, r["s"]).otherwise(a["used"] + r["s"]).alias("used"), F.array_append(a["out"], band).alias("out"))

    filled = sheets.select(*keys, "_rows", F.aggregate("_rows", start, fill, lambda a: a["out"]).alias("_bands"))
    listed = filled.select(*keys, F.explode(F.arrays_zip("_rows", "_bands")).alias("z"))
    return listed.select(*keys, F.col("z._rows.o").alias(order), F.col("z._bands").alias("band"))


def paint_order(vectors: DataFrame, shapes: DataFrame, page: str, order: str, own: str) -> DataFrame:
    """Vectors and shapes of each page as one list with place, from 0, back to front.

    Sorted by the order column where every item of the page has one, else vectors before
    shapes; own gives the order within each table and among equals. Both need the same columns.
    """
    both = vectors.withColumn("kind", F.lit("vector")).unionByName(shapes.withColumn("kind", F.lit("shape")))
    whole = F.count(order).over(Window.partitionBy(page)) == F.count("*").over(Window.partitionBy(page))
    gated = both.withColumn("_order", F.when(whole, F.col(order)))
    place = F.row_number().over(Window.partitionBy(page).orderBy("_order", F.col("kind") == "shape", own)) - 1
    return gated.withColumn("place", place.cast("long")).drop("_order")
