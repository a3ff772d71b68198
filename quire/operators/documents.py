"""Documents as rows: Markdown blocks, outlines, constructs and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.runtime import materialize

# Line patterns of the block kinds, in the order in which they are tried.
LINE_KINDS = {
    "blank": r"^[ \t]*$",
    "heading": r"^ {0,3}#{1,6}(?:[ \t]|$)",
    "thematicBreak": r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$",
    "codeFence": r"^ {0,3}(?:`{3,}[^`]*|~{3,}.*)$",
    "blockquote": r"^ {0,3}>",
    "listItem": r"^ {0,3}(?:[-+*]|[0-9]{1,9}[.)])(?:[ \t]|$)",
    "htmlBlock": r"^ {0,3}<(?:[A-Za-z][A-Za-z0-9-]*[ \t/>]|/[A-Za-z]|!--|\?)",
    "tableRow": r"^ {0,3}\|.*\|[ \t]*$",
    "codeBlock": r"^(?: {4}|\t)",
}


def line_kind(line: Column) -> Column:
    """The kind of block that a line starts by itself."""
    kind = F
    for name, pattern in LINE_KINDS.items():
        kind = kind.when(line.rlike(pattern), name)
    return kind.otherwise("paragraph")


def markdown_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line_no, line, kind, fenced): lines with their own kind; fenced lines lie in a code fence.

    Lines are numbered from 0 within a document. An odd number of fences before a line opens
    one; the window is within a document.
    """
    lines = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.col(text), "\r\n|\r|\n", -1)).alias("line_no", "line"))
    kinds = lines.withColumn("kind", line_kind(F.col("line")))
    before = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    fences = F.coalesce(F.sum((F.col("kind") == "codeFence").cast("int")).over(before), F.lit(0))
    return kinds.withColumn("fenced", fences % 2 == 1)


def markdown_blocks(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, block, kind, level, first_line, n_lines, text): leaf blocks in order.

    A line goes on a block if it is of its kind and the kind runs on: paragraphs, quotes, table
    rows, html and code blocks do; a plain line after a quote or list item continues it; a fence
    holds its lines. Blank lines end blocks.
    """
    kind = F.when(F.col("fenced") | (F.col("kind") == "codeFence"), "codeBlock").otherwise(F.col("kind"))
    lines = markdown_lines(docs, id_col, text).withColumn("own", kind)
    order = Window.partitionBy("doc").orderBy("line_no")
    previous, was_fence = F.lag("own").over(order), F.lag("fenced").over(order)
    runs_on = F.col("own").isin("paragraph", "blockquote", "tableRow", "htmlBlock", "codeBlock") & (previous == F.col("own"))
    lazy = (F.col("own") == "paragraph") & previous.isin("blockquote", "listItem", "htmlBlock")
    opens = (F.col("kind") == "codeFence") & ~F.col("fenced")
    closed = (previous == "codeBlock") & was_fence & (F.lag("kind").over(order) == "codeFence")
    starts = ~F.coalesce((runs_on | lazy) & ~opens & ~closed, F.lit(False))
    held = lines.withColumn("starts", starts)
    held = held.withColumn("block", F.sum(F.col("starts").cast("long")).over(order) - 1)
    level = F.char_length(F.regexp_extract(F.trim(F.min_by("line", "line_no")), "^#+", 0))
    made = held.where("own <> 'blank' OR fenced").groupBy("doc", "block").agg(
        F.min_by("own", "line_no").alias("kind"),
        level.alias("level"),
        F.min("line_no").alias("first_line"),
        F.count("*").alias("n_lines"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("text"),
    )
    return made.withColumn("level", F.when(F.col("kind") == "heading", F.col("level")))


def outline(blocks: DataFrame, doc: str, order: str, level: str, levels: int = 6) -> DataFrame:
    """Add parent: the last earlier row of a document with a strictly smaller level, null at the root.

    level is null for rows that nest under whatever is open. One window for each level, within
    a document.
    """
    before = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col(level) == i, F.col(order)), ignorenulls=True).over(before) for i in range(1, levels + 1)]
    named = blocks.withColumns({f"_last_{i}": c for i, c in enumerate(last, 1)})
    best = F.lit(None).cast(blocks.schema[order].dataType)
    for i in range(1, levels + 1):
        open_ = F.col(level).isNull() | (F.col(level) > i)
        best = F.when(open_, F.greatest(best, F.col(f"_last_{i}"))).otherwise(best)
    return named.withColumn("parent", best).drop(*(f"_last_{i}" for i in range(1, levels + 1)))


def balanced(marks: DataFrame, doc: str, order: str, step: str) -> DataFrame:
    """(doc, balanced): whether each document's starts (+1) and ends (-1) pair up like brackets."""
    running = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depths = marks.withColumn("_depth", F.sum(step).over(running))
    return depths.groupBy(doc).agg(((F.min("_depth") >= 0) & (F.sum(step) == 0)).alias("balanced"))


def pairs_of_marks(marks: DataFrame, doc: str, order: str, step: str) -> DataFrame:
    """(doc, start, end) of paired marks: an end closes the last open start of its depth."""
    running = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depth = F.sum(step).over(running)
    depths = marks.withColumn("_depth", F.when(F.col(step) > 0, depth).otherwise(depth + 1))
    same = Window.partitionBy(doc, "_depth").orderBy(order)
    paired = depths.withColumn("_next", F.lead(order).over(same)).withColumn("_next_step", F.lead(step).over(same))
    return paired.where((F.col(step) > 0) & (F.col("_next_step") < 0)).select(doc, F.col(order).alias("start"), F.col("_next").alias("end"))


def leaves(blocks: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """Chunks for retrieval: (doc, ordinal, source_path, leaf_hash, n_chars), equal texts with equal hashes."""
    ordinal = F.row_number().over(Window.partitionBy(doc).orderBy(order)) - 1
    rows = blocks.select(doc, order, text).withColumn("ordinal", ordinal.cast("long"))
    path = F.concat(F.lit("blocks["), F.col("ordinal").cast("string"), F.lit("]"))
    return rows.select(doc, "ordinal", path.alias("source_path"), F.sha2(F.col(text).cast("binary"), 256).alias("leaf_hash"), F.char_length(text).cast("long").alias("n_chars"))


def sections_at(blocks: DataFrame, doc: str, order: str, starts: Column) -> DataFrame:
    """Add section: a new one at each row that starts one, if the one before it is not empty."""
    running = Window.partitionBy(doc).orderBy(order)
    first = F.row_number().over(running) == 1
    return blocks.withColumn("_starts", (starts & ~first).cast("long")).withColumn("section", F.sum("_starts").over(running)).drop("_starts")


def flatten(nodes: DataFrame, key: str, parent: str, ordinal: str) -> DataFrame:
    """Add path, the ordinals from the root down; rows in the order of path are the tree in reading order.

    Ways up double each round, so a depth of n takes log n joins. A parent that is not there
    makes a node a root; a cycle is refused.
    """
    rows = materialize(nodes.select(F.col(key).alias("k"), F.array(F.col(ordinal).cast("long")).alias("path"), F.col(parent).alias("up")))
    rounds = rows.count().bit_length() + 1
    while rows.where("up IS NOT NULL").limit(1).count():
        if not rounds:
            raise ValueError(f"{parent} has a cycle")
        above = rows.select(F.col("k").alias("up"), F.col("path").alias("_before"), F.col("up").alias("_next"))
        joined = rows.join(above, "up", "left")
        rows = materialize(joined.select("k", F.concat(F.coalesce("_before", F.array().cast("array<bigint>")), "path").alias("path"), F.col("_next").alias("up")))
        rounds -= 1
    return nodes.join(rows.select(F.col("k").alias(key), "path"), key)
