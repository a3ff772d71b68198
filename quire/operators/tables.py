"""Tables and text blocks of pages: tagged tables with spans, grids from rules or from columns of text, slide blocks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from math import floor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from quire.operators.components import lowest

#: Width of a column in which no item reports one.
COLUMN_WIDTH = 40.0
#: Rows of one batch of grids that leaves a task, until the page ends.
GRID_ROWS = 10_000


def place_cells(cells: DataFrame, keys: Sequence[str], row: str, order: str, row_span: str | None = None, column_span: str | None = None) -> DataFrame:
    """Add row_index, column_index, row_span and column_span: cells of each table in the first free places of their rows.

    Rows count from 0 in the order of row, and a cell takes the first column that no earlier
    cell of its row, and no cell above with a row span, holds. A span is at least 1; a row span
    ends with the table. Without spans this is a ranking. With them, places depend on all rows
    before, so the cells of a table go through one task in order, which holds one row's columns.
    """
    names = ("row_index", "column_index", "row_span", "column_span")
    ranked = cells.withColumn("_row", F.dense_rank().over(Window.partitionBy(*keys).orderBy(row)) - 1)
    within = Window.partitionBy(*keys, row).orderBy(order)
    if row_span is None and column_span is None:
        placed = {"row_index": F.col("_row"), "column_index": F.row_number().over(within) - 1, "row_span": F.lit(1), "column_span": F.lit(1)}
        return ranked.withColumns({n: c.cast("int") for n, c in placed.items()}).drop("_row")
    spans = {f"_{axis}": F.greatest(F.coalesce(F.col(c).cast("int") if c else F.lit(1), F.lit(1)), F.lit(1)) for axis, c in (("down", row_span), ("across", column_span))}
    ranked = ranked.withColumns({"_n": F.row_number().over(within), "_last": F.max("_row").over(Window.partitionBy(*keys))}).withColumns(spans)
    shown = [*cells.columns, *names]

    def occupy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, at, column = None, {}, -1, 0  # held: column to the last row that it is taken in
        for batch in batches:
            columns, downs = [], []
            table = zip(*(batch.column(k).to_pylist() for k in keys))
            for now, row_, last, down, across in zip(table, *(batch.column(c).to_pylist() for c in ("_row", "_last", "_down", "_across"))):
                if now != key:
                    key, held, at = now, {}, -1
                if row_ != at:
                    at, column = row_, 0
                while any(held.get(c, -1) >= row_ for c in range(column, column + across)):
                    column += 1
                downs.append(min(down, last - row_ + 1))
                columns.append(column)
                for c in range(column, column + across):
                    held[c] = row_ + downs[-1] - 1
                column += across
            made = [batch.column("_row"), pa.array(columns, pa.int32()), pa.array(downs, pa.int32()), batch.column("_across")]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(shown) - len(names)], *made], shown)

    schema = StructType([*cells.schema.fields, *(StructField(n, IntegerType()) for n in names)])
    return ranked.select(*cells.columns, "_row", "_n", "_last", "_down", "_across").sortWithinPartitions(*keys, "_row", "_n").mapInArrow(occupy, schema)


def tagged_tables(nodes: DataFrame, items: DataFrame, page: str, row_span: str | None = None, column_span: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells and columns of the tables that a page's structure tags.

    nodes (page, id, parent, type, place, spans) form trees, items (page, node, place, x, width,
    text) hang on them. A cell is a TD or TH below a TR below a Table, its text all items whose
    nearest cell it is; what hangs elsewhere is no part of a table. Returns (page, table,
    row_index, column_index, row_span, column_span, text) and (page, table, column_index, width),
    the width being the extent of the items of the column's cells, COLUMN_WIDTH where none has one.
    A task holds the nodes and items of some pages at once.
    """
    down, across = (F.col(c).cast("int") if c else F.lit(None).cast("int") for c in (row_span, column_span))
    known = F.col(page).isNotNull()
    tree = nodes.where(known & F.col("id").isNotNull()).groupBy(page).agg(F.collect_list(F.struct("id", "parent", "type", "place", down.alias("down"), across.alias("across"))).alias("nodes"))
    held = lambda *c: items.where(known & F.col("node").isNotNull()).groupBy(page).agg(F.collect_list(F.struct("node", *c)).alias("items"))
    return tagged_cells(tree.join(held("place", "text"), page, "left"), page), tagged_columns(tree.join(held("x", "width"), page, "left"), page)


def tagged_cells(pages: DataFrame, page: str) -> DataFrame:
    """The cells of tagged_tables() from pages with nodes (id, parent, type, place, down, across) and items (node, place, text), arrays of structs."""

    def cells(tree: _Tree) -> list:
        at, place, text = tree.items("place", "text")
        return [*tree.keys(tree.tables), *(pa.array(c, pa.int32()) for c in (tree.rows, tree.columns, tree.downs, tree.acrosses)), _texts(at, place, text, len(tree.cells))]

    more = "row_index int, column_index int, row_span int, column_span int, text string"
    return _from_trees(pages, page, cells, more)


def tagged_columns(pages: DataFrame, page: str) -> DataFrame:
    """The columns of tagged_tables() from pages with nodes as in tagged_cells() and items (node, x, width)."""

    def columns(tree: _Tree) -> list:
        order = np.lexsort((tree.columns, tree.tables))
        fresh = np.concatenate([[True], (tree.tables[order][1:] != tree.tables[order][:-1]) | (tree.columns[order][1:] != tree.columns[order][:-1])])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(fresh) - 1
        at, x, width = tree.items("x", "width")
        known = x.is_valid().to_numpy(zero_copy_only=False)
        left = pc.cast(x, pa.float64()).to_numpy(zero_copy_only=False)[known]
        right = left + pc.fill_null(pc.cast(width, pa.float64()), 0.0).to_numpy(zero_copy_only=False)[known]
        column = number[at[known]]
        low, high = np.full(fresh.sum(), np.nan), np.full(fresh.sum(), -np.inf)
        np.fmin.at(low, column, left)
        np.maximum.at(high, column, right)
        widths = np.full(len(low), COLUMN_WIDTH)
        held = np.zeros(len(low), bool)
        held[column] = True
        extent = (high - low)[held]
        widths[held] = np.where(np.isnan(extent) | (extent > 0), extent, COLUMN_WIDTH)
        firsts = order[fresh]
        return [*tree.keys(tree.tables[firsts]), pa.array(tree.columns[firsts], pa.int32()), pa.array(widths)]

    return _from_trees(pages, page, columns, "column_index int, width double")


def _ranks(values: pa.Array) -> np.ndarray:
    return pc.rank(values, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)


def _texts(at: np.ndarray, place: np.ndarray, text: pa.Array, n: int) -> pa.Array:
    """The texts at each of the numbers below n, by place, those of one place by text, as one text."""
    order = np.lexsort((place, at))
    if ((at[order][1:] == at[order][:-1]) & (place[order][1:] == place[order][:-1])).any():
        order = pc.sort_indices(pa.table({"at": at, "place": place, "text": text}), [("at", "ascending"), ("place", "ascending"), ("text", "ascending")], null_placement="at_start").to_numpy()
    order = order[text.is_valid().to_numpy(zero_copy_only=False)[order]]
    offsets = np.searchsorted(at[order], np.arange(n + 1)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), text.take(pa.array(order))), " ")


class _Tree:
    """The trees of some pages: cells, by table and in order, with table, row, column and spans of each, and the items in them.

    A node whose way up is a cycle has nothing above it; of nodes of a page with one id the last counts, with the largest spans.
    """

    def __init__(self, page: pa.Array, nodes: pa.Array, items: pa.Array) -> None:
        tree, self._items = nodes.flatten(), items.flatten()
        owner, below = (np.repeat(np.arange(len(page)), pc.fill_null(pc.list_value_length(x), 0).to_numpy()) for x in (nodes, items))
        ids = tree.field("id")
        names = pa.concat_arrays([ids, tree.field("parent").cast(ids.type), self._items.field("node").cast(ids.type)]).dictionary_encode()
        codes = pc.fill_null(names.indices, -1).to_numpy().astype(np.int64)
        n, every = len(ids), len(names.dictionary)
        key = owner * every + codes[:n]
        by_key = np.argsort(key, kind="stable")
        sorted_ = key[by_key]

        def found(pages: np.ndarray, wanted: np.ndarray) -> np.ndarray:
            """The node of that code on the page, n where none is."""
            if not n:
                return np.zeros(len(wanted), np.int64)
            at = np.searchsorted(sorted_, pages * every + wanted, "right") - 1
            return np.where((wanted >= 0) & (at >= 0) & (sorted_[at] == pages * every + wanted), by_key[at], n)

        own = found(owner, codes[:n])
        parent = np.append(found(owner, codes[n : 2 * n]), n)
        steps = int(np.bincount(owner).max()).bit_length() + 1 if n else 0

        def nearest(*kinds: str) -> tuple[np.ndarray, np.ndarray]:
            """The nearest node of these kinds at or above each, n where none is, and whether a node is one."""
            match = np.append(pc.fill_null(pc.is_in(tree.field("type"), pa.array(kinds, tree.field("type").type)), False).to_numpy(zero_copy_only=False), False)
            up = np.where(match, np.arange(n + 1), parent)
            for _ in range(steps):
                up = up[up]
            return np.where(match[up], up, n), match

        cell, is_cell = nearest("TD", "TH")
        row = nearest("TR")[0][parent[cell]]
        table = nearest("Table")[0][parent[row]]
        place = np.append(_ranks(tree.field("place")), 0)
        down, across = (np.append(np.maximum(pc.fill_null(tree.field(c), 1).to_numpy(), 1), 1) for c in ("down", "across"))
        if (own != np.arange(n)).any():
            np.maximum.at(down, own, down[:n])
            np.maximum.at(across, own, across[:n])
        kept = np.flatnonzero(is_cell[:n] & (own == np.arange(n)) & (table[:n] < n))
        order = np.lexsort((codes[kept], place[kept], place[row[kept]], table[kept]))
        self.cells = kept[order]
        self.tables, self.acrosses = table[self.cells], across[self.cells]
        rows = place[row[self.cells]]
        fresh = np.concatenate([[True], self.tables[1:] != self.tables[:-1]]) if len(self.cells) else np.zeros(0, bool)
        line = np.cumsum(fresh | np.concatenate([[True], rows[1:] != rows[:-1]])) - 1 if len(self.cells) else np.zeros(0, np.int64)
        starts = np.flatnonzero(fresh)
        of = np.cumsum(fresh) - 1
        self.rows = line - line[starts][of]
        lasts = self.rows[np.append(starts[1:], len(self.cells)) - 1] if len(starts) else starts
        self.downs = np.minimum(down[self.cells], lasts[of] - self.rows + 1)
        self.columns = self._columns(fresh, line)
        position = np.full(n + 1, -1)
        position[self.cells] = np.arange(len(self.cells))
        at = position[cell[found(below, codes[2 * n :])]]
        self._inside = np.flatnonzero(at >= 0)
        self._at = at[self._inside]
        self._page, self._owner, self._ids = page, owner, ids

    def _columns(self, fresh: np.ndarray, line: np.ndarray) -> np.ndarray:
        """The first free columns of the cells, row by row."""
        out, held, last, column = [], {}, -1, 0
        for first, row, at, down, across in zip(fresh.tolist(), line.tolist(), self.rows.tolist(), self.downs.tolist(), self.acrosses.tolist()):
            if first:
                held = {}
            if row != last:
                last, column = row, 0
            if across == 1:
                while held.get(column, -1) >= at:
                    column += 1
            else:
                while any(held.get(c, -1) >= at for c in range(column, column + across)):
                    column += 1
            out.append(column)
            if down > 1:
                for c in range(column, column + across):
                    held[c] = at + down - 1
            column += across
        return np.array(out, np.int64)

    def items(self, *names: str) -> list:
        """The cells that items lie in, by number, and their values; of place its rank."""
        inside = self._items.take(pa.array(self._inside))
        return [self._at, *(_ranks(inside.field(c)) if c == "place" else inside.field(c) for c in names)]

    def keys(self, tables: np.ndarray) -> list:
        return [self._page.take(pa.array(self._owner[tables])), self._ids.take(pa.array(tables))]


def _from_trees(pages: DataFrame, page: str, made: Callable[[_Tree], list], more: str) -> DataFrame:
    """(page, table, more): what is made of the trees of pages, one batch of pages after the other."""
    nodes = pages.schema["nodes"].dataType.elementType
    kinds = StructType([pages.schema[page], StructField("table", nodes["id"].dataType), *StructType.fromDDL(more)])
    names = kinds.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree = _Tree(*batch.columns)
            if len(tree.cells):
                yield pa.RecordBatch.from_arrays(made(tree), names)

    return pages.where(F.col(page).isNotNull()).select(page, "nodes", "items").mapInArrow(run, kinds)


def _by_page(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """Rows with all of a page in one partition, in order.

    They are dealt by a column made of the keys: where all sides of a union are dealt by the keys themselves, Spark
    leaves such a step out, and AQE may then join partitions of each side differently.
    """
    return rows.withColumn("_dealt", F.xxhash64(*keys)).repartition("_dealt").sortWithinPartitions(*keys, *order)


def merged_cells(cells: DataFrame, rules: DataFrame, keys: Sequence[str], slack: float = 0.5) -> DataFrame:
    """(keys, row, column, row_span, column_span, x1, y1, x2, y2): lattice cells, those without a rule between them as one.

    cells are those of layout.lattice. The edge between two neighbours is a wall where rules cover its middle. Cells that are not walled off
    are one by components over neighbours, so a merged cell of any shape has one row, the box
    around it; row and column are its first.
    """
    upright = F.abs(F.col("x2") - F.col("x1")) <= slack
    low, high = (F.when(upright, f("y1", "y2")).otherwise(f("x1", "x2")).cast("double").alias(n) for f, n in ((F.least, "y1"), (F.greatest, "y2")))
    at = F.when(upright, F.col("x1")).otherwise(F.col("y1")).cast("double")
    lines = rules.select(*keys, F.lit(0).alias("_kind"), upright.alias("_upright"), at.alias("x1"), low, high).where("x1 IS NOT NULL AND y1 IS NOT NULL")
    rows = lines.unionByName(cells.select(*keys, F.lit(1).alias("_kind"), F.col("row").cast("int").alias("row"), F.col("column").cast("int").alias("column"), *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2"))), allowMissingColumns=True)
    box = ["row", "column", "row_span", "column_span", "x1", "y1", "x2", "y2"]
    fields = {f.name: f for f in rows.schema.fields}
    schema = StructType([*(fields[k] for k in keys), *(StructField(n, IntegerType()) for n in box[:4]), *(StructField(n, DoubleType()) for n in box[4:])])
    types, shown, keyed = [to_arrow_type(f.dataType) for f in schema], [f.name for f in schema], list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, walls, lattice = None, {}, {}

        def walled(upright: bool, at: float, middle: float) -> bool:
            near = floor(at / (2 * slack))
            return any(abs(rule - at) <= 2 * slack and low <= middle <= high for i in (-1, 0, 1) for rule, low, high in walls.get((upright, near + i), ()))

        def boxes() -> list[list]:
            """The merged cells of the page: first and last row and column, and corners."""
            over = {at: at for at in lattice}

            def top(at: tuple[int, int]) -> tuple[int, int]:
                while over[at] != at:
                    over[at] = at = over[over[at]]
                return at

            for (row, column), (x1, y1, x2, y2) in lattice.items():
                for other, edge in (((row, column + 1), (True, x2, (y1 + y2) / 2)), ((row + 1, column), (False, y2, (x1 + x2) / 2))):
                    if other in lattice and not walled(*edge):
                        one, two = top((row, column)), top(other)
                        over[max(one, two)] = min(one, two)
            made: dict[tuple[int, int], list] = {}
            for at, (x1, y1, x2, y2) in lattice.items():
                b = made.setdefault(top(at), [*at, *at, x1, y1, x2, y2])
                b[:] = [min(b[0], at[0]), min(b[1], at[1]), max(b[2], at[0]), max(b[3], at[1]), min(b[4], x1), min(b[5], y1), max(b[6], x2), max(b[7], y2)]
            return list(made.values())

        def settled() -> list[tuple]:
            return [(*page, b[0], b[1], b[2] - b[0] + 1, b[3] - b[1] + 1, *b[4:]) for b in boxes()]

        def cells_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], shown)

        for batch in batches:
            found = []
            table = zip(*(batch.column(k).to_pylist() for k in keyed))
            for now, kind, upright, row, column, x1, y1, x2, y2 in zip(table, *(batch.column(c).to_pylist() for c in ("_kind", "_upright", "row", "column", "x1", "y1", "x2", "y2"))):
                if now != page:
                    found += settled()
                    page, walls, lattice = now, {}, {}
                if kind == 0:
                    walls.setdefault((bool(upright), floor(x1 / (2 * slack))), []).append((x1, y1, y2))
                else:
                    lattice[row, column] = (x1, y1, x2, y2)
            if found:
                yield cells_of(found)
        if found := settled():
            yield cells_of(found)

    return _by_page(rows, keys, "_kind", "row", "column").mapInArrow(run, schema)


def grid_from_rules(items: DataFrame, rules: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """(keys, row, column, row_span, column_span, text): items (x, y, text) in the merged cells of the lattice of a page's rules.

    Items outside all cells belong to no table; cells without items have an empty text. Cells of one first row and
    column are one. A task holds the rules and items of some pages at once.
    """
    ruled = rules.groupBy(*keys).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("rules"))
    held = items.groupBy(*keys).agg(F.collect_list(F.struct("x", "y", F.col(order).alias("place"), "text")).alias("items"))
    return ruled_grids(ruled.join(held, list(keys), "left"), keys)


def ruled_grids(pages: DataFrame, keys: Sequence[str], slack: float = 0.5, least: float = 4.0, least_lines: int = 3) -> DataFrame:
    """grid_from_rules() of pages with rules (x1, y1, x2, y2) and items (x, y, place, text), arrays of structs.

    Boundaries and cells are those of layout.lattice, walls and merged cells those of merged_cells().
    """
    for key in keys:
        pages = pages.where(F.col(key).isNotNull())
    shape = StructType([*(pages.schema[k] for k in keys), *StructType.fromDDL("row int, column int, row_span int, column_span int, text string")])
    names = shape.names

    def count(groups: np.ndarray, values: np.ndarray, group: np.ndarray, value: np.ndarray, side: str) -> np.ndarray:
        """How many of the sorted values of earlier groups, or of the group and below (side left) or up to (right) a value, there are."""
        own = np.arange(len(groups) + len(group)) < len(groups)
        order = np.lexsort((own if side == "left" else ~own, np.concatenate([values, value]), np.concatenate([groups, group])))
        seen = np.cumsum(own[order])
        out = np.empty(len(order), np.int64)
        out[order] = seen
        return out[len(groups) :]

    def spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of rows of these sizes, and the places within them."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        return owner, np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]

    def grids(batch: pa.RecordBatch) -> list[pa.Array] | None:
        lists = [batch.column("rules"), batch.column("items")]
        owner, below = (np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(x), 0).to_numpy()) for x in lists)
        rules, items = (x.flatten() for x in lists)
        number = lambda rows, c: pc.fill_null(pc.cast(rows.field(c), pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
        x1, y1, x2, y2 = (number(rules, c) for c in ("x1", "y1", "x2", "y2"))
        width, height = np.abs(x2 - x1), np.abs(y2 - y1)
        # boundaries: groups are twice the page, and one more for those along x
        level, upright = (height <= slack) & (width >= least), (width <= slack) & (height >= least)
        long = level | upright
        group, at = (2 * owner + ~level)[long], np.where(level, y1, x1)[long]
        order = np.lexsort((at, group))
        group, at = group[order], at[order]
        first = np.arange(len(at))
        same = np.concatenate([[False], group[1:] == group[:-1]]) if len(at) else np.zeros(0, bool)
        for i in np.flatnonzero(same & (np.diff(at, prepend=0.0) <= slack)).tolist():
            if at[i] - at[first[i - 1]] <= slack:
                first[i] = first[i - 1]
        leads = first == np.arange(len(at))
        group, at = group[leads], at[leads]
        lines = np.bincount(group, minlength=2 * batch.num_rows)
        begins = np.cumsum(lines) - lines
        active = (lines[::2] >= least_lines) & (lines[1::2] >= least_lines)
        down, across = np.where(active, lines[::2] - 1, 0), np.where(active, lines[1::2] - 1, 0)
        page, place = spread(down * across)
        if not len(page):
            return None
        row, column = place // across[page], place % across[page]
        cell_of = np.cumsum(down * across) - down * across
        # walls: a rule covers the boundaries near it over the intervals whose middles it spans
        inner = np.flatnonzero(group[1:] == group[:-1])
        middles, of = (at[inner] + at[inner + 1]) / 2, group[inner]
        spans = np.maximum(lines - 1, 0)
        starts = np.cumsum(spans) - spans
        upright = width <= slack
        beside = np.where(upright, x1, y1)
        low, high = np.where(upright, np.fmin(y1, y2), np.fmin(x1, x2)), np.where(upright, np.fmax(y1, y2), np.fmax(x1, x2))
        rule = np.flatnonzero(active[owner] & ~np.isnan(beside) & ~np.isnan(low))
        own, other = 2 * owner[rule] + upright[rule], 2 * owner[rule] + ~upright[rule]
        beside, low, high = beside[rule], low[rule], high[rule]
        reach = 2 * slack * (1 + 1e-9)
        nearest = count(group, at, own, beside - reach, "left")
        hit, nth = spread(count(group, at, own, beside + reach, "right") - nearest)
        line = nearest[hit] + nth
        covers = np.abs(beside[hit] - at[line]) <= 2 * slack
        hit, line = hit[covers], line[covers]
        since, until = count(of, middles, other, low, "left")[hit], count(of, middles, other, high, "right")[hit]
        own, other, some = own[hit], other[hit], since < until
        sizes = lines * spans[np.arange(len(lines)) ^ 1]
        offset = np.cumsum(sizes) - sizes
        base = offset[own] + (line - begins[own]) * spans[other] - starts[other]
        total = int(sizes.sum()) + 1
        walls = np.cumsum(np.bincount((base + since)[some], minlength=total) - np.bincount((base + until)[some], minlength=total)) > 0
        right = np.flatnonzero(column < across[page] - 1)
        right = right[~walls[offset[2 * page[right] + 1] + (column[right] + 1) * down[page[right]] + row[right]]]
        under = np.flatnonzero(row < down[page] - 1)
        under = under[~walls[offset[2 * page[under]] + (row[under] + 1) * across[page[under]] + column[under]]]
        labels = lowest(np.arange(len(page)), np.concatenate([right, under]), np.concatenate([right + 1, under + across[page[under]]]))
        # merged cells: the box around each, those of one first row and column as one
        order = np.argsort(labels, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], labels[order][1:] != labels[order][:-1]]))
        top, left = np.minimum.reduceat(row[order], heads), np.minimum.reduceat(column[order], heads)
        bottom, far = np.maximum.reduceat(row[order], heads), np.maximum.reduceat(column[order], heads)
        home, merged = page[order][heads], np.empty(len(page), np.int64)
        merged[order] = np.cumsum(labels[order] != np.concatenate([[-1], labels[order][:-1]])) - 1
        odd = np.bincount(home, (bottom - top + 1) * (far - left + 1) != np.diff(np.append(heads, len(order))), batch.num_rows) > 0
        # items: in the cell that they lie in, and on pages with a cell that is no box in each box
        x, y = number(items, "x"), number(items, "y")
        known = np.flatnonzero(active[below] & ~np.isnan(x) & ~np.isnan(y))
        r, c = (count(group, at, 2 * below[known] + axis, v[known], "right") - begins[2 * below[known] + axis] - 1 for axis, v in ((0, y), (1, x)))
        inside = (r >= 0) & (c >= 0) & (r < down[below[known]]) & (c < across[below[known]])
        known, r, c = known[inside], r[inside], c[inside]
        target = merged[cell_of[below[known]] + r * across[below[known]] + c]
        if odd[below[known]].any():
            many = odd[below[known]]
            boxes = np.bincount(home, minlength=batch.num_rows)
            which, nth = spread(boxes[below[known[many]]])
            box = (np.cumsum(boxes) - boxes)[below[known[many]]][which] + nth
            row_, column_ = r[many][which], c[many][which]
            within = (top[box] <= row_) & (row_ <= bottom[box]) & (left[box] <= column_) & (column_ <= far[box])
            known, target = np.concatenate([known[~many], known[many][which][within]]), np.concatenate([target[~many], box[within]])
        _, head, named = np.unique(cell_of[home] + top * across[home] + left, return_index=True, return_inverse=True)
        tall, wide = np.zeros(len(head), np.int64), np.zeros(len(head), np.int64)
        np.maximum.at(tall, named, bottom - top + 1)
        np.maximum.at(wide, named, far - left + 1)
        held = items.take(pa.array(known))
        texts = _texts(named[target], _ranks(held.field("place")), held.field("text"), len(head))
        found = pa.array(home[head])
        return [*(batch.column(k).take(found) for k in keys), *(pa.array(v, pa.int32()) for v in (top[head], left[head], tall, wide)), texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if found := grids(batch):
                yield pa.RecordBatch.from_arrays(found, names)

    return pages.select(*keys, "rules", "items").mapInArrow(run, shape)


def grid_from_text(items: DataFrame, keys: Sequence[str], order: str, bucket: float = 3.0, least: int = 2, tab: float = 2.0) -> DataFrame:
    """(keys, row, column, text): a grid of items (x, y, width, size, text) on a page without rules.

    Lines are rows, from the top (y falls). A gap over tab em within a line starts a segment.
    Starts of segments that recur in a bucket of x on a page, at least so often, are its columns (all
    starts where none recurs), and each segment goes to the nearest, the first of equals. Pages with
    a null key are left out. Pages come one after the other, and a task holds the items of one.
    """
    number = lambda c: F.col(c).cast("double").alias(f"_{c}")
    at = (F.floor(F.col("x") / bucket + 0.5) * bucket).alias("_at")
    known = items.select("*", (-F.col("y")).alias("_down"), number("x"), number("y"), number("size"), F.coalesce("width", F.lit(0.0)).cast("double").alias("_width"), at)
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    within = lambda a, b: a is not None and b is not None and (a <= b or b != b)
    first = lambda v: (v is not None, v is not None and v != v, v)

    def cells(page: list[tuple]) -> dict[tuple[int, int], str]:
        leaders, lines, segments = [], [], []
        for item in page:
            y, size = item[1], item[2]
            reach = None if size is None else size * 0.5
            line = next((n for n, leader in enumerate(leaders) if None not in (leader, y) and within(abs(leader - y), reach)), len(leaders))
            if line == len(leaders):
                leaders.append(y)
                lines.append([])
            lines[line].append(item)
        for line, found in enumerate(lines):
            end = em = None
            for n, (x, _, size, width, start, place, text) in enumerate(sorted(found, key=lambda i: (first(i[0]), first(i[5])))):
                if not n or None not in (x, end, em) and not within(x - end, tab * em):
                    segments.append([line, None, None, []])
                if segments[-1][1] is None:
                    segments[-1][1:3] = x, start
                if text is not None:
                    segments[-1][3].append(text)
                end, em = None if x is None else x + width, size
        counts = Counter(start for _, _, start, _ in segments)
        columns = sorted((start for start, n in counts.items() if n >= least), key=first) or sorted(counts, key=first)
        texts: dict[tuple[int, int], list[str]] = {}
        for line, x, _, words in segments:
            apart = [None if x is None or start is None else abs(start - x) for start in columns]
            column = min(range(len(columns)), key=lambda n: first(apart[n]))
            texts.setdefault((line, column), []).append(" ".join(words))
        return {cell: " ".join(parts) for cell, parts in texts.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, held, rows = None, [], []

        def settled() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            table = zip(*(batch.column(k).to_pylist() for k in keys))
            for now, item in zip(table, zip(*(batch.column(c).to_pylist() for c in ("_x", "_y", "_size", "_width", "_at", "_place", "_text")))):
                if now != page:
                    if held:
                        rows += [(*page, *cell, text) for cell, text in cells(held).items()]
                    page, held = now, []
                    if len(rows) >= GRID_ROWS:
                        yield settled()
                        rows = []
                held.append(item)
        if held:
            rows += [(*page, *cell, text) for cell, text in cells(held).items()]
        if rows:
            yield settled()

    schema = StructType([*(items.schema[k] for k in keys), StructField("row", IntegerType()), StructField("column", IntegerType()), StructField("text", StringType())])
    names, types = schema.names, [to_arrow_type(f.dataType) for f in schema.fields]
    rest = [c for c in items.columns if c not in keys]
    return _by_page(known, keys, "_down", *rest).select(*keys, "_x", "_y", "_size", "_width", "_at", F.col(order).alias("_place"), F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)


def slide_blocks(lines: DataFrame, keys: Sequence[str], order: str, align: float = 2.0, leading: float = 1.25, points: float = 1.0, share: float = 0.15) -> DataFrame:
    """Add block: a line (x, y, size) joins the first block whose last line it follows, else opens one.

    It follows a line that is above it by at most leading times that line's size, starts within
    align of it and is close in size, by points or by a share of the larger. As a block's last
    line moves with each that joins, the lines of one page are folded in one row of arrays.
    """
    row = F.struct(*(F.col(c) for c in lines.columns)).alias("r")
    pages = lines.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), row))).alias("_rows"))
    last = "array<struct<x:double,y:double,size:double>>"
    start = F.struct(F.array().cast(last).alias("last"), F.array().cast("array<bigint>").alias("out"))

    def follows(end: Column, at: Column) -> Column:
        gap, apart = end["y"] - at["y"], F.abs(end["size"] - at["size"])
        close = (apart <= points) | (apart <= share * F.greatest(end["size"], at["size"]))
        return (gap > 0) & (gap <= leading * end["size"]) & (F.abs(end["x"] - at["x"]) <= align) & close

    def join(a: Column, item: Column) -> Column:
        at = F.struct(*(item["r"][c].cast("double").alias(c) for c in ("x", "y", "size")))
        hit = F.array_position(F.transform(a["last"], lambda end: F.coalesce(follows(end, at), F.lit(False))), True)
        moved = F.transform(a["last"], lambda end, i: F.when(i + 1 == hit, at).otherwise(end))
        block = F.when(hit > 0, hit - 1).otherwise(F.size(a["last"]))
        return F.struct(F.when(hit > 0, moved).otherwise(F.array_append(a["last"], at)).cast(last).alias("last"), F.array_append(a["out"], block.cast("long")).alias("out"))

    placed = pages.select("_rows", F.aggregate("_rows", start, join, lambda a: a["out"]).alias("_blocks"))
    listed = placed.select(F.explode(F.arrays_zip("_rows", "_blocks")).alias("z"))
    return listed.select("z._rows.r.*", F.col("z._blocks").alias("block"))
