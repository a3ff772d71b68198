"""Tables and blocks of pages against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from quire import catalog
from quire.operators import joins, layout, tables

catalog.load()


def occupied(rows):
    """Places of cells (down, across) by rows: first free column, row by row."""
    taken, out = set(), {}
    for r, cells in enumerate(rows):
        c = 0
        for n, (down, across) in enumerate(cells):
            while any((r, c + i) in taken for i in range(across)):
                c += 1
            down = min(down, len(rows) - r)
            taken |= {(r + j, c + i) for j in range(down) for i in range(across)}
            out[r, n] = (r, c, down, across)
            c += across
    return out


def test_spans_take_the_first_free_places(spark):
    rng = random.Random(4)
    made = {t: [[(rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 2])) for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 6))] for t in range(12)}
    cells = [(t, r * 10, n, down, across) for t, rows in made.items() for r, row in enumerate(rows) for n, (down, across) in enumerate(row)]
    df = spark.createDataFrame(cells, "t int, row int, n int, down int, across int")
    found = {(x.t, x.row // 10, x.n): (x.row_index, x.column_index, x.row_span, x.column_span) for x in tables.place_cells(df, ["t"], "row", "n", "down", "across").collect()}
    assert found == {(t, *k): v for t, rows in made.items() for k, v in occupied(rows).items()}
    plain = {(x.t, x.row // 10, x.n): (x.row_index, x.column_index) for x in tables.place_cells(df, ["t"], "row", "n").collect()}
    assert plain == {k: (k[1], k[2]) for k in found}


def test_tagged_tables_ignore_what_is_not_in_a_cell(spark):
    nodes = [("p", "t", None, "Table", 0), ("p", "r", "t", "TR", 0), ("p", "c", "r", "TD", 1), ("p", "s", "c", "Span", 0), ("p", "e", "r", "TH", 0), ("p", "x", None, "P", 0), ("p", "lost", "x", "TD", 0)]
    items = [("p", "s", 2, 5.0, 10.0, "b"), ("p", "c", 1, 4.0, None, "a"), ("p", "x", 0, 0.0, 1.0, "no"), ("p", "lost", 0, 0.0, 1.0, "no")]
    cells, columns = tables.tagged_tables(spark.createDataFrame(nodes, "page string, id string, parent string, type string, place int"), spark.createDataFrame(items, "page string, node string, place int, x double, width double, text string"), "page")
    assert sorted(map(tuple, cells.collect())) == [("p", "t", 0, 0, 1, 1, ""), ("p", "t", 0, 1, 1, 1, "a b")]
    assert sorted(map(tuple, columns.collect())) == [("p", "t", 0, 40.0), ("p", "t", 1, 11.0)]


def test_tables_over_many_batches_take_few_exchanges(spark):
    """Tables inside cells, a cycle, a missing parent and a null page, with batches that cut pages and tables."""
    nodes, items = [], []
    for p in range(7):
        for t in range(3):
            top = f"t{t}"
            nodes += [(p, top, None if t < 2 else "d1-1-0", "Table", 0, 1), (p, f"b{t}", top, "TBody", 0, 1)]
            for r in range(4):
                nodes.append((p, f"r{t}-{r}", f"b{t}", "TR", r, 1))
                nodes += [(p, f"d{t}-{r}-{c}", f"r{t}-{r}", "TD", c, 1 + (r + c) % 2) for c in range(2)]
                items += [(p, f"d{t}-{r}-{c}", 0, float(c), 1.0, f"{p}{t}{r}{c}") for c in range(2)]
        nodes += [(p, "u", "v", "TD", 0, 1), (p, "v", "u", "TR", 0, 1), (p, "w", "none", "TD", 0, 1)]
        items += [(p, "u", 0, 0.0, 1.0, "no"), (p, "w", 0, 0.0, 1.0, "no")]
    nodes.append((None, "d", None, "TD", 0, 1))
    tree = spark.createDataFrame(nodes, "page int, id string, parent string, type string, place int, across int")
    texts = spark.createDataFrame(items, "page int, node string, place int, x double, width double, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        cells, _ = tables.tagged_tables(tree, texts, "page", None, "across")
        found = {(c.page, c.table, c.row_index, c.column_index): (c.column_span, c.text) for c in cells.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    expected = {(p, f"t{t}", r, 0 if c == 0 else 1 + r % 2): (1 + (r + c) % 2, f"{p}{t}{r}{c}") for p in range(7) for t in range(3) for r in range(4) for c in range(2)}
    assert found == expected
    plan = cells._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") <= 3 and "FlatMapGroupsInArrow" not in plan


def test_tagged_queries_deal_lines_by_order_and_page_once(spark):
    """Before, each kind of node and item was a branch with shuffles of its own, and texts went through three more."""
    for name in ("tables_tagged_cells", "tables_tagged_columns"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 3 and plan.count("FileScan parquet") == 2


def test_one_id_twice_and_equal_places(spark):
    """The last node of an id counts with the largest spans, items of one place come by text, and those without text are left out."""
    nodes = [("t", None, "Table", 0, None), ("r", "t", "TR", 0, None), ("c", "r", "TD", 0, 3), ("c", "r", "TD", 0, 1), ("d", "r", "TD", 1, None), (None, "r", "TD", 2, None)]
    tree = spark.createDataFrame([(1, *n) for n in nodes], "page int, id string, parent string, type string, place int, across int").coalesce(1)
    items = spark.createDataFrame([(1, "c", 0, None, 1.0, "b"), (1, "c", 0, 2.0, None, "a"), (1, "c", 1, 3.0, 4.0, None), (2, "c", 0, 1.0, 1.0, "off"), (1, None, 0, 1.0, 1.0, "off")], "page int, node string, place int, x double, width double, text string")
    cells, columns = tables.tagged_tables(tree, items, "page", None, "across")
    assert sorted(map(tuple, cells.collect())) == [(1, "t", 0, 0, 1, 3, "a b"), (1, "t", 0, 3, 1, 1, "")]
    assert sorted(map(tuple, columns.collect())) == [(1, "t", 0, 5.0), (1, "t", 3, 40.0)]


def test_cells_without_a_wall_are_one(spark):
    # three by three; the middle row is open to the right, and the first column open downwards from there
    walls = [(0, 0, 90, 0), (0, 90, 90, 90), (0, 0, 0, 90), (90, 0, 90, 90), (0, 30, 90, 30), (30, 60, 90, 60), (30, 0, 30, 30), (60, 0, 60, 30), (30, 60, 30, 90), (60, 60.2, 60, 90)]
    rules = spark.createDataFrame([(1, *map(float, w)) for w in walls], "page int, x1 double, y1 double, x2 double, y2 double")
    found = tables.merged_cells(layout.lattice(rules, ["page"]), rules, ["page"]).collect()
    assert sorted((r.row, r.column, r.row_span, r.column_span) for r in found) == [(0, 0, 1, 1), (0, 1, 1, 1), (0, 2, 1, 1), (1, 0, 2, 3), (2, 1, 1, 1), (2, 2, 1, 1)]
    items = spark.createDataFrame([(1, 10.0, 70.0, 2, "low"), (1, 80.0, 40.0, 1, "right"), (1, 40.0, 10.0, 3, "top"), (1, 200.0, 10.0, 4, "off")], "page int, x double, y double, n int, text string")
    texts = {(r.row, r.column): r.text for r in tables.grid_from_rules(items.where("text <> 'low'"), rules, ["page"], "n").collect()}
    assert texts[1, 0] == "right" and texts[0, 1] == "top" and texts[0, 0] == ""


def test_merged_cells_where_all_sides_are_dealt_by_page(spark):
    """Many pages whose rules and items come out of aggregations by page, and a plan without rounds of components."""
    pages = spark.range(3000).selectExpr("id AS page", "explode(sequence(0, 6)) AS n").groupBy("page").agg(F.collect_set("n").alias("ns"))
    lines = [(0, 0, 30, 0), (0, 10, 30, 10), (0, 20, 30, 20), (0, 0, 0, 20), (10, 0, 10, 20), (20, 0, 20, 10), (30, 0, 30, 20)]
    walls = "array(" + ", ".join("named_struct('x1', {}D, 'y1', {}D, 'x2', {}D, 'y2', {}D)".format(*w) for w in lines) + ")"
    rules = pages.selectExpr("page", f"inline({walls})")
    items = pages.selectExpr("page", "25D AS x", "explode(array(5D, 15D)) AS y", "0 AS n", "'t' AS text")
    grid = tables.grid_from_rules(items, rules, ["page"], "n")
    spans = {(r.row, r.column, r.row_span, r.column_span, r.text): r["count"] for r in grid.groupBy("row", "column", "row_span", "column_span", "text").count().collect()}
    assert spans == {(0, 0, 1, 1, ""): 3000, (0, 1, 1, 1, ""): 3000, (0, 2, 1, 1, "t"): 3000, (1, 0, 1, 1, ""): 3000, (1, 1, 1, 2, "t"): 3000}
    assert "quire/" not in grid._jdf.queryExecution().executedPlan().toString()


def test_grid_queries_deal_lines_once(spark):
    """Before, every kind of rule and text was a branch with shuffles of its own."""
    plan = catalog.QUERIES["grid_merged_cells"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan parquet") == 1


def test_an_item_in_the_notch_of_a_cell_is_in_both(spark):
    walls = [(0, 0, 20, 0), (0, 20, 20, 20), (0, 0, 0, 20), (20, 0, 20, 20), (10, 10, 10, 20), (10, 10, 20, 10.3)]
    rules = spark.createDataFrame([(p, *map(float, w)) for p in (1, 2) for w in walls if p == 1 or w[0] != 10], "page int, x1 double, y1 double, x2 double, y2 double")
    items = spark.createDataFrame([(1, 15.0, 15.0, 2, "notch"), (1, 5.0, 5.0, 2, "b"), (1, 5.0, 15.0, 2, "a"), (1, 5.0, 16.0, None, "first"), (1, 20.0, 5.0, 0, "off"), (2, 1.0, 1.0, 0, "no lattice")], "page int, x double, y double, n int, text string")
    found = sorted(map(tuple, tables.grid_from_rules(items, rules, ["page"], "n").collect()))
    assert found == [(1, 0, 0, 2, 2, "first a b notch"), (1, 1, 1, 1, 1, "notch")]


def blocks(lines):
    out, ends = [], []
    for x, y, size in lines:
        for k, (ex, ey, es) in enumerate(ends):
            if 0 < ey - y <= 1.25 * es and abs(x - ex) <= 2 and (abs(es - size) <= 1 or abs(es - size) / max(es, size) <= 0.15):
                break
        else:
            k = len(ends)
            ends.append(None)
        ends[k] = (x, y, size)
        out.append(k)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_slide_blocks_follow_their_last_line(spark, seed):
    rng = random.Random(seed)
    pages = {p: [(float(rng.choice([50, 51, 53, 200])), 400.0 - 7 * k - rng.choice([0, 0, 6]), float(rng.choice([10, 11, 14]))) for k in range(40)] for p in range(5)}
    df = spark.createDataFrame([(p, k, *v) for p, rows in pages.items() for k, v in enumerate(rows)], "page int, k int, x double, y double, size double")
    found = {(r.page, r.k): r.block for r in tables.slide_blocks(df, ["page"], "k").collect()}
    assert found == {(p, k): b for p, rows in pages.items() for k, b in enumerate(blocks(rows))}


def test_columns_of_text_recur(spark):
    rows = [(1, 0, 10.0, 100.0, "a"), (1, 1, 12.0, 100.0, "b"), (1, 2, 70.4, 100.0, "c"), (1, 3, 9.4, 80.0, "d"), (1, 4, 70.0, 80.0, "e"), (1, 5, 40.0, 60.0, "f"), (2, 0, 33.0, 50.0, "alone")]
    df = spark.createDataFrame([(p, n, x, y, 1.0, 10.0, t) for p, n, x, y, t in rows], "page int, n int, x double, y double, width double, size double, text string")
    found = sorted((r.page, r.row, r.column, r.text) for r in tables.grid_from_text(df, ["page"], "n").collect())
    assert found == [(1, 0, 0, "a b"), (1, 0, 1, "c"), (1, 1, 0, "d"), (1, 1, 1, "e"), (1, 2, 1, "f"), (2, 0, 0, "alone")]


def test_grid_from_text_deals_its_items_once(spark):
    """Before, lines, segments and columns took several shuffles and sorts each, and segments were made twice."""
    rows = [(1, 0, None, 100.0, "a"), (1, 1, 12.0, 100.0, None), (1, 2, 70.0, 98.0, "c"), (1, 3, 70.0, None, "d"), (None, 0, 1.0, 1.0, "e")]
    df = spark.createDataFrame([(p, n, x, y, 1.0, 10.0, t) for p, n, x, y, t in rows], "page int, n int, x double, y double, width double, size double, text string")
    found = tables.grid_from_text(df, ["page"], "n")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert sorted((r.row, r.column, r.text) for r in found.collect()) == [(0, 0, "d"), (1, 0, "a c")]


@pytest.mark.parametrize(("ys", "sizes", "expected"), [([100, 90, 80, 69.6, 50], [9] * 5, 10.0), ([100, 90, 79, 67], [9] * 4, 10.0), ([100, 40], [11, 11], 13.2), ([100, 89.6, 79.2, 50], [9] * 4, 10.5)])
def test_line_spacing(spark, ys, sizes, expected):
    df = spark.createDataFrame([("p", k, float(y), float(s)) for k, (y, s) in enumerate(zip(ys, sizes))], "page string, k int, y double, size double")
    assert layout.line_spacing(df, ["page"], "y", "size", "k").collect()[0].spacing == pytest.approx(expected)


def test_nearest_is_linear_and_right(spark):
    rng = random.Random(1)
    left, right = [rng.randint(0, 4000) for _ in range(2000)], [rng.randint(0, 4000) for _ in range(300)]
    a = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(left)], "k int, i int, at double")
    b = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(right)], "k int, v int, at double")
    for r in joins.nearest(a, b, ["k"], "at", "v").collect():
        assert r.distance == min(abs(r.at - x) for x in right) == abs(r.at - right[r.nearest])
    many = spark.range(200_000).selectExpr("1 AS k", "id AS i", "double(id * 7 % 200003) AS at")
    assert joins.nearest(many, many.withColumnRenamed("i", "v"), ["k"], "at", "v").where("distance = 0").count() == 200_000
