import pytest
from pyspark.sql import functions as F

from quire.functions import cells, markup, sheets
from quire.operators import documents, joins, layout, styles


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_cells_by_their_spelling(spark):
    texts = ["1234567890123456", "12345678901234567891", "0.1234567890123456", "-0", "15-Jan-2024", "January 15 2024", "$-5", "-$5.50", "1,234.5", "1,234", "01,234,567", "12 Marble 2024"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", cells.infer_cell(F.col("t")).alias("c")).orderBy("i").collect()
    assert [(r.c.kind, r.c.num, r.c.text) for r in rows] == [
        ("number", 1234567890123456.0, None), ("string", None, texts[1]), ("number", 0.1234567890123456, None), ("string", None, "-0"), ("date", None, "2024-01-15"), ("date", None, "2024-01-15"),
        ("currency", -5.0, None), ("currency", -5.5, None), ("number", 1234.5, None), ("string", None, "1,234"), ("string", None, "01,234,567"), ("string", None, "12 Marble 2024"),
    ]


def test_ranges_lists_and_decimals(spark):
    r = one(spark, sheets.parse_range(F.lit("D5:$B$2")))
    assert (r.top, r.left, r.bottom, r.right) == (1, 1, 4, 3)
    assert one(spark, sheets.parse_range(F.lit("B2"))).right == 1 and one(spark, sheets.parse_range(F.lit("B2:x"))) is None
    assert one(spark, sheets.index_to_letters(F.lit(702))) == "AAA" and one(spark, sheets.index_to_letters(F.lit(-1))) is None
    assert tuple(one(spark, markup.parse_list_id(F.lit("md2:ordered@3+task")))) == ("ordered", 3, True, False)
    assert one(spark, markup.parse_list_id(F.lit("list1"))) is None
    assert [str(one(spark, sheets.unscaled(F.lit(d), 2))) for d in ("5", "-5", "12345")] == ["0.05", "-0.05", "123.45"]


def test_as_of_and_nearest_on_ties_and_nulls(spark):
    left = spark.createDataFrame([(1, 5), (1, 0), (2, 3), (1, None)], "k int, at int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 2, "c"), (2, None, "d")], "k int, at int, v string")
    got = {(r.k, r.at): r.v_as_of for r in joins.as_of(left, right, ["k"], "at", ["v"]).collect()}
    assert got == {(1, 5): "b", (1, 0): None, (2, 3): None, (1, None): None}
    near = {(r.k, r.at): (r.nearest, r.distance) for r in joins.nearest(left.where("at IS NOT NULL"), right, ["k"], "at", "v").collect()}
    assert near == {(1, 5): ("b", 0.0), (1, 0): ("c", 2.0), (2, 3): (None, None)}


def test_trees(spark):
    nodes = spark.createDataFrame([("a", None, 0), ("b", "a", 1), ("c", "b", 0), ("d", "gone", 2)], "id string, up string, n int")
    assert {r.id: r.path for r in documents.flatten(nodes, "id", "up", "n").collect()} == {"a": [0], "b": [0, 1], "c": [0, 1, 0], "d": [2]}
    ring = spark.createDataFrame([("a", "b", 0), ("b", "a", 0)], "id string, up string, n int")
    with pytest.raises(ValueError, match="cycle"):
        documents.flatten(ring, "id", "up", "n")
    with pytest.raises(ValueError, match="cycle"):
        styles.chain_edges(ring.select(F.col("id").alias("row"), F.lit("a").alias("ref")), "ref", ring, "id", "up")
    marked = nodes.withColumn("is", F.col("id") == "a")
    assert {r.id: r.ancestor for r in joins.nearest_ancestor(marked, "id", "up", "is").collect()} == {"a": "a", "b": "a", "c": "a", "d": None}
    with pytest.raises(ValueError, match="2 times"):
        joins.require_unique(nodes.union(nodes.limit(1)), "id")


def test_bands_and_paint_order(spark):
    rows = spark.createDataFrame([(1, 1, 4.0, False), (1, 2, 7.0, False), (1, 3, 50.0, False), (1, 4, 1.0, False), (1, 5, 1.0, True)], "s int, o int, size double, b boolean")
    assert [r.band for r in layout.page_bands(rows, ["s"], "o", "size", 10.0, "b").orderBy("o").collect()] == [0, 1, 2, 3, 4]
    made = "page int, z int, n int"
    vectors, shapes = spark.createDataFrame([(1, 3, 1), (1, 1, 2), (2, 9, 1)], made), spark.createDataFrame([(1, 2, 3), (1, 3, 4), (2, None, 2)], made)
    got = layout.paint_order(vectors, shapes, "page", "z", "n").orderBy("page", "place").collect()
    assert [(r.page, r.n) for r in got] == [(1, 2), (1, 3), (1, 1), (1, 4), (2, 1), (2, 2)]
