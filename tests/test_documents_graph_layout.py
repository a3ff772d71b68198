import hashlib

from pyspark.sql import functions as F

from quire.operators import documents, graph, layout
from quire.operators.components import components


def test_markdown_blocks(spark):
    text = "# Title\nfirst line\nsecond line\n\n> quote\nlazy\n\n- item\n  more\n- next\n\n```py\n# not a heading\n\n```\n***\n| a | b |\n|---|---|\n    code\n## Sub"
    out = documents.markdown_blocks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")).where("doc = 1").orderBy("first_line").collect()
    assert [(r.kind, r.level, r.n_lines) for r in out] == [
        ("heading", 1, 1), ("paragraph", None, 2), ("blockquote", None, 2), ("listItem", None, 2), ("listItem", None, 1), ("codeBlock", None, 4), ("thematicBreak", None, 1), ("tableRow", None, 2),
        ("codeBlock", None, 1), ("heading", 2, 1),
    ]
    assert out[5].text == "```py\n# not a heading\n\n```"


def test_outline(spark):
    levels = [1, None, 2, None, 3, 2, 1, None]
    df = spark.createDataFrame([("d", i, n) for i, n in enumerate(levels)], "doc string, ord int, level int")
    assert [r.parent for r in documents.outline(df, "doc", "ord", "level").orderBy("ord").collect()] == [None, 0, 0, 2, 2, 0, None, 6]


def test_marks(spark):
    steps = {"good": [1, 1, -1, 1, -1, -1], "bad": [1, -1, -1, 1], "open": [1]}
    df = spark.createDataFrame([(d, i, s) for d, x in steps.items() for i, s in enumerate(x)], "doc string, ord int, step int")
    assert {r.doc: r.balanced for r in documents.balanced(df, "doc", "ord", "step").collect()} == {"good": True, "bad": False, "open": False}
    pairs = documents.pairs_of_marks(df.where("doc = 'good'"), "doc", "ord", "step").collect()
    assert sorted((r.start, r.end) for r in pairs) == [(0, 5), (1, 2), (3, 4)]


def test_leaves_and_sections(spark):
    df = spark.createDataFrame([("d", 0, "p"), ("d", 1, "h"), ("d", 2, "h"), ("d", 3, "p")], "doc string, ord int, text string")
    rows = documents.leaves(df, "doc", "ord", "text").orderBy("ordinal").collect()
    assert rows[1].source_path == "blocks[1]" and rows[1].leaf_hash == rows[2].leaf_hash == hashlib.sha256(b"h").hexdigest()
    out = documents.sections_at(df, "doc", "ord", F.col("text") == "h").orderBy("ord").collect()
    assert [r.section for r in out] == [0, 1, 2, 2]


def test_content_hash_and_dedup(spark):
    df = spark.createDataFrame([(2, "a", None), (1, "a", None), (3, "b", 1)], "ord int, t string, n int")
    out = df.select("ord", graph.content_hash({"t": F.col("t"), "n": F.col("n")}).alias("id"))
    ids = {r.ord: r.id for r in out.collect()}
    assert ids[1] == hashlib.sha256(b'{"t":"a"}').hexdigest() and ids[3] == hashlib.sha256(b'{"n":1,"t":"b"}').hexdigest()
    assert sorted(r.ord for r in graph.first_of_each(out, "id", "ord").collect()) == [1, 3]


def test_walk_guards_cycles_and_revisits(spark):
    edges = spark.createDataFrame([("a", "b", "1"), ("a", "c", "2"), ("b", "d", "1"), ("c", "d", "1"), ("d", "a", "1")], "from_id string, to_id string, order_key string")
    out = graph.walk(edges, spark.createDataFrame([("a",)], "node string")).orderBy("keys").collect()
    assert [r.node for r in out] == ["a", "b", "d", "c", "d"] and max(r.depth for r in out) == 2


def test_merkle_ids_are_equal_for_equal_subtrees(spark):
    rows = [(d, s, leaf) for d in (1, 2) for s, leaf in ((1, "x"), (2, "y"))] + [(3, 1, "x"), (3, 2, "z")]
    inner, outer = graph.merkle_ids(spark.createDataFrame(rows, "doc int, sec int, leaf string"), ["doc", "sec"], "leaf")
    ids = {r.doc: r.id for r in outer.collect()}
    assert ids[1] == ids[2] != ids[3] and inner.select("id").distinct().count() == 3


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, 5), (5, 6), (9, 9), (None, 1)]
    found = {r.node: r.component for r in components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert {found[i] for i in range(100, 161)} == {100} and found[6] == found[7] == 5 and found[9] == 9 and None not in found
    assert components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_layout(spark):
    df = spark.createDataFrame([("p", s) for s in (10.0, 10.4, 12.0, 10.0, 14.0, 20.0)], "page string, size double")
    assert tuple(layout.modes(df, ["page"], "size").first()) == ("p", 10.0, 3)
    assert sorted((r.size, r.level) for r in layout.heading_levels(df, ["page"], "size").collect()) == [(12.0, 3), (14.0, 2), (20.0, 1)]
    ys = [0.0, 4.0, 8.0, 0.5, 30.0]
    items = spark.createDataFrame([("p", i, y, 10.0) for i, y in enumerate(ys)], "page string, ord int, y double, size double")
    assert [r.line for r in layout.lines_by_leader(items, ["page"], "y", "size", "ord").orderBy("ord").collect()] == [0, 0, 1, 0, 2]
    spans = spark.createDataFrame([("k", 0, 5), ("k", 3, 4), ("k", 5, 7), ("k", 9, 10)], "k string, s int, e int")
    assert sorted((r.s, r.e, r.n) for r in layout.merge_intervals(spans, ["k"], "s", "e").collect()) == [(0, 7, 3), (9, 10, 1)]
    points = spark.createDataFrame([("k", v) for v in (0.0, 4.9, 5.0, 11.0, 30.0)], "k string, v double")
    bounds = spark.createDataFrame([("k", 0.0, 5.0), ("k", 5.0, 12.0)], "k string, low double, high double")
    assert sorted((r.v, r.low) for r in layout.assign_to_grid(points, bounds, ["k"], "v", "low", "high", 4.0).collect()) == [(0.0, 0.0), (4.9, 0.0), (5.0, 5.0), (11.0, 5.0)]


def test_lattice(spark):
    level = [(0.0, y, 100.0, y) for y in (0.0, 0.4, 0.8, 20.0, 40.0)]
    upright = [(x, 0.0, x, 40.0) for x in (0.0, 50.0, 100.0)]
    odd = [(0.0, 0.0, 3.0, 0.0), (0.0, 0.0, 50.0, 40.0)]
    rules = spark.createDataFrame([("p", *map(float, r)) for r in level + upright + odd] + [("q", 0.0, 1.0, 90.0, 1.0)], "page string, x1 double, y1 double, x2 double, y2 double")
    assert [r.at for r in layout.boundaries(rules, ["page"]).where("page = 'p' AND axis = 'y'").orderBy("n").collect()] == [0.0, 0.8, 20.0, 40.0]
    cells = layout.lattice(rules, ["page"]).collect()
    assert {(r.row, r.column) for r in cells} == {(r, c) for r in range(3) for c in range(2)} and {r.page for r in cells} == {"p"}
