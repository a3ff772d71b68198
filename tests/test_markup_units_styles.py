from pyspark.sql import functions as F

from quire.functions import markup, units
from quire.operators import styles


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first().x


def test_references(spark):
    text = "a < b & 'c' > \"d\" &amp;"
    assert one(spark, text, markup.escape) == "a &lt; b &amp; &apos;c&apos; &gt; &quot;d&quot; &amp;amp;"
    assert one(spark, text, lambda c: markup.unescape(markup.escape(c))) == text


def test_links(spark):
    got = one(spark, r'see [a\]b](http://x.y/z "T") and ![pic](<i.png>) not [c] (d)', markup.links)
    assert [tuple(x) for x in got] == [(False, "a]b", "http://x.y/z", "T"), (True, "pic", "i.png", None)]
    assert one(spark, "go to www.a.org/b, https://c.d. or mail e.f@g.hi.", markup.autolinks) == ["http://www.a.org/b", "https://c.d", "mailto:e.f@g.hi"]


def test_units(spark):
    assert one(spark, "2.54cm", units.parse_length) == 72 and one(spark, "x", units.parse_length) is None
    assert tuple(one(spark, "#ff0080", units.parse_colour))[:2] == (1.0, 0.0)
    row = spark.range(1).select(units.colour(F.lit(1.0), F.lit(0.5), F.lit(-1.0)).alias("c"), units.convert(F.lit(1.0), "in", "twip").alias("t"), units.heading_level(F.lit(9.5)).alias("h")).first()
    assert (row.c, round(row.t), row.h) == ("#ff8000", 1440, 6)


def test_chain_of_styles(spark):
    rows = [(f"s{i}", f"s{i - 1}" if i else None, "top" if i == 0 else None, "mid" if i == 5 else None) for i in range(20)] + [("x", "missing", None, None), ("a", "b", None, "1"), ("b", "a", "2", None)]
    table = spark.createDataFrame(rows, "id string, up string, face string, size string")
    got = {r.id: (r.face, r.size) for r in styles.inherit(table, "id", "up", ["face", "size"]).collect()}
    assert got["s19"] == ("top", "mid") and got["s4"] == ("top", None) and got["x"] == (None, None) and got["a"] == ("2", "1")
    body = spark.createDataFrame([(1, "s0", None), (2, "s0", "own"), (3, None, None)], "n int, style string, face string")
    assert sorted((r.n, r.face) for r in styles.overlay(body, table, "style", "id", ["face"]).collect()) == [(1, "top"), (2, "own"), (3, None)]
    assert [tuple(r) for r in styles.common_tuples(body, [], ["style"], "n").collect()] == [("s0", 2, 1)]
