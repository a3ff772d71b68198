import pytest
from pyspark.sql import functions as F

from quire.operators import reports

SALES = [("North", "Q1", "Acme Ltd", 1200.50), ("North", "Q1", "Bolt Supplies", 340.00), ("North", "Q2", "Crown Foods", 2750.25), ("South", "Q1", "Delta Print", 95.75), ("South", "Q2", "Everest Tools", 1810.00), ("West", "Q2", "Foxglove Design", 60.00)]


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(SALES)], "ord int, region string, quarter string, customer string, amount double")


def test_totals(sales):
    rows = reports.rollup_totals(sales.where("amount >= 100"), ["region", "quarter"], {"total": F.sum("amount")}).collect()
    got = {(r.region, r.quarter): r.total for r in rows}
    assert got == {("North", "Q1"): 1540.5, ("North", "Q2"): 2750.25, ("South", "Q2"): 1810.0, ("North", None): 4290.75, ("South", None): 1810.0, (None, None): 6100.75}
    assert reports.rollup_totals(sales.where("false"), ["region"], {"n": F.count("*")}).collect()[0].n == 0


def test_band_stream(sales):
    out = reports.bands(sales, ["region", "quarter"], {"total": F.sum("amount")}, ["customer", "ord"], ["ord"]).orderBy("band_order").collect()
    told = [(r.band, r.level, r.region, r.quarter, r.customer or r.total) for r in out]
    assert told[:6] == [
        ("report header", 0, None, None, 6256.5), ("group header", 1, "North", None, 4290.75), ("group header", 2, "North", "Q1", 1540.5), ("detail", 2, "North", "Q1", "Acme Ltd"),
        ("detail", 2, "North", "Q1", "Bolt Supplies"), ("group footer", 2, "North", "Q1", 1540.5),
    ]
    assert told[-4:] == [("detail", 2, "West", "Q2", "Foxglove Design"), ("group footer", 2, "West", "Q2", 60.0), ("group footer", 1, "West", None, 60.0), ("report footer", 0, None, None, 6256.5)]
    shown = reports.band_text(reports.bands(sales, ["region"], {"total": F.sum("amount")}, [], []), ["total"]).where("band = 'report footer'").first()
    assert shown.text == "total=6256.5"
    empty = reports.bands(sales.where("false"), ["region"], {"total": F.sum("amount")}, [], []).orderBy("band_order").collect()
    assert [(r.band, r.total) for r in empty] == [("report header", None), ("report footer", None)]


def test_break_cascade(spark):
    rows = [(1, "x", "p", 1, 10), (2, "x", "p", 1, 20), (3, "x", "p", 2, 30), (4, "x", "q", 2, 40), (5, "y", "q", 2, 50)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "ord int, a string, b string, c int, v int, part int")
    ids = reports.break_ids(df, ["a", "b", "c"], ["ord"], ["part"])
    out = reports.scoped(ids, {"inner": F.sum("v")}, ["part"], 3)
    out = reports.scoped(out, {"outer": F.sum("v")}, ["part"], 1).orderBy("ord").collect()
    assert [(r.group_1, r.group_2, r.group_3) for r in out] == [(1, 1, 1), (1, 1, 1), (1, 1, 2), (1, 2, 3), (2, 3, 4)]
    assert [r.inner for r in out] == [30, 30, 30, 40, 50] and [r.outer for r in out] == [100, 100, 100, 100, 50]


def test_null_equals_null_and_left(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "é😀x")], "ord int, t string").withColumn("p", F.lit(0))
    out = reports.break_ids(df, ["t"], ["ord"], ["p"]).withColumn("l", reports.left(F.col("t"), 2)).orderBy("ord").collect()
    assert [r.break_1 for r in out] == [True, False, True] and [r.l for r in out] == [None, None, "é😀"]
    with pytest.raises(reports.BadReport):
        reports.rollup_totals(df, ["t", "t"], {})
