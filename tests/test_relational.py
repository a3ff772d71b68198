import datetime

import pytest
from pyspark.sql import functions as F

from quire.functions.cells import ClassMismatch
from quire.operators import relational as rel


@pytest.fixture(scope="module")
def employees(spark):
    day = datetime.date.fromisoformat
    rows = [
        (1, "Alice", "Sales", 1000.0, True, day("2024-01-15")), (2, "Bob", "Sales", None, False, day("2024-03-01")), (3, "Carol", "Eng", 2000.0, True, None),
        (4, "Dave", "Eng", 1500.0, None, day("2023-07-04")), (5, "Erin", None, 500.0, True, day("2022-12-31")), (6, "Frank", None, 750.0, False, None),
    ]
    return spark.createDataFrame(rows, "ord int, NAME string, DEPT string, SALARY double, ACTIVE boolean, HIRED date")


def names(df):
    return [r.NAME for r in df.collect()]


def test_null_placement_and_stability(employees):
    pick = lambda *order: names(rel.select(employees, ["NAME"], order_by=order, input_order=["ord"]))
    assert pick(("SALARY", "ASC")) == ["Erin", "Frank", "Alice", "Dave", "Carol", "Bob"]
    assert pick(("SALARY", "DESC")) == ["Bob", "Carol", "Dave", "Alice", "Frank", "Erin"]
    assert pick(("DEPT", "ASC")) == ["Carol", "Dave", "Alice", "Bob", "Erin", "Frank"]
    assert pick(("DEPT", "DESC"), ("name", "DESC")) == ["Frank", "Erin", "Bob", "Alice", "Dave", "Carol"]


def test_groups_come_in_order_of_appearance(employees):
    made = [("COUNT", "*"), ("COUNT", "SALARY"), ("SUM", "SALARY"), ("AVG", "SALARY"), ("MIN", "SALARY"), ("MAX", "SALARY")]
    out = rel.select(employees, ["DEPT", *made], group_by=["dept"], input_order=["ord"])
    assert out.columns[1] == "COUNT(*)"
    assert [tuple(r) for r in out.collect()] == [("Sales", 2, 1, 1000, 1000, 1000, 1000), ("Eng", 2, 2, 3500, 1750, 1500, 2000), (None, 2, 2, 1250, 625, 500, 750)]


def test_global_aggregate_of_nothing(employees):
    row = rel.select(employees, [("COUNT", "*"), ("SUM", "SALARY"), ("MIN", "NAME")], F.lit(False)).first()
    assert tuple(row) == (0, None, None)


def test_three_valued_logic(employees):
    where = lambda c: names(rel.select(employees, ["NAME"], c, input_order=["ord"]))
    assert where(rel.compare(employees, "SALARY", "<>", 1000)) == ["Carol", "Dave", "Erin", "Frank"]
    assert where(rel.in_list(employees, "DEPT", ["Eng", None], negate=True)) == []
    assert where(rel.compare(employees, "ACTIVE", "=", True) | rel.compare(employees, "DEPT", "=", "Eng")) == ["Alice", "Carol", "Dave", "Erin"]
    assert where(rel.between(employees, "HIRED", "2023-01-01", "2024-01-31")) == ["Alice", "Dave"]
    assert where(~rel.between(employees, "SALARY", 700, 1600)) == ["Carol", "Erin"]


def test_like_takes_all_else_literally(spark):
    df = spark.createDataFrame([("a.c",), ("abc",), ("a+c",), ("a\\c",), ("A.C",)], "VALUE string")
    like = lambda p: sorted(r.VALUE for r in df.where(rel.like(df, "VALUE", p)).collect())
    assert like("a.c") == ["a.c"] and like("a_c") == ["a+c", "a.c", "a\\c", "abc"] and like("a\\c") == ["a\\c"] and like("%b%") == ["abc"]


def test_refusals(spark, employees):
    with pytest.raises(ClassMismatch):
        rel.compare(employees, "SALARY", "=", "1000")
    with pytest.raises(ClassMismatch):
        rel.like(employees, "SALARY", "1%")
    with pytest.raises(rel.NotAggregated):
        rel.select(employees, ["NAME", ("COUNT", "*")], group_by=["DEPT"])
    with pytest.raises(rel.NotAggregated):
        rel.select(employees, [("SUM", "NAME")])
    with pytest.raises(rel.NotAggregated):
        rel.select(employees, [("SUM", "*")])
    with pytest.raises(rel.UnknownName, match="NAME"):
        rel.resolve(employees, "nope")
    both = ["Value", "value"]

    class Two:
        columns = both

    with pytest.raises(rel.UnknownName, match="ambiguous"):
        rel.resolve(Two, "VALUe")
    assert rel.resolve(Two, "value", quoted=True) == "value"


def test_text_sorts_by_utf16_units(spark):
    df = spark.createDataFrame([("￿",), ("\U0001f600",), ("a",)], "t string")
    assert [r.t for r in df.orderBy(*rel.order_columns(df, [("t", "ASC")])).collect()] == ["a", "\U0001f600", "￿"]
