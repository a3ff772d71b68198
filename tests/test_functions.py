import datetime

import pytest
from pyspark.sql import functions as F

from quire.functions import cells, sheets


def values(spark, inputs, kind, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r.x for r in df.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


TYPED = {
    "42": ("number", 42.0), "-17": ("number", -17.0), "+3.25": ("number", 3.25), "42.50": ("number", 42.5), "1,234,567": ("number", 1234567.0), "1,234.50": ("number", 1234.5),
    "1,234": ("string", None), "007": ("string", None), "01.5": ("string", None), "1234567890123456789": ("string", None), "Acme Ltd": ("string", None), "12A": ("string", None),
    "#DIV/0!": ("string", None), "1e5": ("string", None), "": ("empty", None), "yes": ("string", None), "on": ("string", None), "50%": ("percentage", 0.5), "12.5 %": ("percentage", 0.125),
    "$5": ("currency", 5.0), "-€1,234.50": ("currency", -1234.5), "£ 3": ("currency", 3.0), "$x": ("string", None), "01/02/2024": ("string", None), " 42 ": ("number", 42.0),
}


def test_inference(spark):
    got = values(spark, list(TYPED), "string", cells.infer_cell)
    assert {t: (c.kind, c.num) for t, c in zip(TYPED, got)} == TYPED
    assert [c.bool for c in values(spark, ["TRUE", "false", "True"], "string", cells.infer_cell)] == [True, False, True]
    dates = {"2024-01-15": "2024-01-15", "15 Jan 2024": "2024-01-15", "Jan 15, 2024": "2024-01-15", "15 January 2024": "2024-01-15", "2024-02-30": None, "2024-02-29": "2024-02-29"}
    assert [c.text if c.kind == "date" else None for c in values(spark, list(dates), "string", cells.infer_cell)] == list(dates.values())
    assert [c.currency for c in values(spark, ["£1", "€1", "₹1", "₩1", "₽1", "$1", "¥1"], "string", cells.infer_cell)] == ["GBP", "EUR", "INR", "KRW", "RUB", None, None]
    assert values(spark, [None], "string", cells.infer_cell)[0].kind == "empty"


def test_number_text(spark):
    numbers = {340.0: "340", 340.5: "340.5", 0.1: "0.1", -0.0: "0", 123456789.0: "123456789", 1e20: "100000000000000000000", 1e21: "1e+21", 1.5e300: "1.5e+300", 1e-6: "0.000001", 1e-7: "1e-7", 1.25e-5: "0.0000125", -12345678.25: "-12345678.25", 2.5e-9: "2.5e-9"}
    assert values(spark, list(numbers), "double", cells.number_text) == list(numbers.values())


def test_display(spark):
    assert values(spark, ["50%", "TRUE", "$3.50", "7", "x", ""], "string", lambda v: cells.display(cells.infer_cell(v))) == ["50%", "TRUE", "3.5", "7", "x", ""]


def test_column_letters(spark):
    pairs = {"A": 0, "Z": 25, "AA": 26, "AZ": 51, "BA": 52, "ZZ": 701, "AAA": 702, "XFD": 16383}
    assert values(spark, list(pairs), "string", sheets.letters_to_index) == list(pairs.values())
    assert values(spark, list(pairs.values()), "long", sheets.index_to_letters) == list(pairs)
    assert values(spark, ["B7", "$AA$10", "7B", "A0", None], "string", sheets.parse_reference) == [(6, 1), (9, 26), None, None, None]


def test_serials(spark):
    stamp = lambda s: datetime.datetime.fromisoformat(s) if s else None
    known = {1.0: "1900-01-01", 59.0: "1900-02-28", 60.0: None, 61.0: "1900-03-01", 46234.0: "2026-07-31", 61.604166666666667: "1900-03-01T14:30:00", 2.5: "1900-01-02T12:00:00", 1.9999999999: "1900-01-02T00:00:00"}
    assert values(spark, list(known), "double", sheets.serial_to_timestamp) == [stamp(s) for s in known.values()]
    later = {0.0: "1904-01-01", 60.0: "1904-03-01"}
    assert values(spark, list(later), "double", lambda v: sheets.serial_to_timestamp(v, True)) == [stamp(s) for s in later.values()]
    back = values(spark, ["1900-01-01", "1900-02-28", "1900-03-01", "2026-07-31"], "string", lambda v: sheets.date_to_serial(v.cast("date")))
    assert back == [1, 59, 61, 46234]


@pytest.mark.parametrize(
    "code, kind",
    [("0.00", "number"), ("0%", "percentage"), ("yyyy-mm-dd", "date"), ("d mmm yy", "date"), ("hh:mm:ss", "time"), ("h:mm AM/PM", "time"), ("yyyy-mm-dd hh:mm", "dateTime"), ("[h]:mm", "elapsedTime"), ("@", "text"), ("$#,##0.00", "currency"), ("[$€-407] 0.00", "currency"), ('0 "days"', "number"), ("General", "number"), ("[Red]0.0;-0%", "number"), ("#,##0", "number")],
)
def test_number_formats(spark, code, kind):
    assert values(spark, [code], "string", sheets.format_kind) == [kind]


def test_csv_fields_and_order_keys(spark):
    assert values(spark, ["a", "a,b", 'say "x"', "l\nm", None, ""], "string", sheets.csv_field) == ["a", '"a,b"', '"say ""x"""', '"l\nm"', "", ""]
    keys = values(spark, [0, 1, 35, 36, 10**6], "long", sheets.order_key)
    assert keys == sorted(keys) and keys[1] == "000000rs"
    df = spark.createDataFrame([(keys[0], keys[1]), ("00000001", "00000002")], "a string, b string")
    for r in df.select("a", "b", sheets.order_key_between(F.col("a"), F.col("b")).alias("m")).collect():
        assert r.a < r.m < r.b


def test_month_names_and_locale_brackets(spark):
    rows = [("12 Marble 2024", None), ("12 March 2024", "2024-03-12"), ("12 Mar 2024", "2024-03-12"), ("Sept 1, 2024", None), ("September 1, 2024", "2024-09-01"), ("MAY 3, 2024", "2024-05-03")]
    found = {r.t: r.d for r in spark.createDataFrame(rows, "t string, want string").select("t", cells._iso_date(F.col("t")).alias("d")).collect()}
    assert found == dict(rows)
    codes = [("[$-809]0.00", "number"), ("[$€-407]0.00", "currency"), ("₺0.00", "currency"), ("$0", "currency")]
    kinds = {r.t: r.k for r in spark.createDataFrame(codes, "t string, want string").select("t", sheets.format_kind(F.col("t")).alias("k")).collect()}
    assert kinds == dict(codes)
