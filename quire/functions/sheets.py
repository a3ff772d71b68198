"""Spreadsheet scalars: column letters, cell references, serial dates and number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of the built-in number formats.
BUILT_IN = {9: "percentage", 10: "percentage", 14: "date", 15: "date", 16: "date", 17: "date", 18: "time", 19: "time", 20: "time", 21: "time", 22: "dateTime", 45: "time", 46: "elapsedTime", 47: "time", 49: "text"}


def letters_to_index(letters: Column) -> Column:
    """0 for A, 25 for Z, 26 for AA and so on; null where it is not letters."""
    codes = F.transform(F.filter(F.split(F.upper(letters), ""), lambda c: c != ""), lambda c: F.ascii(c) - 64)
    return F.when(letters.rlike("^[A-Za-z]+$"), F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: a * 26 + c) - 1)


def index_to_letters(index: Column) -> Column:
    """The letters of a column index up to seven letters."""
    start = F.struct((index.cast("long") + 1).alias("n"), F.lit("").alias("out"))

    def letter(a: Column, _: Column) -> Column:
        before = F.struct(F.floor((a["n"] - 1) / 26).cast("long").alias("n"), F.concat(F.char(65 + F.pmod(a["n"] - 1, F.lit(26))), a["out"]).alias("out"))
        return F.when(a["n"] > 0, before).otherwise(a)

    return F.when(index >= 0, F.aggregate(F.sequence(F.lit(1), F.lit(7)), start, letter, lambda a: a["out"]))


def parse_reference(reference: Column) -> Column:
    """struct(row, column), both from 0, of a reference such as B7 or $B$7; null where it is none."""
    pattern = r"^\$?([A-Za-z]{1,3})\$?([1-9][0-9]*)$"
    column, row = letters_to_index(F.regexp_extract(reference, pattern, 1)), F.regexp_extract(reference, pattern, 2).try_cast("long") - 1
    return F.when(reference.rlike(pattern), F.struct(row.alias("row"), column.alias("column")))


def reference(row: Column, column: Column) -> Column:
    """The reference of a cell from its row and column, from 0."""
    return F.concat(index_to_letters(column), (row + 1).cast("string"))


def date_to_serial(date: Column, since_1904: bool = False) -> Column:
    """Days of a date in the 1900 system, which counts a 29 February 1900, or the 1904 system."""
    if since_1904:
        return F.datediff(date, F.lit("1904-01-01").cast("date"))
    days = F.datediff(date, F.lit("1899-12-31").cast("date"))
    return F.when(days >= 60, days + 1).otherwise(days)


def serial_to_timestamp(serial: Column, since_1904: bool = False) -> Column:
    """The time of a serial to the millisecond; null for day 60 of the 1900 system and for negatives."""
    millis = F.round(F.pmod(serial, F.lit(1.0)) * 86_400_000).cast("long")
    day = F.floor(serial).cast("int")
    carried = day + F.floor(millis / 86_400_000).cast("int")
    rest = F.pmod(millis, F.lit(86_400_000))
    if since_1904:
        base = F.date_add(F.lit("1904-01-01").cast("date"), carried)
    else:
        base = F.when(carried < 60, F.date_add(F.lit("1899-12-31").cast("date"), carried)).when(carried > 60, F.date_add(F.lit("1899-12-30").cast("date"), carried))
    made = base.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (rest / 1000).cast("decimal(18,6)"))
    return F.when(serial >= 0, made)


def format_kind(code: Column) -> Column:
    """The kind of a number format by its first section: elapsedTime, date, dateTime, time, percentage, currency, text or number.

    Quoted text, escaped characters and colour brackets do not count.
    """
    first = F.regexp_replace(F.lower(F.split_part(F.regexp_replace(code, r'"[^"]*"|\\.|_.|\*.', ""), F.lit(";"), F.lit(1))), r"general", "")
    bare = F.regexp_replace(first, r"\[(?!h+\]|m+\]|s+\])[^\]]*\]", "")
    money = F.regexp_replace(first, r"\[\$-[^\]]*\]", "").rlike(r"\p{Sc}")  # a bracket with a locale alone has no symbol
    day, clock = bare.rlike(r"[yd]|(?<![hs:])m{3,}|^[^hs:]*m[^hs:]*$") & bare.rlike("[ydm]"), bare.rlike(r"[hs]")
    return (
        F.when(bare.rlike(r"\[[hms]+\]"), "elapsedTime").when(day & clock, "dateTime").when(day, "date").when(clock, "time")
        .when(bare.contains("%"), "percentage").when(money, "currency").when(bare.contains("@") & ~bare.rlike("[0#?]"), "text").otherwise("number")
    )


def built_in_kind(format_id: Column) -> Column:
    """The kind of a built-in number format, number unless another is known."""
    table = F.create_map(*(F.lit(x) for pair in BUILT_IN.items() for x in pair))
    return F.coalesce(F.try_element_at(table, format_id.cast("int")), F.lit("number"))


def csv_field(text: Column, delimiter: str = ",") -> Column:
    """A text as a CSV field: quoted where it holds the delimiter, a quote or a line end; null is empty."""
    value = F.coalesce(text, F.lit(""))
    needs = value.contains(delimiter) | value.rlike('["\\r\\n]')
    return F.when(needs, F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def order_key(ordinal: Column, gap: int = 1000, width: int = 8) -> Column:
    """A base-36 key of fixed width that sorts as the ordinals do and leaves gaps to insert into."""
    return F.lpad(F.lower(F.conv((ordinal * gap).cast("string"), 10, 36)), width, "0")


def order_key_between(low: Column, high: Column, width: int = 8) -> Column:
    """A key between two keys of that width; where no number is left, the lower key and a middle digit."""
    a, b = (F.conv(k, 36, 10).cast("long") for k in (low, high))
    middle = F.floor((a + b) / 2).cast("long")
    return F.when(b - a > 1, F.lpad(F.lower(F.conv(middle.cast("string"), 10, 36)), width, "0")).otherwise(F.concat(low, F.lit("i")))


def parse_range(text: Column) -> Column:
    """struct(top, left, bottom, right), from 0, of a range such as B2:D5 or a single reference, corners in any order."""
    ends = F.split(text, ":", -1)
    a, b = parse_reference(ends[0]), parse_reference(F.coalesce(F.get(ends, F.lit(1)), ends[0]))
    corners = [f(a[c], b[c]).alias(n) for f, c, n in ((F.least, "row", "top"), (F.least, "column", "left"), (F.greatest, "row", "bottom"), (F.greatest, "column", "right"))]
    return F.when(a.isNotNull() & b.isNotNull() & (F.size(ends) <= 2), F.struct(*corners))


def unscaled(digits: Column, scale: int) -> Column:
    """The exact decimal of a whole number's digits with the last ones after the point; null beyond 38 digits."""
    bare = F.lpad(F.regexp_replace(digits, "^-", ""), F.greatest(F.char_length(digits), F.lit(scale + 1)), F.lit("0"))
    split = F.char_length(bare) - scale
    text = F.concat(F.when(digits.startswith("-"), "-").otherwise(""), F.substr(bare, F.lit(1), split), F.lit("."), F.substr(bare, split + 1))
    return text.try_cast(f"decimal(38,{scale})")
