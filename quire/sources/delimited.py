"""Delimited text: strict records in, exact bytes out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.sheets import csv_field

#: A field, then what follows it. A quoted field holds anything, with quotes doubled; a quote
#: inside an unquoted field is an ordinary character.
_FIELD = r'(?s)\G("(?:[^"]|"")*+"|[^"%(d)s\r\n][^%(d)s\r\n]*+|)(%(d)s|\r\n|\r|\n|\z)'


class Unterminated(ValueError):
    """A quoted field does not end."""


def records(text: Column, delimiter: str = ",") -> Column:
    """The records of a whole file's text: arrays of fields, blank lines left out.

    Lines end with CRLF, LF or CR; fields may be quoted, with doubled quotes inside. A quoted
    field without an end fails the job, as does text that is not valid UTF-8 (read it with
    files()).
    """
    pattern = _FIELD % {"d": "\\" + delimiter}
    fields = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    ends = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    size = F.aggregate(fields, F.lit(0), lambda a, f: a + F.char_length(f)) + F.aggregate(ends, F.lit(0), lambda a, e: a + F.char_length(e))
    # each array is bound as a lambda's variable, as lambdas compute what they use from outside anew for every element
    bound = F.transform(F.array(F.struct(fields.alias("fields"), ends.alias("ends"))), lambda s: F.struct(s["fields"].alias("fields"), _lasts(s["ends"], delimiter).alias("lasts")))
    found = F.transform(bound, _cut)[0]
    return F.when(size == F.char_length(text), found).when(text.isNotNull(), F.raise_error(F.lit("a quoted field does not end")))


def _lasts(ends: Column, delimiter: str) -> Column:
    """The places of the last field of each record."""
    return F.filter(F.transform(ends, lambda end, i: F.when(end != delimiter, i)), lambda i: i.isNotNull())


def _cut(s: Column) -> Column:
    """The records of a struct (fields, lasts) without those of one empty field."""

    def record(last: Column, k: Column) -> Column:
        before = F.when(k == 0, -1).otherwise(F.get(s["lasts"], k - 1))
        return F.slice(s["fields"], before + 2, last - before)

    kept = F.filter(F.transform(s["lasts"], record), lambda r: (F.size(r) > 1) | (F.get(r, F.lit(0)) != ""))
    return F.transform(kept, lambda r: F.transform(r, _unquoted))


def _unquoted(raw: Column) -> Column:
    inner = F.replace(F.substr(raw, F.lit(2), F.char_length(raw) - 2), F.lit('""'), F.lit('"'))
    return F.when(raw.startswith('"') & (F.char_length(raw) > 1), inner).otherwise(raw)


def files(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """(file, row, fields) of all files under a path; rows count from 0, the header included.

    A byte order mark is dropped; short rows are padded to the widest with empty text.
    """
    raw = spark.read.format("binaryFile").load(path)
    text = F.regexp_replace(F.validate_utf8(F.col("content").cast("string")), r"^\x{FEFF}", "")
    rows = raw.select(F.col("path").alias("file"), records(text, delimiter).alias("rows"))
    widest = F.array_max(F.transform("rows", F.size))
    padded = F.transform("rows", lambda r: F.concat(r, F.array_repeat(F.lit(""), widest - F.size(r))))
    return rows.select("file", F.posexplode(padded).alias("row", "fields"))


def to_lines(df: DataFrame, columns: Sequence[str], delimiter: str = ",") -> DataFrame:
    """(value): each row as a CSV line of display text, fields quoted only where they must be."""
    fields = [csv_field(F.col(f"`{c}`").cast("string"), delimiter) for c in columns]
    return df.select(F.concat_ws(delimiter, *fields).alias("value"))


def write(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """Write a table as CSV files with a header each and CRLF line ends; nulls are empty fields.

    Texts are written as they are, line feeds included. The first row of each partition, and
    so of each file, has the header before it; a table without rows gives no header.
    """
    header = delimiter.join('"' + c.replace('"', '""') + '"' if any(x in c for x in (delimiter, '"', "\r", "\n")) else c for c in df.columns)
    first = F.monotonically_increasing_id() % (1 << 33) == 0
    lines = to_lines(df, df.columns, delimiter)
    lines.select(F.when(first, F.concat(F.lit(header + "\r\n"), "value")).otherwise(F.col("value")).alias("value")).write.option("lineSep", "\r\n").text(path)
