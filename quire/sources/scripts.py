"""Tables inside SQL script files of an embedded database: CREATE TABLE and one-row INSERT statements."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How the statements start that define no table and hold no row.
IGNORED = (
    "SET DATABASE, SET FILES, SET SCHEMA, SET TABLE, SET WRITE_DELAY, SET AUTOCOMMIT, SET IGNORECASE, SET REFERENTIAL_INTEGRITY, SET PROPERTY, SET PASSWORD, SET LOGSIZE, SET SCALE, SET LOCAL,"
    " CREATE USER, ALTER USER, DROP USER, CREATE SCHEMA, DROP SCHEMA, GRANT, REVOKE, CREATE SEQUENCE, ALTER SEQUENCE, DROP SEQUENCE, CREATE INDEX, CREATE UNIQUE INDEX, DROP INDEX, ALTER TABLE,"
    " CREATE VIEW, DROP VIEW, CREATE TRIGGER, DROP TRIGGER, CREATE FUNCTION, CREATE PROCEDURE, CREATE AGGREGATE FUNCTION, DROP FUNCTION, DROP PROCEDURE, CREATE TYPE, CREATE DOMAIN, COMMENT ON,"
    " CHECKPOINT, CONNECT, DISCONNECT, SHUTDOWN"
).split(", ")
_KINDS = [r"CREATE\s+(?:(?:MEMORY|CACHED|TEXT|TEMP|TEMPORARY|GLOBAL\s+TEMPORARY)\s+)?TABLE\s", r"INSERT\s+INTO\s", *(x.replace(" ", r"\s+") for x in IGNORED)]
_READ = re.compile(rf"\s*(?:{'|'.join(_KINDS)})", re.I)
_STATEMENT = re.compile(r"""(?:'[^']*'|"[^"]*"|[^'"\r\n])+""")

_NAME = r'("(?:[^"]|"")*+"|[A-Za-z_][A-Za-z0-9_$]*+)'
_LITERAL = r"('(?:[^']|'')*+'|(?:DATE|TIME|TIMESTAMP)\s*'[^']*+'|[^,()'\s]++)"


def _bare(name: Column) -> Column:
    """A name without its quotes; unquoted names fold to upper case."""
    inner = F.replace(F.substr(name, F.lit(2), F.greatest(F.char_length(name) - 2, F.lit(0))), F.lit('""'), F.lit('"'))
    return F.when(name.startswith('"'), inner).otherwise(F.upper(name))


def statements(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, statement) of script files; line is where a statement starts, from 0.

    Statements end with a line, but not within a quoted text or name. A quote without an end, and a
    statement that is neither read nor of the IGNORED kinds, fail the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(*batch.columns):
                text, at, line, found = content.as_py().decode("utf-8").replace("\r\n", "\n"), 0, 0, []
                while at < len(text):
                    part = _STATEMENT.match(text, at)
                    end = part.end() if part else at
                    if text[end : end + 1] in ("'", '"') and end < len(text):
                        raise ValueError(f"a quote without an end after line {line}")
                    if part and part[0].strip():
                        if not _READ.match(part[0]):
                            raise ValueError(f"unknown statement in line {line}: {part[0][:80]!r}")
                        found.append((line, part[0]))
                    line += text.count("\n", at, end + 1)
                    at = end + 1
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(found), pa.string()), pa.array([n for n, _ in found], pa.int32()), pa.array([s for _, s in found], pa.string())], ["file", "line", "statement"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, line int, statement string")


def columns(script: DataFrame) -> DataFrame:
    """(file, table, position, column, type) of the CREATE TABLE statements, types as written."""
    pattern = rf"(?is)^\s*CREATE\s+(?:(?:MEMORY|CACHED|TEXT|TEMP|TEMPORARY|GLOBAL\s+TEMPORARY)\s+)?TABLE\s+(?:{_NAME}\.)?{_NAME}\s*\((.*)\)\s*;?\s*$"
    made = script.where(F.col("statement").rlike(pattern))
    body = F.regexp_extract("statement", pattern, 3)
    item = rf"(?i)\G\s*((?:[^,()'\"]|\"(?:[^\"]|\"\")*+\"|'(?:[^']|'')*+'|\([^()]*+\))++)(?:,|\z)"
    items = made.select("file", _bare(F.regexp_extract("statement", pattern, 2)).alias("table"), F.posexplode(F.regexp_extract_all(body, F.lit(item), F.lit(1))).alias("position", "item"))
    defined = items.where(~F.col("item").rlike(r"(?i)^\s*(?:CONSTRAINT|PRIMARY\s+KEY|UNIQUE|FOREIGN\s+KEY|CHECK)\b"))
    kind = F.regexp_extract("item", rf"(?i)^\s*{_NAME}\s+([A-Za-z_]+(?:\s*\([^)]*\))?)", 2)
    return defined.select("file", "table", "position", _bare(F.regexp_extract("item", rf"^\s*{_NAME}", 1)).alias("column"), F.upper(kind).alias("type"))


def value(raw: Column) -> Column:
    """struct(kind, text) of a literal: NULL is empty; booleans, numbers, dates and strings by their spelling."""
    inner = F.replace(F.regexp_replace(F.regexp_replace(raw, r"^[^']*'", ""), r"'$", ""), F.lit("''"), F.lit("'"))
    upper = F.upper(raw)
    kind = (
        F.when(upper == "NULL", "empty").when(upper.isin("TRUE", "FALSE"), "boolean").when(upper.rlike(r"^DATE\s*'"), "date").when(upper.rlike(r"^TIME\s*'"), "time")
        .when(upper.rlike(r"^TIMESTAMP\s*'"), "dateTime").when(raw.startswith("'"), "string").when(raw.try_cast("double").isNotNull(), "number")
        .otherwise(F.raise_error(F.concat(F.lit("not a literal: "), raw)))
    )
    return F.struct(kind.alias("kind"), F.when(kind == "empty", None).when(raw.contains("'"), inner).when(kind == "boolean", upper).otherwise(raw).alias("text"))


def rows(script: DataFrame) -> DataFrame:
    """(file, table, line, position, column, kind, text): a row per cell of the INSERT statements.

    A column list puts values under its names; without one they follow the table's columns.
    Columns that a statement leaves out have no cell. A statement of another shape, with more than
    one tuple, or with another number of values than of columns fails the job.
    """
    pattern = rf"(?is)^\s*INSERT\s+INTO\s+(?:{_NAME}\.)?{_NAME}\s*(?:\(([^)]*)\)\s*)?VALUES\s*\((\s*{_LITERAL}\s*(?:,\s*{_LITERAL}\s*)*+)\)\s*;?\s*$"
    is_insert = F.col("statement").rlike(r"(?i)^\s*INSERT\s")
    refused = F.raise_error(F.concat(F.lit("not a single tuple of literals: "), F.substr("statement", F.lit(1), F.lit(80))))
    inserts = script.where(is_insert).withColumn("statement", F.when(F.col("statement").rlike(pattern), F.col("statement")).when(is_insert, refused))
    literals = F.regexp_extract_all(F.regexp_extract("statement", pattern, 4), F.lit(rf"(?is){_LITERAL}"), F.lit(1))
    named = F.regexp_extract("statement", pattern, 3)
    names = F.when(named != "", F.transform(F.regexp_extract_all(named, F.lit(_NAME), F.lit(1)), _bare))
    held = inserts.select("file", "line", _bare(F.regexp_extract("statement", pattern, 2)).alias("table"), names.alias("names"), literals.alias("values"))
    widths = columns(script).groupBy("file", "table").agg(F.count("*").alias("width"))
    expected = F.coalesce(F.when(F.col("names").isNotNull(), F.size("names")), F.col("width"))
    wrong = F.raise_error(F.concat(F.lit("values and columns differ in number in line "), F.col("line").cast("string")))
    held = held.join(widths, ["file", "table"], "left").withColumn("values", F.when(F.size("values") == expected, F.col("values")).otherwise(wrong))
    cells = held.select("file", "line", "table", "names", F.posexplode("values").alias("at", "raw"))
    cells = cells.select("file", "line", "table", "at", F.get("names", F.col("at")).alias("named"), value(F.col("raw")).alias("v"))
    order = columns(script).withColumn("at", F.col("position"))
    by_name = cells.where("named IS NOT NULL").join(order.drop("at").withColumnRenamed("column", "named"), ["file", "table", "named"]).withColumnRenamed("named", "column")
    by_place = cells.where("named IS NULL").drop("named").join(order, ["file", "table", "at"])
    shape = ["file", "table", "line", "position", "column", "v.kind", "v.text"]
    return by_name.select(*shape).unionByName(by_place.select(*shape))


def read_table(script: DataFrame, table: str, types: dict[str, str]) -> DataFrame:
    """One table as a DataFrame: the named columns cast to Spark types, a row per INSERT."""
    cells = rows(script).where(F.col("table") == table)
    picked = [F.max(F.when(F.col("column") == c, F.col("text"))).try_cast(t).alias(c) for c, t in types.items()]
    return cells.groupBy("file", "line").agg(*picked).drop("file", "line")
