"""Workbooks as long tables of typed cells, built from an archive's XML parts with Spark's XML reader."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.cells import number_text
from quire.functions.sheets import built_in_kind, format_kind, letters_to_index, parse_range, parse_reference, serial_to_timestamp
from quire.operators.joins import outer_with_default
from quire.runtime import broadcast_if_small, materialize
from quire.sources.archives import parts

_SHEET = "sheetData STRUCT<row: ARRAY<STRUCT<c: ARRAY<STRUCT<_r: STRING, _t: STRING, _s: INT, v: STRING, is: STRUCT<t: STRING>>>>>>"
_STRINGS = "si ARRAY<STRUCT<t: STRING, r: ARRAY<STRUCT<t: STRING>>>>"
_STYLES = "numFmts STRUCT<numFmt: ARRAY<STRUCT<_numFmtId: INT, _formatCode: STRING>>>, cellXfs STRUCT<xf: ARRAY<STRUCT<_numFmtId: INT>>>"
_BOOK = "sheets STRUCT<sheet: ARRAY<STRUCT<_name: STRING, _sheetId: INT, `_r:id`: STRING>>>, workbookPr STRUCT<_date1904: STRING>"
_RELATIONS = "Relationship ARRAY<STRUCT<_Id: STRING, _Type: STRING, _Target: STRING>>"
_MERGES = "mergeCells STRUCT<mergeCell: ARRAY<STRUCT<_ref: STRING>>>"
_NAMES = "definedNames STRUCT<definedName: ARRAY<STRUCT<_name: STRING, _localSheetId: STRING, _VALUE: STRING>>>"
_COMMENTS = "authors STRUCT<author: ARRAY<STRING>>, commentList STRUCT<comment: ARRAY<STRUCT<_ref: STRING, _authorId: STRING, text: STRUCT<t: STRING, r: ARRAY<STRUCT<t: STRING>>>>>>"


def _parsed(parts_: DataFrame, like: str, schema: str) -> DataFrame:
    """(file, part, x): parts whose name fits, parsed by a schema."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), r"<(/?)[a-z]+:(?=(?:worksheet|sheetData|row|c|v|is|t|sst|si|r|mergeCells?|comments?|commentList|authors?|text)\b)", "<$1")
    return parts_.where(F.col("part").rlike(like)).select("file", "part", F.from_xml(text, schema, {"ignoreNamespace": "false", "ignoreSurroundingSpaces": "false"}).alias("x"))


def _typed(t: Column, v: Column, inline: Column, shared: Column, kind: Column, since_1904: Column) -> Column:
    """struct(kind, num, bool, text) of a cell from its type, raw value, shared string and number format."""
    number = v.try_cast("double")
    stamp = F.when(since_1904, serial_to_timestamp(number, True)).otherwise(serial_to_timestamp(number))
    dated = F.when(kind.isin("date", "time", "dateTime") & stamp.isNotNull(), kind)
    pattern = {"date": "yyyy-MM-dd", "time": "HH:mm:ss", "dateTime": "yyyy-MM-dd'T'HH:mm:ss"}
    text = F
    for name, p in pattern.items():
        text = text.when(dated == name, F.date_format(stamp, p))
    is_number = t.isNull() | (t == "n")
    found = (
        F.when(t.isin("s", "inlineStr", "str"), "string").when(t == "b", "boolean").when(t == "e", "error").when(t == "d", "dateTime")
        .when(dated.isNotNull(), dated).when(kind.isin("percentage", "currency"), kind).otherwise("number")
    )
    words = F.when(t == "s", shared).when(t == "inlineStr", inline).when(t.isin("str", "e", "d"), v).when(is_number, text.otherwise(F.lit(None)))
    return F.struct(found.alias("kind"), F.when(is_number & dated.isNull(), number).alias("num"), F.when(t == "b", (v == "1") | (F.lower(v) == "true")).alias("bool"), words.alias("text"))


def _sheets(entries: DataFrame) -> DataFrame:
    """(file, sheet_no, sheet, part) of the sheets of each workbook, numbered from 0 in its order."""
    book = _parsed(entries, r"^xl/workbook\.xml$", _BOOK).select("file", F.posexplode("x.sheets.sheet").alias("sheet_no", "s")).select("file", "sheet_no", F.col("s._name").alias("sheet"), F.col("s.`_r:id`").alias("rel"))
    links = _parsed(entries, r"^xl/_rels/workbook\.xml\.rels$", _RELATIONS).select("file", F.explode("x.Relationship").alias("l"))
    links = links.select("file", F.col("l._Id").alias("rel"), F.concat(F.lit("xl/"), F.regexp_replace("l._Target", r"^/?(?:xl/)?", "")).alias("part"))
    return book.join(links, ["file", "rel"]).select("file", "sheet_no", "sheet", "part")


def xlsx_cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row, column, kind, num, bool, text) of the cells of all workbooks under a path.

    Rows and columns count from 0. Shared strings and number formats are joined by index;
    cells without a value, or with a number or index that is none, have no row. Dates follow
    the system that the workbook names, 1900 or 1904.
    """
    entries = parts(spark, path)
    cells = _parsed(entries, r"^xl/worksheets/[^/]+\.xml$", _SHEET).select("file", "part", F.explode("x.sheetData.row").alias("r")).select("file", "part", F.explode("r.c").alias("c"))
    books = _parsed(entries, r"^xl/workbook\.xml$", _BOOK)
    systems = books.select("file", F.lower("x.workbookPr._date1904").isin("1", "true", "on").alias("since_1904"))
    strings = _parsed(entries, r"^xl/sharedStrings\.xml$", _STRINGS).select("file", F.posexplode("x.si").alias("v", "si"))
    runs = F.array_join(F.transform(F.coalesce("si.r", F.array().cast("array<struct<t:string>>")), lambda r: F.coalesce(r["t"], F.lit(""))), "")
    strings = strings.select("file", F.col("v").cast("string").alias("v"), F.coalesce("si.t", runs).alias("shared"))
    styles = _parsed(entries, r"^xl/styles\.xml$", _STYLES)
    xfs = styles.select("file", F.posexplode("x.cellXfs.xf").alias("style", "xf")).select("file", "style", F.col("xf._numFmtId").alias("fmt"))
    custom = styles.select("file", F.explode("x.numFmts.numFmt").alias("f")).select("file", F.col("f._numFmtId").alias("fmt"), F.col("f._formatCode").alias("code"))
    formats = xfs.join(custom, ["file", "fmt"], "left").select("file", "style", F.when(F.col("code").isNotNull(), format_kind(F.col("code"))).otherwise(built_in_kind(F.col("fmt"))).alias("format"))
    flat = cells.select("file", "part", F.col("c._t").alias("t"), F.coalesce("c._s", F.lit(0)).alias("style"), F.col("c.v").alias("v"), F.col("c.is.t").alias("inline"), parse_reference(F.col("c._r")).alias("at"))
    looked = flat.withColumn("key", F.when(F.col("t") == "s", F.col("v")))
    joined = looked.join(strings.withColumnRenamed("v", "key"), ["file", "key"], "left").join(formats, ["file", "style"], "left")
    named = joined.join(_sheets(entries).select("file", "part", "sheet"), ["file", "part"], "left")
    named = named.join(systems, "file", "left")
    typed = named.withColumn("cell", _typed(F.col("t"), F.col("v"), F.col("inline"), F.col("shared"), F.coalesce("format", F.lit("number")), F.coalesce("since_1904", F.lit(False))))
    there = (F.col("t") == "inlineStr") | (F.col("v").isNotNull() & ((F.coalesce("t", F.lit("n")) != "s") | F.col("shared").isNotNull()) & (F.coalesce("t", F.lit("n")).isin("s", "b", "e", "d", "str") | F.col("v").try_cast("double").isNotNull()))
    return typed.where(there).select("file", F.coalesce("sheet", "part").alias("sheet"), "at.row", "at.column", "cell.*")


def xlsx_merges(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row, column, n_rows, n_columns): merged ranges of workbooks by their first cell, from 0.

    A reference that is no range has no row.
    """
    entries = parts(spark, path)
    ranges = _parsed(entries, r"^xl/worksheets/[^/]+\.xml$", _MERGES).select("file", "part", F.explode("x.mergeCells.mergeCell").alias("m"))
    placed = ranges.select("file", "part", parse_range(F.col("m._ref")).alias("r")).where("r IS NOT NULL").join(_sheets(entries), ["file", "part"])
    return placed.select("file", "sheet", F.col("r.top").alias("row"), F.col("r.left").alias("column"), (F.col("r.bottom") - F.col("r.top") + 1).alias("n_rows"), (F.col("r.right") - F.col("r.left") + 1).alias("n_columns"))


def xlsx_comments(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row, column, author, text): notes on cells, from the comment parts that a sheet links to.

    Of several notes on a cell the last one counts; an author number that is none gives null;
    notes without a text element or with a reference that is none have no row.
    """
    entries = parts(spark, path)
    links = _parsed(entries, r"^xl/worksheets/_rels/[^/]+\.xml\.rels$", _RELATIONS).select("file", "part", F.posexplode("x.Relationship").alias("link_no", "l")).where(F.col("l._Type").endswith("/relationships/comments"))
    target = F.col("l._Target")
    where = F.when(target.startswith("/"), F.substr(target, F.lit(2))).when(target.startswith("../"), F.concat(F.lit("xl/"), F.substr(target, F.lit(4)))).otherwise(F.concat(F.lit("xl/worksheets/"), target))
    owner = F.regexp_replace("part", r"^xl/worksheets/_rels/(.*)\.rels$", "xl/worksheets/$1")
    links = links.select("file", owner.alias("part"), "link_no", where.alias("notes")).join(_sheets(entries), ["file", "part"]).select("file", "sheet", "link_no", "notes")
    notes = _parsed(entries, r"\.xml$", _COMMENTS).where("x.commentList IS NOT NULL").select("file", F.col("part").alias("notes"), F.col("x.authors.author").alias("authors"), F.posexplode("x.commentList.comment").alias("note_no", "c"))
    runs = F.array_join(F.transform(F.coalesce("c.text.r", F.array().cast("array<struct<t:string>>")), lambda r: F.coalesce(r["t"], F.lit(""))), "")
    number = F.col("c._authorId").try_cast("int")
    said = notes.select("file", "notes", "note_no", parse_reference(F.col("c._ref")).alias("at"), F.when(number >= 0, F.get("authors", number)).alias("author"), F.concat(F.coalesce("c.text.t", F.lit("")), runs).alias("text"), F.col("c.text").isNotNull().alias("there"))
    placed = said.where("there AND at IS NOT NULL").join(links, ["file", "notes"])
    last = placed.groupBy("file", "sheet", "at.row", "at.column").agg(F.max_by(F.struct("author", "text"), F.struct("link_no", "note_no")).alias("n"))
    return last.select("file", "sheet", "row", "column", "n.author", "n.text")


def xlsx_print_settings(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, print_range, repeat_rows, repeat_columns) of sheets with a reserved print name, from 0, ends included.

    The names are bound to a sheet by its number. Of several print areas the first counts; of
    repeated names, rows or columns the last; what is malformed is null.
    """
    entries = parts(spark, path)
    names = _parsed(entries, r"^xl/workbook\.xml$", _NAMES).select("file", F.posexplode("x.definedNames.definedName").alias("at", "n"))
    names = names.select("file", "at", F.col("n._name").alias("name"), F.col("n._localSheetId").try_cast("int").alias("sheet_no"), F.col("n._VALUE").alias("value")).where("name IN ('_xlnm.Print_Area', '_xlnm.Print_Titles')")
    last = lambda name: F.max_by(F.when(F.col("name") == name, F.col("value")), F.when(F.col("name") == name, F.col("at")))
    held = names.groupBy("file", "sheet_no").agg(last("_xlnm.Print_Area").alias("area"), last("_xlnm.Print_Titles").alias("titles"))
    bare = lambda text: F.regexp_replace(F.regexp_replace(F.trim(text), r"^.*!", ""), r"\$", "")
    segments = F.transform(F.split("titles", ",", -1), bare)

    def band(kind: str, index: Callable[[Column], Column], ordered: bool) -> Column:
        fits = F.filter(segments, lambda s: s.rlike(f"^{kind}+:{kind}+$"))
        a, b = (index(F.get(F.split(F.get(fits, F.size(fits) - 1), ":"), F.lit(i))) for i in (0, 1))
        low, high = (F.least(a, b), F.greatest(a, b)) if ordered else (a, b)
        return F.when(F.size(fits) > 0, F.struct(low.alias("first"), high.alias("last")))

    rows, columns = band("[0-9]", lambda t: t.try_cast("int") - 1, False), band("[A-Za-z]", letters_to_index, True)
    found = held.select("file", "sheet_no", parse_range(bare(F.get(F.split("area", ",", -1), F.lit(0)))).alias("print_range"), rows.alias("repeat_rows"), columns.alias("repeat_columns"))
    return found.join(_sheets(entries), ["file", "sheet_no"]).select("file", "sheet", "print_range", "repeat_rows", "repeat_columns")


def with_notes(cells: DataFrame, merges: DataFrame, comments: DataFrame) -> DataFrame:
    """Cells with n_rows and n_columns of the range they begin (else 1), author and comment.

    A merged range or a note whose first cell has no value adds a cell of kind empty.
    """
    at = ["file", "sheet", "row", "column"]
    noted = comments.withColumnRenamed("text", "comment")
    empty = {"kind": F.lit("empty")}
    joined = outer_with_default(outer_with_default(cells, merges, at, empty), noted, at, empty)
    return joined.withColumns({n: F.coalesce(n, F.lit(1)) for n in ("n_rows", "n_columns")})


def to_wide(cells: DataFrame, sheet: str, columns: int) -> DataFrame:
    """One row per sheet row with columns c0.. as display text; empty cells are null."""
    shown = F.coalesce("text", number_text(F.col("num")), F.upper(F.col("bool").cast("string")))
    picked = [F.max(F.when(F.col("column") == i, shown)).alias(f"c{i}") for i in range(columns)]
    return cells.where(F.col("sheet") == sheet).groupBy("file", "row").agg(*picked)


_CONTENT = "`body` STRUCT<`spreadsheet`: STRUCT<`table`: ARRAY<STRUCT<`_table:name`: STRING, `table-row`: ARRAY<STRUCT<`_table:number-rows-repeated`: INT, `table-cell`: ARRAY<STRUCT<`_table:number-columns-repeated`: INT, `_office:value-type`: STRING, `_office:value`: STRING, `_office:boolean-value`: STRING, `_office:date-value`: STRING, `_office:time-value`: STRING, `p`: ARRAY<STRING>>>>>>>>>"


def ods_cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row, column, kind, num, bool, text) of the cells of all open-document sheets under a path.

    Positions are running sums of the repeat counts. A repeated cell or row is listed once, at
    its first position; cells without a value type have no row. Times such as PT14H30M00S are
    read as 14:30:00.
    """
    bare = F.regexp_replace(F.decode("content", "UTF-8"), r"<(/?)(?:office|table|text):", "<$1")
    sheets_ = parts(spark, path).where("part = 'content.xml'").select("file", F.from_xml(bare, _CONTENT, {"ignoreNamespace": "false", "ignoreSurroundingSpaces": "false"}).alias("x"))
    tables = sheets_.select("file", F.posexplode("x.body.spreadsheet.table").alias("sheet_no", "t")).select("file", "sheet_no", F.col("t.`_table:name`").alias("sheet"), F.posexplode("t.`table-row`").alias("r_no", "r"))
    in_sheet = Window.partitionBy("file", "sheet_no").orderBy("r_no").rowsBetween(Window.unboundedPreceding, -1)
    repeated = F.coalesce(F.col("r.`_table:number-rows-repeated`"), F.lit(1))
    rows = tables.withColumn("row", F.coalesce(F.sum(repeated).over(in_sheet), F.lit(0)).cast("long"))
    cells = rows.select("file", "sheet_no", "sheet", "row", F.posexplode("r.`table-cell`").alias("c_no", "c"))
    in_row = Window.partitionBy("file", "sheet_no", "row").orderBy("c_no").rowsBetween(Window.unboundedPreceding, -1)
    wide = F.coalesce(F.col("c.`_table:number-columns-repeated`"), F.lit(1))
    placed = cells.withColumn("column", F.coalesce(F.sum(wide).over(in_row), F.lit(0)).cast("long"))
    given = lambda name: F.col(f"c.`_office:{name}`")
    kind, number = given("value-type"), given("value").try_cast("double")
    shown = F.array_join(F.coalesce("c.p", F.array().cast("array<string>")), "\n")
    clock = F.regexp_replace(given("time-value"), r"^PT([0-9]+)H([0-9]+)M([0-9]+)(?:[.,][0-9]+)?S$", "$1:$2:$3")
    dated = F.when(given("date-value").contains("T"), "dateTime").otherwise("date")
    found = F.when(kind == "float", F.when(number.isNull(), "string").otherwise("number")).when(kind == "date", dated).otherwise(kind)
    numeric = kind.isin("float", "percentage", "currency")
    text = F.when(found == "string", shown).when(kind == "date", given("date-value")).when(kind == "time", clock)
    return placed.where(kind.isNotNull()).select("file", "sheet", "row", "column", found.alias("kind"), F.when(numeric, number).alias("num"), F.when(kind == "boolean", given("boolean-value") == "true").alias("bool"), text.alias("text"))


def table_cells(df: DataFrame, order: list[Column | str], sheet: str) -> DataFrame:
    """A table as long cells (sheet, row, column, text): names in row 0, rows from 1 in an order.

    Rows are dealt by range and sorted; a row's number is its place in its range after the rows
    of the ranges before, so only one count a range meets in one task. Rows that tie stand in any order.
    """
    names = df.columns
    lined = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    counts = lined.groupBy("_part").agg(F.count("*").alias("_held"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_held").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(counts.select("_part", (F.col("_first") - before - 1).alias("_shift")))
    numbered = lined.join(broadcast_if_small(starts), "_part").withColumn("_row", F.col("_at") - F.col("_shift"))
    body = numbered.select("_row", F.posexplode(F.array(*(F.col(f"`{c}`").cast("string") for c in names))).alias("column", "text"))
    head = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("_row"), F.posexplode(F.array(*map(F.lit, names))).alias("column", "text"))
    return head.unionByName(body).select(F.lit(sheet).alias("sheet"), F.col("_row").alias("row"), "column", "text")
