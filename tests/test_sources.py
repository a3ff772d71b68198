import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.sources import archives, delimited, scripts, spreadsheets
from quire.streaming import arrivals


def put(folder, name, data):
    path = folder / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in entries.items():
            archive.writestr(name, data)
    return out.getvalue()


def fields(spark, folder, text, delimiter=","):
    path = put(folder, "x.csv", text)
    return [r.fields for r in delimited.files(spark, path, delimiter).orderBy("row").collect()]


def test_strict_records(spark, tmp_path):
    assert fields(spark, tmp_path, "007,TRUE\n42.5,x") == [["007", "TRUE"], ["42.5", "x"]]
    assert fields(spark, tmp_path, 'a,b\r\n"x, y","he said ""hi"""\r"l1\nl2",q"z\n\nlast') == [["a", "b"], ["x, y", 'he said "hi"'], ["l1\nl2", 'q"z'], ["last", ""]]
    assert fields(spark, tmp_path, "﻿a\tb\n\tc\n", "\t") == [["a", "b"], ["", "c"]]
    assert fields(spark, tmp_path, "") == []
    with pytest.raises(Exception, match="does not end"):
        fields(spark, tmp_path, 'a,"open')
    with pytest.raises(Exception, match="UTF"):
        fields(spark, tmp_path, b"a,\xff\n")


def test_csv_written_and_read_again(spark, tmp_path):
    rows = [(1, 'a "q"', "x,y"), (2, None, "line\nfeed"), (3, "é", "")]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    delimited.write(df.coalesce(1), str(tmp_path / "out"))
    got = [r.fields for r in delimited.files(spark, str(tmp_path / "out" / "part-*")).orderBy("row").collect()]
    assert got == [["id", "a", "b"], ["1", 'a "q"', "x,y"], ["2", "", "line\nfeed"], ["3", "é", ""]]


def test_archive_parts(spark, tmp_path):
    inner = zipped({"deep.txt": "deep"})
    put(tmp_path, "a.zip", zipped({"x/one.txt": "1", "in.zip": inner}))
    put(tmp_path, "b.bin", b"not an archive")
    got = {r.part: bytes(r.content) for r in archives.parts(spark, str(tmp_path)).collect()}
    assert got == {"x/one.txt": b"1", "in.zip": inner, "in.zip!/deep.txt": b"deep"}
    kinds = spark.read.format("binaryFile").load(str(tmp_path)).select(archives.sniff(F.col("content")).alias("k")).collect()
    assert sorted(r.k for r in kinds) == ["unknown", "zip"]


def test_workbook_cells(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f"""<?xml version="1.0"?><worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>
      <row r="2"><c r="A2"><v>42.5</v></c><c r="B2" s="1"><v>46234</v></c><c r="C2" t="b"><v>1</v></c><c r="D2" s="2"><v>0.25</v></c><c r="E2" t="e"><v>#DIV/0!</v></c><c r="F2"/><c r="G2" t="inlineStr"><is><t>in line</t></is></c><c r="H2" t="s"><v>9</v></c></row></sheetData></worksheet>"""
    book = zipped({
        "xl/workbook.xml": f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {main}><si><t>name</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>",
        "xl/styles.xml": f'<styleSheet {main}><numFmts><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="10"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": sheet,
    })
    put(tmp_path, "book.xlsx", book)
    cells = spreadsheets.xlsx_cells(spark, str(tmp_path / "book.xlsx"))
    got = {(r.row, r.column): (r.kind, r.num, r.bool, r.text) for r in cells.collect()}
    assert got == {
        (0, 0): ("string", None, None, "name"), (0, 1): ("string", None, None, "two runs"), (1, 0): ("number", 42.5, None, None), (1, 1): ("date", None, None, "2026-07-31"),
        (1, 2): ("boolean", None, True, None), (1, 3): ("percentage", 0.25, None, None), (1, 4): ("error", None, None, "#DIV/0!"), (1, 6): ("string", None, None, "in line"),
    }
    assert {r.sheet for r in cells.collect()} == {"Data"}
    wide = spreadsheets.to_wide(cells, "Data", 3).orderBy("row").collect()
    assert tuple(wide[1])[2:] == ("42.5", "2026-07-31", "TRUE")


def test_workbook_side_tables(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    links = lambda *pairs: "<Relationships>" + "".join(f'<Relationship Id="r{i}" Type="{office}/{kind}" Target="{to}"/>' for i, (kind, to) in enumerate(pairs)) + "</Relationships>"
    names = "<definedNames>" + "".join(
        f'<definedName name="{name}"{of}>{value}</definedName>'
        for name, of, value in (
            ("_xlnm.Print_Area", ' localSheetId="1"', "'My ! sheet'!$C$9:$A$2,'My ! sheet'!$Z$1"), ("_xlnm.Print_Titles", ' localSheetId="1"', "Two!$D:$B, Two!$1:$3"), ("_xlnm.Print_Titles", ' localSheetId="0"', "One!$A$1:$B$2"),
            ("_xlnm.Print_Area", "", "One!$A$1"), ("_xlnm.Print_Area", ' localSheetId="7"', "One!$A$1"), ("other", ' localSheetId="0"', "One!$A$1"),
        )
    ) + "</definedNames>"
    note = lambda ref, author, text: f'<comment ref="{ref}" authorId="{author}">{text}</comment>'
    notes = note("B2", 1, "<text><r><t>Ask</t></r><r><t xml:space=\"preserve\"> again</t></r></text>") + note("A1", 0, "<text><t>old</t></text>") + note("A1", 9, "<text><t>new</t></text>") + note("C1", 0, "") + note("1A", 0, "<text><t>x</t></text>")
    put(tmp_path, "side.xlsx", zipped({
        "xl/workbook.xml": f'<workbook {main} xmlns:r="{office}"><sheets><sheet name="One" sheetId="4" r:id="r0"/><sheet name="Two" sheetId="2" r:id="r1"/></sheets>{names}</workbook>',
        "xl/_rels/workbook.xml.rels": links(("worksheet", "worksheets/sheet1.xml"), ("worksheet", "/xl/worksheets/sheet2.xml")),
        "xl/worksheets/sheet1.xml": f'<worksheet {main}><sheetData><row r="1"><c r="A1"><v>5</v></c></row></sheetData><mergeCells count="2"><mergeCell ref="A1:B3"/><mergeCell ref="E5:D4"/><mergeCell ref="x"/></mergeCells></worksheet>',
        "xl/worksheets/sheet2.xml": f"<worksheet {main}><sheetData/></worksheet>",
        "xl/worksheets/_rels/sheet1.xml.rels": links(("drawing", "../comments9.xml"), ("comments", "../comments1.xml")),
        "xl/comments1.xml": f"<comments {main}><authors><author>Kim</author><author>Lou</author></authors><commentList>{notes}</commentList></comments>",
        "xl/comments9.xml": f"<comments {main}><authors/><commentList>{note('H8', 0, '<text><t>x</t></text>')}</commentList></comments>",
    }))
    path = str(tmp_path / "side.xlsx")
    merges, comments = spreadsheets.xlsx_merges(spark, path), spreadsheets.xlsx_comments(spark, path)
    assert sorted(tuple(r)[1:] for r in merges.collect()) == [("One", 0, 0, 3, 2), ("One", 3, 3, 2, 2)]
    assert sorted(tuple(r)[1:] for r in comments.collect()) == [("One", 0, 0, None, "new"), ("One", 1, 1, "Lou", "Ask again")]
    got = {r.sheet: (r.print_range and tuple(r.print_range), r.repeat_rows and tuple(r.repeat_rows), r.repeat_columns and tuple(r.repeat_columns)) for r in spreadsheets.xlsx_print_settings(spark, path).collect()}
    assert got == {"One": (None, None, None), "Two": ((1, 0, 8, 2), (0, 2), (1, 3))}
    cells = spreadsheets.with_notes(spreadsheets.xlsx_cells(spark, path), merges, comments)
    assert sorted((r.row, r.column, r.kind, r.num, r.n_rows, r.n_columns, r.comment) for r in cells.collect()) == [(0, 0, "number", 5.0, 3, 2, "new"), (1, 1, "empty", None, 1, 1, "Ask again"), (3, 3, "empty", None, 2, 2, None)]


def test_script_tables(spark, tmp_path):
    text = """CREATE SCHEMA PUBLIC AUTHORIZATION DBA
CREATE MEMORY TABLE CUSTOMERS(ID INTEGER NOT NULL PRIMARY KEY,NAME VARCHAR(50),"Mixed Case" DECIMAL(10,2),ACTIVE BOOLEAN,SIGNUP_DATE DATE,CONSTRAINT U UNIQUE(ID))
INSERT INTO CUSTOMERS VALUES(1,'O''Brien, (x)',12.50,TRUE,'2024-01-15')
INSERT INTO CUSTOMERS(NAME,ID) VALUES('Ann',2)
INSERT INTO CUSTOMERS VALUES(3,NULL,-1,FALSE,DATE'2024-02-01')
"""
    script = scripts.statements(spark, put(tmp_path, "db.script", text))
    assert [(r.column, r.type) for r in scripts.columns(script).orderBy("position").collect()] == [("ID", "INTEGER"), ("NAME", "VARCHAR(50)"), ("Mixed Case", "DECIMAL(10,2)"), ("ACTIVE", "BOOLEAN"), ("SIGNUP_DATE", "DATE")]
    types = {"ID": "int", "NAME": "string", "Mixed Case": "decimal(10,2)", "ACTIVE": "boolean", "SIGNUP_DATE": "date"}
    rows = scripts.read_table(script, "CUSTOMERS", types).orderBy("ID").collect()
    assert [(r.ID, r.NAME, r.ACTIVE, str(r.SIGNUP_DATE)) for r in rows] == [(1, "O'Brien, (x)", True, "2024-01-15"), (2, "Ann", None, "None"), (3, None, False, "2024-02-01")]


def test_script_quotes_and_refusals(spark, tmp_path):
    head = "CREATE TABLE T(A INTEGER,B VARCHAR(9))\n"
    script = scripts.statements(spark, put(tmp_path, "q.script", head + "\r\nINSERT INTO T VALUES(1,'two\nlines, ''(x)'' ')\nSET DATABASE UNIQUE NAME X\nINSERT INTO T VALUES(2,'b')"))
    assert sorted(r.line for r in script.collect()) == [0, 2, 4, 5]
    assert sorted((r.A, r.B) for r in scripts.read_table(script, "T", {"A": "int", "B": "string"}).collect()) == [(1, "two\nlines, '(x)' "), (2, "b")]
    for name, text in (("a", "INSERT INTO T VALUES(1,'x'),(2,'y')"), ("b", "INSERT INTO T VALUES(1)"), ("c", "INSERT INTO T(B) VALUES(1,2)"), ("d", "DELETE FROM T"), ("e", "INSERT INTO T VALUES(1,'x)")):
        with pytest.raises(Exception, match="tuple|number|unknown|quote"):
            scripts.rows(scripts.statements(spark, put(tmp_path, f"{name}.script", head + text))).collect()


def test_many_records_in_linear_time(spark):
    text = "a,b\r\n" + '1,"x,\n""y"""\n\n' * 20_000
    found = spark.createDataFrame([(text,)], "t string").select(delimited.records(F.col("t")).alias("r")).select(F.size("r").alias("n"), F.col("r")[20_000].alias("last")).first()
    assert found.n == 20_001 and found["last"] == ["1", 'x,\n"y"']


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "in")
    events.repartition(3).write.parquet(folder)
    args = ("ts", ["event_type"], "value", "1 hour", "400 days")
    stream = arrivals.windowed_counts(spark.readStream.schema(events.schema).parquet(folder), *args)
    query = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination(120)
    got = sorted((r.window_start, r.event_type, r.n) for r in spark.table("counts").collect())
    assert got == sorted((r.window_start, r.event_type, r.n) for r in arrivals.windowed_counts(events, *args).collect())
    assert arrivals.sessions(events, "ts", ["user_id"], "2 hours", "1 day").selectExpr("sum(n)").first()[0] == events.count()


def test_open_document_cells(spark, tmp_path):
    names = 'xmlns:office="o" xmlns:table="t" xmlns:text="x"'
    content = f"""<office:document-content {names}><office:body><office:spreadsheet><table:table table:name="S">
      <table:table-row><table:table-cell office:value-type="string"><text:p>a</text:p><text:p>b</text:p></table:table-cell><table:table-cell table:number-columns-repeated="3"/><table:table-cell office:value-type="float" office:value="1.5"><text:p>1.5</text:p></table:table-cell></table:table-row>
      <table:table-row table:number-rows-repeated="4"><table:table-cell/></table:table-row>
      <table:table-row><table:table-cell office:value-type="boolean" office:boolean-value="true"><text:p>TRUE</text:p></table:table-cell><table:table-cell office:value-type="time" office:time-value="PT14H30M00S"><text:p>x</text:p></table:table-cell><table:table-cell office:value-type="date" office:date-value="2024-01-15"><text:p>x</text:p></table:table-cell></table:table-row>
    </table:table></office:spreadsheet></office:body></office:document-content>"""
    cells = spreadsheets.ods_cells(spark, put(tmp_path, "s.ods", zipped({"content.xml": content})))
    got = {(r.row, r.column): (r.kind, r.num, r.bool, r.text) for r in cells.collect()}
    assert got == {
        (0, 0): ("string", None, None, "a\nb"), (0, 4): ("number", 1.5, None, None), (5, 0): ("boolean", None, True, None), (5, 1): ("time", None, None, "14:30:00"), (5, 2): ("date", None, None, "2024-01-15"),
    }
    assert {r.sheet for r in cells.collect()} == {"S"}
