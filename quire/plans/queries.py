"""Registered queries over the given tables, each with DuckDB SQL where it can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quire.catalog import register
from quire.functions import cells, markup, sheets, units
from quire.operators import documents, graph, layout, relational as rel, reports, styles
from quire.operators.components import components
from quire.runtime import materialize, table
from quire.sources import delimited, spreadsheets
from quire.streaming import arrivals


@register(
    "sql_group_all_aggs",
    """SELECT l_returnflag, l_linestatus, count(*) AS n_rows, count(l_tax) AS n_tax, round(sum(l_quantity), 4) AS sum_quantity,
              round(avg(l_discount), 6) AS avg_discount, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
       FROM lineitem WHERE l_quantity BETWEEN 5 AND 45 AND l_returnflag IN ('A', 'N', 'R') GROUP BY ALL""",
)
def sql_group_all_aggs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    aggregates = [("COUNT", "*"), ("COUNT", "L_TAX"), ("SUM", "L_QUANTITY"), ("AVG", "L_DISCOUNT"), ("MIN", "L_SHIPDATE"), ("MAX", "L_SHIPDATE")]
    kept = rel.between(items, "L_QUANTITY", 5, 45) & rel.in_list(items, "L_RETURNFLAG", ["A", "N", "R"])
    keys = ["L_RETURNFLAG", "L_LINESTATUS"]
    out = rel.select(items, [*keys, *aggregates], kept, keys, [("L_RETURNFLAG", "ASC"), ("L_LINESTATUS", "DESC")])
    out = out.toDF("l_returnflag", "l_linestatus", "n_rows", "n_tax", "sum_quantity", "avg_discount", "first_ship", "last_ship")
    return out.withColumns({"sum_quantity": F.round("sum_quantity", 4), "avg_discount": F.round("avg_discount", 6)})


@register(
    "sql_project_filter",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem WHERE l_quantity > 30 AND NOT l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1997-01-01'",
)
def sql_project_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    kept = rel.compare(items, "l_quantity", ">", 30) & ~rel.compare(items, "l_returnflag", "=", "R") & rel.compare(items, "l_shipdate", ">=", "1997-01-01T00:00:00")
    return rel.select(items, ["l_orderkey", "l_linenumber", "l_quantity", "l_shipdate"], kept)


@register("sql_like", r"SELECT p_partkey, p_name, p_type FROM part WHERE p_name LIKE '%a_%' AND NOT p_type LIKE '%\%' ESCAPE '~'")
def sql_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return rel.select(parts, ["p_partkey", "p_name", "p_type"], rel.like(parts, "p_name", "%a_%") & rel.like(parts, "p_type", "%\\%", negate=True))


@register(
    "sql_three_valued",
    """WITH o AS (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status, nullif(o_custkey % 5, 0) AS bin FROM orders)
       SELECT o_orderkey, status, bin FROM o WHERE (NOT (bin IN (1, 2)) OR status = 'O') AND NOT (status = 'P' AND bin = 3)""",
)
def sql_three_valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    o = orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("status"), F.nullif(F.col("o_custkey") % 5, F.lit(0)).alias("bin"))
    kept = (rel.in_list(o, "bin", [1, 2], negate=True) | rel.compare(o, "status", "=", "O")) & ~(rel.compare(o, "status", "=", "P") & rel.compare(o, "bin", "=", 3))
    return rel.select(o, ["o_orderkey", "status", "bin"], kept)


@register("sql_null_in_list", "SELECT count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', NULL)")
def sql_null_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return rel.select(orders, [("COUNT", "*")], rel.in_list(orders, "o_orderstatus", ["F", None], negate=True)).toDF("n")


@register(
    "sql_group_null_key",
    """SELECT nullif(o_orderpriority, '1-URGENT') AS priority, count(*) AS n_rows, count(nullif(o_orderstatus, 'F')) AS n_status, min(o_orderstatus) AS low, max(o_orderstatus) AS high
       FROM orders GROUP BY 1""",
)
def sql_group_null_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    o = orders.select("o_orderkey", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("priority"), F.nullif("o_orderstatus", F.lit("F")).alias("status"), "o_orderstatus")
    made = [("COUNT", "*"), ("COUNT", "status"), ("MIN", "o_orderstatus"), ("MAX", "o_orderstatus")]
    return rel.select(o, ["priority", *made], None, ["priority"], input_order=["o_orderkey"]).toDF("priority", "n_rows", "n_status", "low", "high")


@register("sql_global_agg_empty", "SELECT count(*) AS n, sum(l_quantity) AS total, min(l_comment) AS low FROM (SELECT l_quantity, l_returnflag AS l_comment FROM lineitem WHERE l_quantity < 0)")
def sql_global_agg_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    made = [("COUNT", "*"), ("SUM", "l_quantity"), ("MIN", "l_returnflag")]
    return rel.select(items, made, rel.compare(items, "l_quantity", "<", 0)).toDF("n", "total", "low")


@register(
    "sql_order_nulls",
    """WITH c AS (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, nullif(c_nationkey, 3) AS nation FROM customer)
       SELECT c_custkey, segment, nation, row_number() OVER (PARTITION BY nation ORDER BY segment DESC NULLS FIRST, c_custkey ASC NULLS LAST) AS place FROM c""",
)
def sql_order_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.nullif("c_nationkey", F.lit(3)).alias("nation"))
    order = rel.order_columns(c, [("segment", "DESC"), ("c_custkey", "ASC")])
    return c.withColumn("place", F.row_number().over(Window.partitionBy("nation").orderBy(*order)).cast("long"))


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return joined.select(F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"), "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))


SALES = "sales AS (SELECT c_mktsegment AS segment, o_orderpriority AS priority, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders JOIN customer ON o_custkey = c_custkey)"


@register(
    "report_group_totals",
    f"""WITH {SALES}
        SELECT CAST(CASE WHEN grouping(segment) = 1 THEN 0 WHEN grouping(priority) = 1 THEN 1 ELSE 2 END AS INTEGER) AS level, segment, priority,
               count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total, CAST(max(amount) AS DOUBLE) AS largest
        FROM sales GROUP BY ROLLUP (segment, priority)""",
)
def report_group_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = {"n": F.count("*"), "total": F.sum("amount"), "largest": F.max("amount")}
    out = reports.rollup_totals(_sales(spark, sf_dir), ["segment", "priority"], totals)
    return out.withColumns({c: F.col(c).cast("double") for c in ("total", "largest")})


@register(
    "report_bands",
    f"""WITH {SALES}, totals AS (
            SELECT CASE WHEN grouping(segment) = 1 THEN 0 WHEN grouping(priority) = 1 THEN 1 ELSE 2 END AS level, segment, priority, sum(amount) AS total FROM sales GROUP BY ROLLUP (segment, priority)
        ), bands AS (
            SELECT CASE level WHEN 0 THEN 'report ' ELSE 'group ' END || side AS band, level, segment, priority, CAST(NULL AS BIGINT) AS o_orderkey, total,
                   CASE WHEN level >= 1 THEN 1 WHEN side = 'footer' THEN 2 ELSE 0 END AS s1, CASE WHEN level >= 2 THEN 1 WHEN side = 'footer' THEN 2 ELSE 0 END AS s2,
                   CASE side WHEN 'footer' THEN 2 ELSE 0 END AS place
            FROM totals, (VALUES ('header'), ('footer')) v(side)
            UNION ALL SELECT 'detail', 2, segment, priority, o_orderkey, NULL, 1, 1, 1 FROM sales
        )
        SELECT band, CAST(level AS INTEGER) AS level, segment, priority, o_orderkey, CAST(total AS DOUBLE) AS total,
               row_number() OVER (PARTITION BY segment ORDER BY s1, s2, priority NULLS LAST, place, o_orderkey) AS place_in_segment
        FROM bands""",
)
def report_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = _sales(spark, sf_dir)
    stream = reports.bands(sales, ["segment", "priority"], {"total": F.sum("amount")}, ["o_orderkey"], ["o_orderkey"])
    place = F.row_number().over(Window.partitionBy("segment").orderBy("band_order")).cast("long")
    return stream.select("band", "level", "segment", "priority", "o_orderkey", F.col("total").cast("double").alias("total"), place.alias("place_in_segment"))


BREAKS = """WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus AS status, left(o_orderpriority, 1) AS urgency, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders),
    own AS (SELECT *, row_number() OVER w = 1 OR status IS DISTINCT FROM lag(status) OVER w AS b1, urgency IS DISTINCT FROM lag(urgency) OVER w AS b2 FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    ids AS (SELECT *, sum(CAST(b1 AS INT)) OVER w AS group_1, sum(CAST(b1 OR b2 AS INT)) OVER w AS group_2 FROM own WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))"""


@register(
    "report_haschanged",
    BREAKS + """ SELECT o_custkey, o_orderkey, status, urgency, CAST(group_1 AS BIGINT) AS group_1, CAST(group_2 AS BIGINT) AS group_2,
                        CAST(sum(amount) OVER (PARTITION BY o_custkey, group_1) AS DOUBLE) AS status_total FROM ids""",
)
def report_haschanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    rows = orders.select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"), reports.left(F.col("o_orderpriority"), 1).alias("urgency"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    ids = reports.break_ids(rows, ["status", "urgency"], ["o_orderkey"], ["o_custkey"])
    done = reports.scoped(ids, {"status_total": F.sum("amount")}, ["o_custkey"], 1)
    return done.select("o_custkey", "o_orderkey", "status", "urgency", "group_1", "group_2", F.col("status_total").cast("double").alias("status_total"))


TYPED = """WITH texts AS (
    SELECT l_orderkey, l_linenumber, CASE (l_orderkey + l_linenumber) % 10
        WHEN 0 THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR) WHEN 1 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '%'
        WHEN 2 THEN '$' || printf('%.2f', l_extendedprice) WHEN 3 THEN CASE WHEN l_returnflag = 'R' THEN 'TRUE' ELSE 'false' END
        WHEN 4 THEN '0' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) WHEN 5 THEN '1,' || printf('%03d', CAST(l_quantity AS INTEGER))
        WHEN 6 THEN '-' || printf('%.1f', l_quantity + 0.5) WHEN 7 THEN '1,000,' || printf('%03d', CAST(l_quantity AS INTEGER))
        WHEN 8 THEN '' ELSE l_linestatus END AS text FROM lineitem)"""


@register(
    "cell_typing_values",
    TYPED + """, kinds AS (SELECT *, CASE WHEN text = '' THEN 'empty' WHEN lower(text) IN ('true', 'false') THEN 'boolean' WHEN regexp_full_match(text, '\\d{4}-\\d\\d-\\d\\d') THEN 'date'
            WHEN text LIKE '$%' THEN 'currency' WHEN text LIKE '%\\%' ESCAPE '\\' THEN 'percentage'
            WHEN regexp_full_match(text, '-?(0|[1-9]\\d*)(\\.\\d+)?') OR regexp_full_match(text, '[1-9]\\d{0,2}(,\\d{3}){2,}') THEN 'number' ELSE 'string' END AS kind FROM texts)
        SELECT l_orderkey, l_linenumber, kind,
               round(CASE kind WHEN 'currency' THEN CAST(text[2:] AS DOUBLE) WHEN 'percentage' THEN CAST(text[:-2] AS DOUBLE) / 100 WHEN 'number' THEN CAST(replace(text, ',', '') AS DOUBLE) END, 6) AS num
        FROM kinds""".replace("\\\\", "\\"),
)
def cell_typing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    quantity, which = F.col("l_quantity").cast("int"), F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(10))
    made = [
        F.date_format("l_shipdate", "yyyy-MM-dd"),
        F.concat(quantity.cast("string"), F.lit("%")),
        F.concat(F.lit("$"), F.format_string("%.2f", "l_extendedprice")),
        F.when(F.col("l_returnflag") == "R", "TRUE").otherwise("false"),
        F.concat(F.lit("0"), quantity.cast("string")),
        F.concat(F.lit("1,"), F.format_string("%03d", quantity)),
        F.concat(F.lit("-"), F.format_string("%.1f", F.col("l_quantity") + 0.5)),
        F.concat(F.lit("1,000,"), F.format_string("%03d", quantity)),
        F.lit(""),
    ]
    text = F.col("l_linestatus")
    for i, value in enumerate(made):
        text = F.when(which == i, value).otherwise(text)
    cell = items.select("l_orderkey", "l_linenumber", cells.infer_cell(text).alias("cell"))
    return cell.select("l_orderkey", "l_linenumber", "cell.kind", F.round("cell.num", 6).alias("num"))


@register("display_text", "SELECT l_orderkey, l_linenumber, regexp_replace(CAST(l_quantity AS VARCHAR), '\\.0$', '') AS quantity, regexp_replace(CAST(l_discount AS VARCHAR), '\\.0$', '') AS discount FROM lineitem")
def display_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.select("l_orderkey", "l_linenumber", cells.number_text(F.col("l_quantity")).alias("quantity"), cells.number_text(F.col("l_discount")).alias("discount"))


@register(
    "serial_roundtrip",
    """SELECT l_orderkey, l_linenumber, CAST(date_diff('day', DATE '1899-12-30', CAST(l_shipdate AS DATE)) AS INTEGER) AS serial, CAST(date_diff('day', DATE '1904-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS serial_1904,
              CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) + INTERVAL 12 HOUR AS back FROM lineitem""",
)
def serial_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    day = F.to_date("l_shipdate")
    serial = sheets.date_to_serial(day)
    return items.select("l_orderkey", "l_linenumber", serial.alias("serial"), sheets.date_to_serial(day, True).alias("serial_1904"), sheets.serial_to_timestamp(serial + F.lit(0.5)).alias("back"))


@register(
    "reference_roundtrip",
    "SELECT l_orderkey, l_linenumber, CAST(l_partkey % 18278 AS BIGINT) AS column_index, CAST(l_orderkey AS BIGINT) AS row_index FROM lineitem",
)
def reference_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    named = items.select("l_orderkey", "l_linenumber", sheets.reference(F.col("l_orderkey"), F.col("l_partkey") % 18278).alias("ref"))
    return named.select("l_orderkey", "l_linenumber", sheets.parse_reference(F.col("ref")).alias("at")).select("l_orderkey", "l_linenumber", F.col("at.column").alias("column_index"), F.col("at.row").alias("row_index"))


@register(
    "csv_fields",
    """SELECT doc_id, CASE WHEN contains(t, ',') OR contains(t, '"') OR contains(t, chr(10)) OR contains(t, chr(13)) THEN '"' || replace(t, '"', '""') || '"' ELSE t END AS field
       FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
)
def csv_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", sheets.csv_field(F.col("text")).alias("field"))


@register(
    "content_hash_dedup",
    "SELECT sha256('{\"lang\":' || to_json(lang) || ',\"text\":' || to_json(text) || '}') AS node_id, min(doc_id) AS doc_id, count(*) AS n_docs FROM documents GROUP BY 1",
)
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hashed = docs.select("doc_id", graph.content_hash({"text": F.col("text"), "lang": F.col("lang")}).alias("node_id"))
    return hashed.groupBy("node_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_docs"))


def _geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment edges region -> nation -> customer."""
    nations, customers = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    upper = nations.select(F.concat(F.lit("r"), "n_regionkey").alias("p"), F.concat(F.lit("n"), "n_nationkey").alias("c"), F.col("n_nationkey").cast("long").alias("o"))
    lower = customers.select(F.concat(F.lit("n"), "c_nationkey").alias("p"), F.concat(F.lit("c"), "c_custkey").alias("c"), F.col("c_custkey").alias("o"))
    return graph.containment(upper.unionByName(lower), "p", "c", "o")


EDGES = """edges AS (
    SELECT 'r' || n_regionkey AS from_id, 'n' || n_nationkey AS to_id, lpad(lower(to_base(n_nationkey * 1000, 36)), 8, '0') AS order_key FROM nation
    UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, lpad(lower(to_base(c_custkey * 1000, 36)), 8, '0') FROM customer)"""


@register("graph_edges", f"WITH {EDGES} SELECT from_id, to_id, 'CONTAINS' AS kind, order_key FROM edges")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _geography(spark, sf_dir)


@register(
    "graph_walk",
    f"""WITH RECURSIVE {EDGES}, walk AS (
            SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth, '' AS keys FROM region
            UNION ALL SELECT root, to_id, depth + 1, keys || '/' || order_key FROM walk JOIN edges ON from_id = node)
        SELECT root, node, CAST(depth AS INTEGER) AS depth, keys FROM walk""",
)
def graph_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    found = graph.walk(_geography(spark, sf_dir), roots)
    return found.select("root", "node", "depth", F.array_join(F.transform("keys", lambda k: F.concat(F.lit("/"), k)), "").alias("keys"))


@register(
    "graph_merkle",
    """WITH leaf AS (SELECT conv_id, turn, sha256(role || chr(10) || text) AS id FROM conversations),
            turns AS (SELECT conv_id, turn, sha256(id) AS id FROM leaf)
       SELECT conv_id, sha256(string_agg(id, ',' ORDER BY lpad(CAST(turn AS VARCHAR), 8, '0'))) AS node_id FROM turns GROUP BY conv_id""",
)
def graph_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    leaf = turns.select("conv_id", F.lpad(F.col("turn").cast("string"), 8, "0").alias("turn"), F.sha2(F.concat("role", F.lit("\n"), "text").cast("binary"), 256).alias("leaf"))
    return graph.merkle_ids(leaf, ["conv_id", "turn"], "leaf")[-1].select("conv_id", F.col("id").alias("node_id"))


@register(
    "graph_components",
    "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS component FROM documents QUALIFY count(*) OVER (PARTITION BY text) > 1",
)
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of equal texts, linked as chains of neighbouring ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    links = docs.join(materialize(first), "h").select(F.col("doc_id").alias("src"), F.col("first").alias("dst"))
    found = components(links)
    return found.select(F.col("node").alias("doc_id"), "component")


LINES = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"""


@register(
    "md_line_kinds",
    f"""WITH {LINES}
        SELECT CASE WHEN regexp_full_match(line, '[ \\t]*') THEN 'blank' WHEN regexp_matches(line, '^ {{0,3}}#{{1,6}}([ \\t]|$)') THEN 'heading'
               WHEN regexp_full_match(line, ' {{0,3}}((\\*[ \\t]*){{3,}}|(-[ \\t]*){{3,}}|(_[ \\t]*){{3,}})') THEN 'thematicBreak' WHEN regexp_full_match(line, ' {{0,3}}(`{{3,}}[^`]*|~{{3,}}.*)') THEN 'codeFence'
               WHEN regexp_matches(line, '^ {{0,3}}>') THEN 'blockquote' WHEN regexp_matches(line, '^ {{0,3}}([-+*]|[0-9]{{1,9}}[.)])([ \\t]|$)') THEN 'listItem'
               WHEN regexp_matches(line, '^ {{0,3}}<([A-Za-z][A-Za-z0-9-]*[ \\t/>]|/[A-Za-z]|!--|\\?)') THEN 'htmlBlock' WHEN regexp_full_match(line, ' {{0,3}}\\|.*\\|[ \\t]*') THEN 'tableRow'
               WHEN regexp_matches(line, '^(    |\\t)') THEN 'codeBlock' ELSE 'paragraph' END AS kind, count(*) AS n
        FROM lines GROUP BY 1""",
)
def md_line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.groupBy(documents.line_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


@register(
    "md_blocks",
    r"""WITH l AS (SELECT doc_id AS doc, string_split_regex(text, '\r\n|\r|\n') AS ls FROM documents),
             lines AS (SELECT doc, unnest(ls) AS line, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS line_no FROM l),
             kinds AS (SELECT *, CASE WHEN regexp_full_match(line, '[ \t]*') THEN 'blank' WHEN regexp_matches(line, '^ {0,3}#{1,6}([ \t]|$)') THEN 'heading'
                   WHEN regexp_full_match(line, ' {0,3}((\*[ \t]*){3,}|(-[ \t]*){3,}|(_[ \t]*){3,})') THEN 'thematicBreak' WHEN regexp_full_match(line, ' {0,3}(`{3,}[^`]*|~{3,}.*)') THEN 'codeFence'
                   WHEN regexp_matches(line, '^ {0,3}>') THEN 'blockquote' WHEN regexp_matches(line, '^ {0,3}([-+*]|[0-9]{1,9}[.)])([ \t]|$)') THEN 'listItem'
                   WHEN regexp_matches(line, '^ {0,3}<([A-Za-z][A-Za-z0-9-]*[ \t/>]|/[A-Za-z]|!--|\?)') THEN 'htmlBlock' WHEN regexp_full_match(line, ' {0,3}\|.*\|[ \t]*') THEN 'tableRow'
                   WHEN regexp_matches(line, '^(    |\t)') THEN 'codeBlock' ELSE 'paragraph' END AS kind0 FROM lines),
             fences AS (SELECT *, coalesce(sum(CAST(kind0 = 'codeFence' AS INT)) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS fenced FROM kinds),
             owned AS (SELECT *, CASE WHEN fenced OR kind0 = 'codeFence' THEN 'codeBlock' ELSE kind0 END AS own FROM fences),
             seen AS (SELECT *, lag(own) OVER w AS before, lag(fenced) OVER w AS was_fenced, lag(kind0) OVER w AS was FROM owned WINDOW w AS (PARTITION BY doc ORDER BY line_no)),
             starts AS (SELECT *, NOT coalesce(((own IN ('paragraph', 'blockquote', 'tableRow', 'htmlBlock', 'codeBlock') AND before = own) OR (own = 'paragraph' AND before IN ('blockquote', 'listItem', 'htmlBlock')))
                   AND NOT (kind0 = 'codeFence' AND NOT fenced) AND NOT (before = 'codeBlock' AND was_fenced AND was = 'codeFence'), false) AS opens FROM seen),
             blocks AS (SELECT *, CAST(sum(CAST(opens AS INT)) OVER (PARTITION BY doc ORDER BY line_no) - 1 AS BIGINT) AS block FROM starts)
        SELECT doc, block, arg_min(own, line_no) AS kind, CASE WHEN arg_min(own, line_no) = 'heading' THEN CAST(length(regexp_extract(trim(arg_min(line, line_no)), '^#+')) AS INTEGER) END AS level,
               min(line_no) AS first_line, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY line_no) AS text
        FROM blocks WHERE own <> 'blank' OR fenced GROUP BY doc, block""",
)
def md_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.markdown_blocks(table(spark, sf_dir, "documents"))


@register(
    "outline_tree",
    """WITH t AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level FROM conversations)
       SELECT a.conv_id, a.turn, CAST(a.level AS INTEGER) AS level, max(b.turn) AS parent
       FROM t a LEFT JOIN t b ON b.conv_id = a.conv_id AND b.turn < a.turn AND b.level < a.level GROUP BY ALL""",
)
def outline_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    return documents.outline(turns.select("conv_id", "turn", level.alias("level")), "conv_id", "turn", "level")


@register(
    "chunk_leaves",
    """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal, 'blocks[' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || ']' AS source_path,
              sha256(text) AS leaf_hash, length(text) AS n_chars FROM conversations""",
)
def chunk_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.leaves(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@register(
    "sections_at_users",
    "SELECT conv_id, turn, CAST(sum(CAST(role = 'user' AND n > 1 AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS section FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)",
)
def sections_at_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.sections_at(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "section")


@register(
    "layout_modes",
    """WITH c AS (SELECT p_brand, floor(p_size / 5.0 + 0.5) * 5 AS mode, count(*) AS n FROM part GROUP BY ALL)
       SELECT p_brand, CAST(mode AS DOUBLE) AS mode, n FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, mode) = 1""",
)
def layout_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.modes(table(spark, sf_dir, "part"), ["p_brand"], "p_size", 5.0)


@register(
    "layout_heading_levels",
    """WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL), m AS (SELECT p_brand, p_size AS mode FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) = 1)
       SELECT p_brand, p_size, CAST(least(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC), 6) AS INTEGER) AS level FROM c JOIN m USING (p_brand) WHERE p_size >= mode + 2""",
)
def layout_heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.heading_levels(table(spark, sf_dir, "part"), ["p_brand"], "p_size")


@register(
    "layout_gap_runs",
    """SELECT event_id, user_id, CAST(sum(CAST(coalesce(ts - before > INTERVAL 6 HOUR, false) AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run
       FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)""",
)
def layout_gap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    gap = F.col("ts") - before > F.expr("INTERVAL '6' HOUR")
    return layout.runs_by_gap(events, ["user_id"], ["ts", "event_id"], gap).select("event_id", "user_id", "run")


@register(
    "layout_merged_intervals",
    """WITH i AS (SELECT l_suppkey, epoch(l_shipdate) / 86400 AS s, epoch(l_shipdate) / 86400 + l_quantity / 10 AS e, l_orderkey, l_linenumber FROM lineitem),
            r AS (SELECT *, max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
            g AS (SELECT *, sum(CAST(reach IS NULL OR s > reach AS INT)) OVER (PARTITION BY l_suppkey ORDER BY s, e) AS island FROM r)
       SELECT l_suppkey, CAST(min(s) AS DOUBLE) AS s, round(max(e), 6) AS e, count(*) AS n FROM g GROUP BY l_suppkey, island""",
)
def layout_merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    start = F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")).cast("double")
    rows = items.select("l_suppkey", start.alias("s"), (start + F.col("l_quantity") / 10).alias("e"))
    return layout.merge_intervals(rows, ["l_suppkey"], "s", "e").withColumn("e", F.round("e", 6))


@register(
    "layout_grid",
    """WITH b AS (SELECT DISTINCT p_brand, p_size * 2000.0 AS low, p_size * 2000.0 + 2000 AS high FROM part WHERE p_size % 3 = 0)
       SELECT l_orderkey, l_linenumber, p_brand, CAST(low AS DOUBLE) AS low FROM lineitem JOIN part ON l_partkey = p_partkey JOIN b USING (p_brand) WHERE l_extendedprice >= low AND l_extendedprice < high""",
)
def layout_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    points = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_brand", "l_extendedprice")
    low = (F.col("p_size") * 2000).cast("double")
    bounds = parts.where("p_size % 3 = 0").select("p_brand", low.alias("low"), (low + 2000).alias("high")).distinct()
    return layout.assign_to_grid(points, bounds, ["p_brand"], "l_extendedprice", "low", "high", 2000.0).select("l_orderkey", "l_linenumber", "p_brand", "low")


@register(
    "layout_leader_lines",
    """WITH RECURSIVE i AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS y FROM lineitem GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM i),
            r AS (SELECT *, [y] AS leaders, CAST(0 AS BIGINT) AS line FROM n WHERE k = 1
                  UNION ALL SELECT n.*, CASE WHEN hit = 0 THEN list_append(r.leaders, n.y) ELSE r.leaders END, CASE WHEN hit = 0 THEN len(r.leaders) ELSE hit - 1 END
                  FROM r JOIN n ON n.l_orderkey = r.l_orderkey AND n.k = r.k + 1, LATERAL (SELECT coalesce(list_position([abs(x - n.y) <= 5 FOR x IN r.leaders], true), 0) AS hit) h)
       SELECT l_orderkey, l_linenumber, y, CAST(10 AS DOUBLE) AS size, line FROM r""",
)
def layout_leader_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-fit lines of each order's items, quantities as baselines."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("y")).withColumn("size", F.lit(10.0))
    return layout.lines_by_leader(items, ["l_orderkey"], "y", "size", "l_linenumber")


@register(
    "marks_balanced",
    """WITH m AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS step FROM events),
            d AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY event_id) AS depth FROM m)
       SELECT user_id, min(depth) >= 0 AND sum(step) = 0 AS balanced FROM d GROUP BY user_id""",
)
def marks_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    step = F.when(F.col("event_id") % 3 == 0, -1).otherwise(1)
    return documents.balanced(events.select("user_id", "event_id", step.alias("step")), "user_id", "event_id", "step")


@register("csv_roundtrip", "SELECT doc_id, coalesce(text, '') AS text, source FROM documents")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    line = F.concat_ws(",", sheets.csv_field(F.col("text")), sheets.csv_field(F.col("source")))
    back = docs.select("doc_id", delimited.records(line)[0].alias("fields"))
    return back.select("doc_id", F.col("fields")[0].alias("text"), F.col("fields")[1].alias("source"))


@register(
    "markup_escape",
    """SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&apos;') AS escaped, text AS back FROM documents""",
)
def markup_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", markup.escape(F.col("text")).alias("escaped"))
    return docs.withColumn("back", markup.unescape(F.col("escaped")))


@register(
    "markup_autolinks",
    r"""SELECT doc_id, 'mailto:' || unnest(regexp_extract_all(text, '[A-Za-z0-9._+-]+@([A-Za-z0-9_-]+\.)+[A-Za-z0-9_-]*[A-Za-z0-9]')) AS target FROM documents""",
)
def markup_autolinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(markup.autolinks(F.col("text"))).alias("target"))


@register(
    "unit_lengths",
    "SELECT p_partkey, round(p_size * 72 / 2.54, 6) AS points, round(p_size * 914400 / 25.4, 4) AS emu, '#' || lpad(lower(to_hex(p_partkey % 16777216)), 6, '0') AS colour FROM part",
)
def unit_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    code = F.lpad(F.hex(F.col("p_partkey") % (1 << 24)), 6, "0")
    rgb = parts.select("p_partkey", "p_size", units.parse_colour(code).alias("c"))
    points = units.parse_length(F.concat(F.col("p_size").cast("string"), F.lit("cm")))
    emu = units.convert(F.col("p_size"), "mm", "emu")
    return rgb.select("p_partkey", F.round(points, 6).alias("points"), F.round(emu, 4).alias("emu"), units.colour(F.col("c.r"), F.col("c.g"), F.col("c.b")).alias("colour"))


@register(
    "style_inheritance",
    """SELECT 'c' || c_custkey AS id, coalesce(nullif(c_mktsegment, 'BUILDING'), CASE WHEN n_nationkey % 2 = 0 THEN n_name END, r_name) AS face
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def style_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers take a property from their nation, and nations from their region."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    top = region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("based_on"), F.col("r_name").alias("face"))
    mid = nation.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")))
    low = customer.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), F.nullif("c_mktsegment", F.lit("BUILDING")))
    return styles.inherit(top.union(mid).union(low), "id", "based_on", ["face"]).where("id LIKE 'c%'")


@register("style_tuples", "SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY ALL HAVING count(*) >= 2")
def style_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styles.common_tuples(table(spark, sf_dir, "part"), ["p_brand"], ["p_type"], "p_partkey")


@register(
    "table_to_cells",
    """WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey DESC) AS row FROM orders)
       SELECT 'orders' AS sheet, row, 0 AS "column", CAST(o_orderkey AS VARCHAR) AS text FROM n UNION ALL SELECT 'orders', row, 1, o_orderpriority FROM n UNION ALL SELECT 'orders', row, 2, CAST(o_custkey AS VARCHAR) FROM n
       UNION ALL VALUES ('orders', 0, 0, 'o_orderkey'), ('orders', 0, 1, 'o_orderpriority'), ('orders', 0, 2, 'o_custkey')""",
)
def table_to_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    return spreadsheets.table_cells(orders, [F.col("o_orderkey").desc()], "orders")


@register(
    "event_windows",
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
)
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = arrivals.windowed_counts(events, "ts", ["event_type"], "value", "1 hour", "10 minutes")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
