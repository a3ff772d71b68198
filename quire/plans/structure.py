"""Registered queries of joins, trees, page structure and the wider SELECT, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.catalog import register
from quire.functions import markup, sheets, units
from quire.operators import documents, joins, layout, paths, styles
from quire.runtime import table


@register(
    "join_as_of",
    """SELECT l.event_id, l.user_id, l.ts, arg_max(r.event_id, (r.ts, r.event_id)) AS event_id_as_of, arg_max(r.value, (r.ts, r.event_id)) AS value_as_of
       FROM events l LEFT JOIN events r ON r.user_id = l.user_id AND r.ts <= l.ts AND r.event_id % 3 <> 0 WHERE l.event_id % 3 = 0 GROUP BY ALL""",
)
def join_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    left = events.where("event_id % 3 = 0").select("event_id", "user_id", "ts")
    return joins.as_of(left, events.where("event_id % 3 <> 0"), ["user_id"], "ts", ["event_id", "value"])


@register(
    "join_nearest",
    """SELECT l.c_custkey, l.c_nationkey, l.c_acctbal, r.c_custkey AS nearest, abs(l.c_acctbal - r.c_acctbal) AS distance
       FROM (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') l LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') r ON r.c_nationkey = l.c_nationkey
       QUALIFY row_number() OVER (PARTITION BY l.c_custkey ORDER BY abs(l.c_acctbal - r.c_acctbal), r.c_acctbal > l.c_acctbal, CASE WHEN r.c_acctbal > l.c_acctbal THEN r.c_custkey ELSE -r.c_custkey END) = 1""",
)
def join_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    left = customers.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_nationkey", "c_acctbal")
    return joins.nearest(left, customers.where("c_mktsegment <> 'BUILDING'"), ["c_nationkey"], "c_acctbal", "c_custkey")


@register(
    "join_largest_overlap",
    """WITH b AS (SELECT l_orderkey, l_linenumber AS box, l_linenumber * 10.0 AS x1, l_linenumber * 10.0 + l_quantity AS x2, 0.0 AS y1, 10.0 AS y2 FROM lineitem),
            a AS (SELECT l_orderkey, l_linenumber AS area, l_linenumber * 12.0 + 3 AS x1, l_linenumber * 12.0 + 18 AS x2, l_discount * 50 AS y1, l_discount * 50 + 6 AS y2 FROM lineitem),
            m AS (SELECT l_orderkey, box, area, (least(b.x2, a.x2) - greatest(b.x1, a.x1)) * (least(b.y2, a.y2) - greatest(b.y1, a.y1)) AS shared FROM b JOIN a USING (l_orderkey)
                  WHERE least(b.x2, a.x2) > greatest(b.x1, a.x1) AND least(b.y2, a.y2) > greatest(b.y1, a.y1))
       SELECT l_orderkey, box, area, round(shared, 6) AS shared FROM m QUALIFY row_number() OVER (PARTITION BY l_orderkey, box ORDER BY shared DESC, area) = 1""",
)
def join_largest_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    left, top = F.col("l_linenumber") * F.lit(10.0), F.col("l_discount") * 50
    boxes = items.select("l_orderkey", F.col("l_linenumber").alias("box"), left.alias("x1"), (left + F.col("l_quantity")).alias("x2"), F.lit(0.0).alias("y1"), F.lit(10.0).alias("y2"))
    at = F.col("l_linenumber") * F.lit(12.0)
    areas = items.select("l_orderkey", F.col("l_linenumber").alias("area"), (at + 3).alias("x1"), (at + 18).alias("x2"), top.alias("y1"), (top + 6).alias("y2"))
    return joins.largest_overlap(boxes, areas, ["l_orderkey"], "box", "area", 20.0).withColumn("shared", F.round("shared", 6))


@register(
    "join_full_default",
    """WITH f AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), o AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
       SELECT coalesce(f.o_custkey, o.o_custkey) AS o_custkey, coalesce(n, 0) AS n, top FROM f FULL JOIN o ON f.o_custkey = o.o_custkey""",
)
def join_full_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides' customers: those that only the right side has count no orders."""
    orders = table(spark, sf_dir, "orders")
    filled = orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    open_ = orders.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    return joins.outer_with_default(filled, open_, ["o_custkey"], {"n": F.lit(0).cast("long")})


@register(
    "join_with_fallback",
    """WITH t AS (SELECT * FROM part WHERE p_size > 40), x AS (SELECT p_brand, p_type, min(p_partkey) AS k FROM t GROUP BY ALL), y AS (SELECT p_brand, min(p_partkey) AS k FROM t GROUP BY ALL)
       SELECT p.p_partkey, p.p_brand, p.p_type, coalesce(x.k, y.k) AS match FROM part p LEFT JOIN x ON x.p_brand = p.p_brand AND x.p_type = p.p_type LEFT JOIN y ON y.p_brand = p.p_brand""",
)
def join_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    large = parts.where("p_size > 40").select("p_brand", "p_type", F.col("p_partkey").alias("match"))
    return joins.with_fallback(parts.select("p_partkey", "p_brand", "p_type"), large, ["p_brand", "p_type"], ["p_brand"], "match")


@register(
    "join_semi_anti",
    """SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS urgent FROM customer
       WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""",
)
def join_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders")
    placed = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    pending = orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return customers.join(placed, "c_custkey").join(pending, "c_custkey", "left_anti")


@register(
    "nearest_ancestor",
    """WITH RECURSIVE up AS (SELECT c_custkey, c_custkey AS at FROM customer UNION ALL SELECT u.c_custkey, u.at // 2 FROM up u JOIN customer c ON c.c_custkey = u.at WHERE c.c_mktsegment <> 'BUILDING' AND u.at > 1),
            best AS (SELECT u.c_custkey, max(u.at) AS ancestor FROM up u JOIN customer c ON c.c_custkey = u.at WHERE c.c_mktsegment = 'BUILDING' GROUP BY 1)
       SELECT c_custkey, ancestor FROM customer LEFT JOIN best USING (c_custkey)""",
)
def nearest_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a tree, each under half its key; the ancestors asked for are of one segment."""
    customers = table(spark, sf_dir, "customer")
    nodes = customers.select("c_custkey", F.when(F.col("c_custkey") > 1, F.floor(F.col("c_custkey") / 2)).alias("up"), (F.col("c_mktsegment") == "BUILDING").alias("chosen"))
    return joins.nearest_ancestor(nodes, "c_custkey", "up", "chosen")


@register("repeated_ids", "SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return joins.repeated_ids(docs, "h")


@register(
    "flatten_tree",
    """WITH t AS (SELECT CAST(r_regionkey AS BIGINT) AS region, CAST(-1 AS BIGINT) AS nation, CAST(-1 AS BIGINT) AS customer, 'r' || r_regionkey AS id FROM region
            UNION ALL SELECT n_regionkey, n_nationkey, -1, 'n' || n_nationkey FROM nation UNION ALL SELECT n_regionkey, n_nationkey, c_custkey, 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
       SELECT id, row_number() OVER (PARTITION BY region ORDER BY nation, customer) - 1 AS place FROM t""",
)
def flatten_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers in reading order, numbered within their region."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    nodes = region.select(name("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("up"), F.col("r_regionkey").cast("long").alias("at"))
    nodes = nodes.union(nation.select(name("n", "n_nationkey"), name("r", "n_regionkey"), F.col("n_nationkey").cast("long")))
    nodes = nodes.union(customer.select(name("c", "c_custkey"), name("n", "c_nationkey"), "c_custkey"))
    flat = documents.flatten(nodes, "id", "up", "at")
    place = F.row_number().over(Window.partitionBy(F.col("path")[0]).orderBy("path")) - 1
    return flat.select("id", place.cast("long").alias("place"))


@register(
    "style_chain_edges",
    """SELECT c_custkey, 'n' || c_nationkey AS ref, 'r' || n_regionkey AS style, 0 AS place FROM customer JOIN nation ON c_nationkey = n_nationkey
       UNION ALL SELECT c_custkey, 'n' || c_nationkey, 'n' || c_nationkey, 1 FROM customer""",
)
def style_chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    known = region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("up"))
    known = known.union(nation.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")))
    rows = customer.select("c_custkey", F.concat(F.lit("n"), "c_nationkey").alias("ref"))
    return styles.chain_edges(rows, "ref", known, "id", "up")


ITEMS = "i AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)"
PAGE = f"""{ITEMS}, l AS (SELECT l_orderkey, l_linenumber, 1000.0 - l_linenumber * 12 - CASE WHEN l_returnflag = 'R' THEN 20 ELSE 0 END AS y,
                 50.0 + CASE WHEN l_linestatus = 'O' AND l_quantity > 25 THEN 20 ELSE 0 END AS x, 10.0 + CASE WHEN l_quantity > 45 THEN 2 ELSE 0 END AS size FROM i)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item for each line of an order; the table repeats some."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.max(c).alias(c) for c in ("l_returnflag", "l_linestatus", "l_quantity")))


@register(
    "layout_paragraphs",
    f"""WITH {PAGE}, s AS (SELECT *, lag(y) OVER w - y AS step, lag(x) OVER w AS px, lag(size) OVER w AS ps FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
            steps AS (SELECT l_orderkey, round(step * 2) / 2 AS spot, count(*) AS n, min(l_linenumber) AS met FROM s WHERE step IS NOT NULL GROUP BY 1, 2),
            sizes AS (SELECT l_orderkey, round(size * 2) / 2 AS spot, count(*) AS n, min(l_linenumber) AS met FROM s GROUP BY 1, 2),
            ms AS (SELECT l_orderkey, CASE WHEN (SELECT count(*) FROM s z WHERE z.l_orderkey = p.l_orderkey) < 3 THEN 1.2 * (SELECT spot FROM sizes z WHERE z.l_orderkey = p.l_orderkey ORDER BY n DESC, met LIMIT 1)
                       WHEN (SELECT max(n) FROM steps z WHERE z.l_orderkey = p.l_orderkey) > 1 THEN (SELECT spot FROM steps z WHERE z.l_orderkey = p.l_orderkey ORDER BY n DESC, met LIMIT 1)
                       ELSE (SELECT min(step) FROM s z WHERE z.l_orderkey = p.l_orderkey) END AS spacing FROM (SELECT DISTINCT l_orderkey FROM s) p),
            me AS (SELECT l_orderkey, floor(x + 0.5) AS edge FROM s GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, floor(x + 0.5)) = 1),
            b AS (SELECT s.*, coalesce(step > 1.25 * spacing OR abs(size - ps) > 0.5 OR (abs(x - edge) > size AND abs(px - edge) <= size), false) AS fresh FROM s LEFT JOIN ms USING (l_orderkey) LEFT JOIN me USING (l_orderkey))
        SELECT l_orderkey, l_linenumber, CAST(sum(CAST(fresh AS INT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS paragraph FROM b""",
)
def layout_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages made of each order's items."""
    items = _items(spark, sf_dir)
    y = F.lit(1000.0) - F.col("l_linenumber") * 12 - F.when(F.col("l_returnflag") == "R", 20).otherwise(0)
    x = F.lit(50.0) + F.when((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 25), 20).otherwise(0)
    size = F.lit(10.0) + F.when(F.col("l_quantity") > 45, 2).otherwise(0)
    lines = items.select("l_orderkey", "l_linenumber", y.alias("y"), x.alias("x"), size.alias("size"))
    return layout.paragraphs(lines, ["l_orderkey"], "y", "x", "size", "l_linenumber").select("l_orderkey", "l_linenumber", "paragraph")


@register(
    "layout_spaced_text",
    f"""WITH {ITEMS}, g AS (SELECT *, l_linenumber * 30.0 - lag(l_linenumber * 30.0 + l_quantity / 2) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS gap FROM i)
       SELECT l_orderkey, string_agg(CASE WHEN gap > 20 THEN chr(9) WHEN gap > 0.5 THEN ' ' ELSE '' END || l_returnflag, '' ORDER BY l_linenumber) AS text FROM g GROUP BY 1""",
)
def layout_spaced_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    placed = items.select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * F.lit(30.0)).alias("x"), (F.col("l_quantity") / 2).alias("width"), F.lit(10.0).alias("size"), F.col("l_returnflag").alias("text"))
    return layout.spaced_text(placed, ["l_orderkey"], "x", "width", "size", "text", ["l_linenumber"])


@register(
    "layout_page_bands",
    """WITH RECURSIVE n AS (SELECT o_custkey, o_orderkey, o_totalprice AS s, o_orderpriority = '1-URGENT' AS b, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
            r AS (SELECT *, CAST(0 AS BIGINT) AS band, s AS used FROM n WHERE k = 1
                  UNION ALL SELECT n.*, r.band + CAST(n.b OR r.used + n.s > 300000 AS BIGINT), CASE WHEN n.b OR r.used + n.s > 300000 THEN n.s ELSE r.used + n.s END FROM r JOIN n ON n.o_custkey = r.o_custkey AND n.k = r.k + 1)
       SELECT o_custkey, o_orderkey, band FROM r""",
)
def layout_page_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("manual", F.col("o_orderpriority") == "1-URGENT")
    return layout.page_bands(orders, ["o_custkey"], "o_orderkey", "o_totalprice", 300_000.0, "manual")


@register(
    "paint_order",
    """WITH e AS (SELECT user_id, event_id, CASE WHEN user_id % 4 = 0 AND event_id % 5 = 0 THEN NULL ELSE value END AS z, CASE WHEN event_id % 2 = 1 THEN 'vector' ELSE 'shape' END AS kind FROM events),
            g AS (SELECT *, CASE WHEN count(z) OVER (PARTITION BY user_id) = count(*) OVER (PARTITION BY user_id) THEN z END AS o FROM e)
       SELECT user_id, event_id, z, kind, row_number() OVER (PARTITION BY user_id ORDER BY o, kind = 'shape', event_id) - 1 AS place FROM g""",
)
def paint_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    z = F.when((F.col("user_id") % 4 == 0) & (F.col("event_id") % 5 == 0), None).otherwise(F.col("value"))
    items = events.select("user_id", "event_id", z.alias("z"))
    return layout.paint_order(items.where("event_id % 2 = 1"), items.where("event_id % 2 = 0"), "user_id", "z", "event_id")


@register(
    "list_ids",
    """SELECT l_orderkey, l_linenumber, 'md' || l_orderkey || ':' || CASE WHEN l_returnflag = 'A' THEN 'ordered' || CASE WHEN l_linenumber <> 1 THEN '@' || l_linenumber ELSE '' END ELSE 'bullet' END
              || CASE WHEN l_linestatus = 'F' THEN '+task' ELSE '' END || CASE WHEN l_quantity > 25 THEN '+loose' ELSE '' END AS id,
              CASE WHEN l_returnflag = 'A' AND l_linenumber <> 1 THEN l_linenumber END AS start, l_linestatus = 'F' AS task, l_quantity > 25 AS loose FROM lineitem""",
)
def list_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    made = markup.list_id(F.col("l_orderkey"), F.col("l_returnflag") == "A", F.col("l_linenumber"), F.col("l_linestatus") == "F", F.col("l_quantity") > 25)
    back = items.select("l_orderkey", "l_linenumber", made.alias("id")).withColumn("b", markup.parse_list_id(F.col("id")))
    return back.select("l_orderkey", "l_linenumber", "id", "b.start", "b.task", "b.loose")


@register(
    "cell_ranges",
    """SELECT l_orderkey, l_linenumber, least(l_partkey, l_suppkey) AS top, CAST(least(l_linenumber, 3) AS BIGINT) AS "left", greatest(l_partkey, l_suppkey) AS bottom, CAST(greatest(l_linenumber, 3) AS BIGINT) AS "right" FROM lineitem""",
)
def cell_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    text = F.concat(sheets.reference(F.col("l_partkey"), F.col("l_linenumber")), F.lit(":"), sheets.reference(F.col("l_suppkey"), F.lit(3)))
    return items.select("l_orderkey", "l_linenumber", text.alias("t")).select("l_orderkey", "l_linenumber", sheets.parse_range(F.col("t")).alias("r")).select("l_orderkey", "l_linenumber", "r.*")


@register("unscaled_decimals", "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(38,2)) AS price, CAST(-o_orderkey / 1000.0 AS DECIMAL(38,3)) AS small FROM orders")
def unscaled_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("long").cast("string")
    return orders.select("o_orderkey", sheets.unscaled(cents, 2).alias("price"), sheets.unscaled((-F.col("o_orderkey")).cast("string"), 3).alias("small"))


@register("text_base64", "SELECT doc_id, to_base64(encode(text)) AS coded, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS collapsed FROM documents")
def text_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", markup.base64_of(F.col("text").cast("binary")).alias("coded"), markup.collapse_spaces(F.col("text")).alias("collapsed"))


@register(
    "affine_points",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, 800 - l_extendedprice / 1000 AS y, radians(l_linenumber * 15) AS t FROM lineitem),
            r AS (SELECT *, 10 + cos(t) * (x - 10) - sin(t) * (y - 20) AS rx, 20 + sin(t) * (x - 10) + cos(t) * (y - 20) AS ry FROM p)
       SELECT l_orderkey, l_linenumber, round(2 * rx + 5, 6) AS x, round(3 * ry - 1, 6) AS y FROM r""",
)
def affine_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    turn = units.rotation(F.col("l_linenumber") * 15, F.lit(10.0), F.lit(20.0))
    grow = F.struct(*(F.lit(v).alias(n) for n, v in zip("abcdef", (2.0, 0.0, 0.0, 3.0, 5.0, -1.0))))
    moved = items.select("l_orderkey", "l_linenumber", "l_quantity", units.flip_y(F.col("l_extendedprice") / 1000, F.lit(800.0)).alias("y"), units.compose(turn, grow).alias("m"))
    moved = moved.select("l_orderkey", "l_linenumber", units.transform_point(F.col("m"), F.col("l_quantity"), F.col("y")).alias("p"))
    return moved.select("l_orderkey", "l_linenumber", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@register(
    "path_boxes",
    """WITH s AS (SELECT l_orderkey, l_linenumber AS n, l_quantity AS dx, CAST(l_suppkey % 60 - 30 AS DOUBLE) AS dy, CAST(l_partkey % 200 - 100 AS DOUBLE) AS cx, CAST(l_partkey % 130 - 65 AS DOUBLE) AS cy,
                   row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem),
            m AS (SELECT l_orderkey, i, i % 4 = 2 AS bent, CASE WHEN i > 1 AND i % 4 = 3 THEN 0 ELSE dx END AS dx, CASE WHEN i > 1 AND i % 4 = 1 THEN 0 ELSE dy END AS dy, cx, cy FROM s),
            p AS (SELECT *, sum(dx) OVER w - dx AS x, sum(dy) OVER w - dy AS y, CASE WHEN bent AND dx <> 2 * cx THEN -cx / (dx - 2 * cx) END AS tx, CASE WHEN bent AND dy <> 2 * cy THEN -cy / (dy - 2 * cy) END AS ty
                  FROM m WINDOW w AS (PARTITION BY l_orderkey ORDER BY i)),
            e AS (SELECT *, CASE WHEN tx > 0 AND tx < 1 THEN x + 2 * tx * (1 - tx) * cx + tx * tx * dx ELSE x END AS ex, CASE WHEN ty > 0 AND ty < 1 THEN y + 2 * ty * (1 - ty) * cy + ty * ty * dy ELSE y END AS ey FROM p WHERE i > 1)
       SELECT l_orderkey, count(*) AS n_segments, round(min(least(x, x + dx, ex)), 8) AS "left", round(min(least(y, y + dy, ey)), 8) AS top, round(max(greatest(x, x + dx, ex)), 8) AS "right", round(max(greatest(y, y + dy, ey)), 8) AS bottom
       FROM e GROUP BY l_orderkey""",
)
def path_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of a path per order: its items are moves, curves, verticals, lines and horizontals in turn."""
    items = table(spark, sf_dir, "lineitem").withColumn("i", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    dx, dy, cx, cy = F.col("l_quantity"), F.expr("l_suppkey % 60 - 30"), F.expr("l_partkey % 200 - 100"), F.expr("l_partkey % 130 - 65")
    turn = F.col("i") % 4
    step = (
        F.when(F.col("i") == 1, F.concat_ws(" ", F.lit("m"), dx, dy)).when(turn == 2, F.concat_ws(" ", F.lit("q"), cx, cy, dx, dy))
        .when(turn == 3, F.concat_ws(" ", F.lit("v"), dy)).when(turn == 0, F.concat_ws(",", F.concat(F.lit("l"), dx), dy)).otherwise(F.concat_ws(" ", F.lit("h"), dx))
    )
    steps = F.array_sort(F.collect_list(F.struct("i", step.alias("d"))))
    drawn = items.groupBy("l_orderkey").agg(F.array_join(steps["d"], "").alias("d"))
    boxes = paths.path_boxes(paths.path_segments(drawn, "l_orderkey", "d"), ["l_orderkey"])
    return boxes.select("l_orderkey", "n_segments", *(F.round(c, 8).alias(c) for c in ("left", "top", "right", "bottom")))


@register("package_json", "SELECT o_orderkey, o_orderstatus AS status, l_linenumber AS line, l_quantity AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def package_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON packages with their items, written and read again by their schema."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    item = F.struct(F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"))
    held = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey", "o_orderstatus").agg(F.collect_list(item).alias("items"))
    packed = held.select("o_orderkey", F.to_json(F.struct(F.lit("order").alias("$schema"), F.col("o_orderstatus").alias("status"), "items")).alias("json"))
    read = packed.select("o_orderkey", F.from_json("json", "`$schema` string, status string, items array<struct<line:int,quantity:double>>", {"mode": "FAILFAST"}).alias("p"))
    return read.select("o_orderkey", "p.status", F.explode("p.items").alias("i")).select("o_orderkey", "status", "i.line", "i.quantity")


EXTENDED = """SELECT DISTINCT l_returnflag AS flag, l_linestatus AS status, count(*) FILTER (WHERE l_discount > 0.05) AS n_discounted, round(sum(l_quantity), 4) AS quantity
    FROM {items} GROUP BY CUBE (l_returnflag, l_linestatus) HAVING count(*) > 10 ORDER BY quantity DESC, flag NULLS LAST, status NULLS LAST LIMIT 6 OFFSET 1"""


@register("extended_select", EXTENDED.format(items="lineitem"))
def extended_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the strict dialect refuses and Spark SQL serves: DISTINCT, FILTER, CUBE, HAVING, LIMIT and OFFSET."""
    return spark.sql(EXTENDED, items=table(spark, sf_dir, "lineitem"))
