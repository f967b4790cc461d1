"""Queries over the driver tables, one per operator, with their plain SQL equivalents.

The tables hold no geometry, so integer-valued shapes are derived from their keys, the same
way on both sides: points of customers, suppliers and orders, boxes of parts and suppliers,
nations as strips along the whole map, segments of orders. A thousand parts, and as many rows of
the other tables as come with them, fill a square of their own beside the one before: the map
grows with the rows, and the share of rows that meet something stays as it is."""
from __future__ import annotations

import json
import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import PipelineRun
from .functions import codes, crs, dialect, text
from .functions import geometry as geo
from .operators import http, joins, lines, polygons, rows
from .operators.aggregates import Aggregate
from .operators.grid import scratch_path, stored
from .operators.joins import ROW
from .plans import mapping, spec
from .sources import read_source, sinks

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # for the stand-in service below

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, and its SQL equivalent where there is one."""
    def keep(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql.strip()
        return fn
    return keep


# ---- tables and the shapes derived from their keys ---------------------------

def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*columns) if columns else df


def keyed(df: DataFrame, key: str, shape: str) -> DataFrame:
    """Rows in key order, with `geom` from SQL."""
    return df.withColumn(ROW, F.array(F.col(key).cast("bigint"))).withColumn("geom", F.expr(shape))


def as_double(sql: str) -> str:
    return f"CAST({sql} AS DOUBLE)"


# Keys whose shapes lie in one square of the map: the tables grow in these proportions.
IN_SQUARE = {"p_partkey": 1000, "o_orderkey": 7500, "c_custkey": 750, "s_suppkey": 50}


def east_of(k: str) -> str:
    return f"{k} * 7919 % 1000 + {k} DIV {IN_SQUARE[k]} * 1000"


def point_of(k: str) -> str:
    return geo.point(as_double(east_of(k)), as_double(f"{k} * 104729 % 1000"))


def box_of(x0: str, y0: str, w: str, h: str | None = None) -> str:
    return geo.box(as_double(x0), as_double(y0), as_double(f"{x0} + {w}"), as_double(f"{y0} + {h or w}"))


PART_BOX = box_of("p_partkey * 13 % 990 + p_partkey DIV 1000 * 1000", "p_partkey * 29 % 990", "(5 + p_partkey % 20)")
SUPPLIER_BOX = box_of("s_suppkey * 37 % 980 + s_suppkey DIV 50 * 1000", "s_suppkey * 53 % 980", "(10 + s_suppkey % 15)")
ORDER_LINE = (
    "CASE WHEN o_orderkey % 2 = 0 THEN "
    + geo.segment(as_double("o_orderkey * 17 % 900"), as_double("o_orderkey * 31 % 200"), as_double("o_orderkey * 17 % 900 + 10 + o_orderkey % 50"), as_double("o_orderkey * 31 % 200"))
    + " ELSE "
    + geo.segment(as_double("o_orderkey * 17 % 900"), as_double("o_orderkey * 31 % 200"), as_double("o_orderkey * 17 % 900"), as_double("o_orderkey * 31 % 200 + 10 + o_orderkey % 50"))
    + " END"
)


def customers(spark, sf, *cols):
    return keyed(table(spark, sf, "customer", "c_custkey", *cols), "c_custkey", point_of("c_custkey"))


def suppliers(spark, sf, *cols):
    return keyed(table(spark, sf, "supplier", "s_suppkey", *cols), "s_suppkey", point_of("s_suppkey"))


def orders(spark, sf, *cols):
    return keyed(table(spark, sf, "orders", "o_orderkey", *cols), "o_orderkey", point_of("o_orderkey"))


def order_lines(spark, sf, *cols):
    return keyed(table(spark, sf, "orders", "o_orderkey", *cols), "o_orderkey", ORDER_LINE)


def parts(spark, sf, *cols):
    return keyed(table(spark, sf, "part", "p_partkey", *cols), "p_partkey", PART_BOX)


def nations(spark, sf, *cols):
    last = table(spark, sf, "part", "p_partkey").agg(F.max("p_partkey")).first()[0] or 0
    strip = box_of("0", "n_nationkey * 40", f"{(last // 1000 + 1) * 1000}", "40")
    return keyed(table(spark, sf, "nation", "n_nationkey", *cols), "n_nationkey", strip)


def supplier_boxes(spark, sf, *cols):
    return keyed(table(spark, sf, "supplier", "s_suppkey", *cols), "s_suppkey", SUPPLIER_BOX)


# the same in SQL
def point_sql(k: str) -> str:
    return f"{k} * 7919 % 1000 + {k} // {IN_SQUARE[k]} * 1000 AS x, {k} * 104729 % 1000 AS y"


PARTS = "(SELECT *, p_partkey * 13 % 990 + p_partkey // 1000 * 1000 AS x0, p_partkey * 29 % 990 AS y0, p_partkey * 13 % 990 + p_partkey // 1000 * 1000 + 5 + p_partkey % 20 AS x1, p_partkey * 29 % 990 + 5 + p_partkey % 20 AS y1 FROM part)"
NATIONS = "(SELECT *, 0 AS nx0, n_nationkey * 40 AS ny0, ((SELECT max(p_partkey) FROM part) // 1000 + 1) * 1000 AS nx1, n_nationkey * 40 + 40 AS ny1 FROM nation)"
SUPPLIERS = (
    "(SELECT *, s_suppkey * 37 % 980 + s_suppkey // 50 * 1000 AS sx0, s_suppkey * 53 % 980 AS sy0, "
    "s_suppkey * 37 % 980 + s_suppkey // 50 * 1000 + 10 + s_suppkey % 15 AS sx1, s_suppkey * 53 % 980 + 10 + s_suppkey % 15 AS sy1 FROM supplier)")
ORDERS = f"(SELECT *, {point_sql('o_orderkey')} FROM orders)"
OVERLAP = "greatest(0, least(x1, nx1) - greatest(x0, nx0)) * greatest(0, least(y1, ny1) - greatest(y0, ny0))"


# ---- filter, attributes, mapping ---------------------------------------------

EVENT_TEST = "value > 20 AND event_type <> 'error'"


@query(f"SELECT event_id, event_type, value FROM events WHERE {EVENT_TEST}")
def filter_passed(spark, sf):
    df = rows.filter_rows(table(spark, sf, "events", "event_id", "event_type", "value"), EVENT_TEST)
    return df.filter("__matched").drop("__matched")


@query(f"SELECT event_id, event_type, value FROM events WHERE ({EVENT_TEST}) IS NOT TRUE")
def filter_rejects(spark, sf):
    df = rows.filter_rows(table(spark, sf, "events", "event_id", "event_type", "value"), EVENT_TEST)
    return df.filter("NOT __matched").drop("__matched")


@query("""
SELECT c_custkey, c_acctbal, c_mktsegment || '/' || CAST(c_nationkey AS VARCHAR) AS label,
       lower(c_mktsegment || '/' || CAST(c_nationkey AS VARCHAR)) AS label_lower, c_nationkey * 10 + 1 AS c_nationkey
FROM customer""")
def attributes_ordered(spark, sf):
    items = spec.map_items([
        {"to": "label", "expr": "c_mktsegment || '/' || CAST(c_nationkey AS STRING)"}, {"to": "label_lower", "expr": "lower(label)"},
        {"to": "c_nationkey", "expr": "c_nationkey * 10 + 1"},
    ], "columns")
    return mapping.set_items(table(spark, sf, "customer"), items, ["c_name", "c_mktsegment"], "EPSG:25833")


CODES = {
    "source": "o_orderpriority", "default": "other",
    "cases": [{"match": "1-urgent", "value": "now"}, {"like": "2-%", "value": "soon"}, {"regex": "^[34]-", "value": "later"}],
}


@query("""
SELECT o_orderkey, CASE WHEN lower(o_orderpriority) = '1-urgent' THEN 'now' WHEN lower(o_orderpriority) LIKE '2-%' THEN 'soon'
  WHEN regexp_matches(o_orderpriority, '^[34]-', 'i') THEN 'later' ELSE 'other' END AS urgency, 'orders' AS origin FROM orders""")
def map_codelist_rules(spark, sf):
    items = spec.map_items([{"to": "o_orderkey", "from": "o_orderkey"}, {"to": "urgency", "codelist": CODES}, {"to": "origin", "const": "orders"}], "mapping")
    return mapping.mapped(table(spark, sf, "orders", "o_orderkey", "o_orderpriority"), items, "EPSG:25833")


@query("""
SELECT c_custkey, coalesce((SELECT r_name FROM region WHERE r_regionkey = c_nationkey), 'elsewhere') AS area FROM customer""")
def map_codelist_file(spark, sf):
    cl = mapping.CodeList("c_nationkey", default="elsewhere", file="region", file_match_col="r_regionkey", file_value_col="r_name")
    df = mapping.with_code_table(table(spark, sf, "customer", "c_custkey", "c_nationkey"), table(spark, sf, "region"), cl, "area")
    return df.select("c_custkey", "area")


DATE_TEXT = (
    "CASE o_orderkey % 4 WHEN 0 THEN {iso} WHEN 1 THEN {dmy} WHEN 2 THEN {dmy} || ' 08:30' ELSE 'about ' || {iso} END"
)


@query("""
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d.%m.%Y')
  WHEN 2 THEN strftime(o_orderdate, '%d.%m.%Y') || ' 08:30' ELSE 'about ' || strftime(o_orderdate, '%Y-%m-%d') END AS s FROM orders)
SELECT o_orderkey, CAST(coalesce(TRY_CAST(s AS DATE), TRY_CAST(try_strptime(s, ['%d.%m.%Y', '%d.%m.%Y %H:%M', '%d.%m.%Y %H:%M:%S']) AS DATE)) AS VARCHAR) AS day,
  CAST(coalesce(TRY_CAST(s AS TIMESTAMP), try_strptime(s, ['%d.%m.%Y', '%d.%m.%Y %H:%M', '%d.%m.%Y %H:%M:%S'])) AS VARCHAR) AS moment FROM t""")
def map_cast_dates(spark, sf):
    iso, dmy = "date_format(o_orderdate, 'yyyy-MM-dd')", "date_format(o_orderdate, 'dd.MM.yyyy')"
    df = table(spark, sf, "orders", "o_orderkey", "o_orderdate").withColumn("s", F.expr(DATE_TEXT.format(iso=iso, dmy=dmy)))
    items = spec.map_items([
        {"to": "o_orderkey", "from": "o_orderkey"}, {"to": "day", "from": "s", "cast": "DATE"}, {"to": "moment", "from": "s", "cast": "TIMESTAMP"},
    ], "mapping")
    out = mapping.mapped(df, items, "EPSG:25833")
    return out.select("o_orderkey", F.col("day").cast("string"), F.date_format("moment", "yyyy-MM-dd HH:mm:ss").alias("moment"))


@query("""
SELECT l_orderkey, l_linenumber, TRY_CAST(l_quantity / 4 AS INTEGER) AS from_double, TRY_CAST(CAST(l_discount * 50 AS DECIMAL(10, 2)) AS BIGINT) AS from_decimal,
  TRY_CAST(CAST(l_quantity AS BIGINT) || '.5' AS INTEGER) AS from_text, TRY_CAST(l_returnflag AS INTEGER) AS from_word FROM lineitem""")
def map_cast_integers(spark, sf):
    df = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")
    items = spec.map_items([
        {"to": "l_orderkey", "from": "l_orderkey"}, {"to": "l_linenumber", "from": "l_linenumber"},
        {"to": "from_double", "expr": "l_quantity / 4", "cast": "INTEGER"}, {"to": "from_decimal", "expr": "CAST(l_discount * 50 AS DECIMAL(10, 2))", "cast": "BIGINT"},
        {"to": "from_text", "expr": "CAST(l_quantity AS BIGINT) || '.5'", "cast": "INTEGER"}, {"to": "from_word", "from": "l_returnflag", "cast": "INTEGER"},
    ], "mapping")
    return mapping.mapped(df, items, "EPSG:25833")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS num FROM lineitem")
def map_seq(spark, sf):
    df = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber").withColumn(ROW, F.array("l_orderkey", F.col("l_linenumber").cast("long")))
    items = spec.map_items([{"to": "l_orderkey", "from": "l_orderkey"}, {"to": "l_linenumber", "from": "l_linenumber"}, {"to": "num", "func": "seq"}], "mapping")
    return mapping.mapped(df, items, "EPSG:25833").select("l_orderkey", "l_linenumber", F.col("num").cast("long").alias("num"))


@query("""
SELECT p_partkey, p_name FROM part WHERE (lower(p_name) LIKE '%ring%' OR p_brand IN ('Brand#1', 'Brand#2')) AND p_size >= 10""")
def condition_builder(spark, sf):
    named = mapping.conditions([mapping.condition("p_name", "contains", "RING"), mapping.condition("p_brand", "in", ["Brand#1", "Brand#2"])], any_of=True)
    df = table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_size")
    where = mapping.conditions([named, mapping.condition("p_size", ">=", 10, df.schema["p_size"].dataType)])
    return df.filter(F.expr(where)).select("p_partkey", "p_name")


# Every test of the condition builder, with what it is in SQL.
CONDITIONS = [
    ("p_brand", "is", "Brand#1", "p_brand = 'Brand#1'"), ("p_brand", "is not", "Brand#1", "p_brand <> 'Brand#1'"), ("p_size", ">", 20, "p_size > 20"),
    ("p_size", ">=", 20, "p_size >= 20"), ("p_size", "<", 20, "p_size < 20"), ("p_size", "<=", 20, "p_size <= 20"),
    ("p_name", "contains", "RIN", "lower(p_name) LIKE '%rin%'"), ("p_name", "doesn't contain", "RIN", "lower(p_name) NOT LIKE '%rin%'"),
    ("p_name", "starts with", "B", "lower(p_name) LIKE 'b%'"), ("p_size", "in", [1, 2, 3], "p_size IN (1, 2, 3)"),
    ("p_brand", "not in", ["Brand#1", "Brand#2"], "p_brand NOT IN ('Brand#1', 'Brand#2')"), ("p_name", "is empty", None, "coalesce(p_name, '') = ''"),
    ("p_name", "is not empty", None, "coalesce(p_name, '') <> ''"),
]


@query("SELECT p_partkey, " + ", ".join(f"{sql} AS c{i}" for i, (*_, sql) in enumerate(CONDITIONS)) + " FROM part")
def condition_operators(spark, sf):
    df = table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_size")
    tests = [mapping.condition(column, operator, value, df.schema[column].dataType) for column, operator, value, _ in CONDITIONS]
    return df.select("p_partkey", *[F.expr(t).alias(f"c{i}") for i, t in enumerate(tests)])


# ---- joins by attribute ------------------------------------------------------

@query("""
WITH first AS (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)
SELECT c_custkey, o_orderkey AS first_order, o_orderstatus AS status FROM customer LEFT JOIN first ON o_custkey = c_custkey""")
def attribute_join_first(spark, sf):
    df = joins.attribute_join(customers(spark, sf), orders(spark, sf, "o_custkey", "o_orderstatus"), "c_custkey", "o_custkey", {"first_order": "o_orderkey", "status": "o_orderstatus"})
    return df.select("c_custkey", "first_order", "status")


@query("""
SELECT c_custkey, coalesce(n, 0) AS n, total, priorities FROM customer LEFT JOIN (
  SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total,
    string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def attribute_join_summarize(spark, sf):
    fields = {"n": Aggregate("n", how="count"), "total": Aggregate("total", expr="round(sum(o_totalprice), 2)"), "priorities": Aggregate("priorities", "o_orderpriority", "all")}
    df = joins.attribute_join(customers(spark, sf), orders(spark, sf, "o_custkey", "o_totalprice", "o_orderpriority"), "c_custkey", "o_custkey", fields, "summarize")
    return df.select("c_custkey", "n", "total", "priorities")


@query("""
SELECT n_nationkey, any_nation, mean, low, high FROM nation LEFT JOIN (
  SELECT c_nationkey AS any_nation, round(avg(c_acctbal), 6) AS mean, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY c_nationkey) ON any_nation = n_nationkey""")
def attribute_join_any_average(spark, sf):
    """How any (of values that are all the same), average, min and max."""
    fields = {
        "any_nation": Aggregate("any_nation", "c_nationkey", "any"), "mean": Aggregate("mean", "c_acctbal", "average"),
        "low": Aggregate("low", "c_acctbal", "min"), "high": Aggregate("high", "c_acctbal", "max"),
    }
    df = joins.attribute_join(nations(spark, sf), table(spark, sf, "customer", "c_nationkey", "c_acctbal"), "n_nationkey", "c_nationkey", fields, "summarize")
    return df.select("n_nationkey", "any_nation", F.round("mean", 6).alias("mean"), "low", "high")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def attribute_join_rejects(spark, sf):
    pending = orders(spark, sf, "o_custkey", "o_orderstatus").filter("o_orderstatus = 'P'")
    df = joins.attribute_join(customers(spark, sf), pending, "c_custkey", "o_custkey", {})
    return df.filter("NOT __matched").select("c_custkey")


# ---- spatial joins -----------------------------------------------------------

@query(f"""
WITH p AS {PARTS}, d AS (SELECT DISTINCT x, y FROM {ORDERS}),
m AS (SELECT x, y, min(p_partkey) AS part FROM d JOIN p ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY x, y)
SELECT o_orderkey, part, p_brand AS brand FROM {ORDERS} LEFT JOIN m USING (x, y) LEFT JOIN part ON p_partkey = part""")
def spatial_join_first(spark, sf):
    df = joins.spatial_join(orders(spark, sf), parts(spark, sf, "p_brand"), {"part": "p_partkey", "brand": "p_brand"})
    return df.select("o_orderkey", "part", "brand")


@query(f"""
WITH p AS {PARTS} SELECT o_orderkey, p_partkey AS part FROM {ORDERS} LEFT JOIN p ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1""")
def spatial_join_all(spark, sf):
    return joins.spatial_join(orders(spark, sf), parts(spark, sf), {"part": "p_partkey"}, match="all").select("o_orderkey", "part")


@query(f"""
WITH p AS {PARTS}, m AS (SELECT p_partkey, count(*) AS n, CAST(sum(c_nationkey) AS BIGINT) AS nation_sum, min(c_custkey) AS lowest
  FROM p JOIN (SELECT *, {point_sql('c_custkey')} FROM customer) ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY p_partkey)
SELECT p_partkey, coalesce(n, 0) AS n, nation_sum, lowest FROM part LEFT JOIN m USING (p_partkey)""")
def spatial_join_summarize(spark, sf):
    fields = {"n": Aggregate("n", how="count"), "nation_sum": Aggregate("nation_sum", "c_nationkey", "sum"), "lowest": Aggregate("lowest", "c_custkey", "min")}
    df = joins.spatial_join(parts(spark, sf), customers(spark, sf, "c_nationkey"), fields, match="summarize")
    return df.select("p_partkey", "n", "nation_sum", "lowest")


@query(f"""
WITH p AS {PARTS}, d AS (SELECT DISTINCT x, y FROM {ORDERS}), m AS (SELECT x, y FROM d WHERE EXISTS (SELECT 1 FROM p WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1))
SELECT o_orderkey FROM {ORDERS} ANTI JOIN m USING (x, y)""")
def spatial_join_rejects(spark, sf):
    return joins.spatial_join(orders(spark, sf), parts(spark, sf), {}).filter("NOT __matched").select("o_orderkey")


# A nation's coast: its strip of the map with a zigzag for its lower and upper border.
COAST = "abs({x} % 20 - 10)"


def coasts(spark, sf, *cols):
    """Nations with outlines of two vertices for every ten units of the map's width."""
    last = table(spark, sf, "part", "p_partkey").agg(F.max("p_partkey")).first()[0] or 0
    x = geo.var("x")
    xs = f"sequence(0L, {(last // 1000 + 1) * 1000}L, 10L)"

    def border(above: int) -> str:
        return f"transform({xs}, {x} -> {geo.vertex(as_double(x), as_double(f'n_nationkey * 40 + {above} + {COAST.format(x=x)}'))})"

    start = f"array({geo.vertex('0D', as_double('n_nationkey * 40 + 10'))})"
    outline = geo.polygon(f"array(concat({border(0)}, reverse({border(40)}), {start}))")
    return keyed(table(spark, sf, "nation", "n_nationkey", *cols), "n_nationkey", outline)


COASTS = "(SELECT *, n_nationkey * 40 AS low, ((SELECT max(p_partkey) FROM part) // 1000 + 1) * 1000 AS width FROM nation)"
ON_LAND = f"x <= width AND y - {COAST.format(x='x')} BETWEEN low AND low + 40"
INLAND = f"x > 0 AND x < width AND y - {COAST.format(x='x')} > low AND y - {COAST.format(x='x')} < low + 40"


@query(f"""
WITH n AS {COASTS}, m AS (SELECT x, y, arg_min(n_name, n_nationkey) AS nation FROM (SELECT DISTINCT x, y FROM {ORDERS}) JOIN n ON {ON_LAND} GROUP BY x, y)
SELECT o_orderkey, nation FROM {ORDERS} LEFT JOIN m USING (x, y)""")
def spatial_join_outlines(spark, sf):
    """Points in polygons of very many edges."""
    return joins.spatial_join(orders(spark, sf), coasts(spark, sf, "n_name"), {"nation": "n_name"}).select("o_orderkey", "nation")


@query(f"""
WITH n AS {COASTS}, m AS (SELECT n_nationkey, count(*) AS inland, CAST(sum(o_custkey) AS BIGINT) AS customers FROM {ORDERS} JOIN n ON {INLAND} GROUP BY n_nationkey)
SELECT n_nationkey, coalesce(inland, 0) AS inland, customers FROM nation LEFT JOIN m USING (n_nationkey)""")
def spatial_join_outlines_contain(spark, sf):
    fields = {"inland": Aggregate("inland", how="count"), "customers": Aggregate("customers", "o_custkey", "sum")}
    df = joins.spatial_join(coasts(spark, sf), orders(spark, sf, "o_custkey"), fields, predicate="contains", match="summarize")
    return df.select("n_nationkey", "inland", "customers")


@query(f"""
WITH p AS {PARTS}, n AS {NATIONS} SELECT p_partkey, n_nationkey AS nation FROM p LEFT JOIN n ON x0 >= nx0 AND x1 <= nx1 AND y0 >= ny0 AND y1 <= ny1""")
def spatial_join_within(spark, sf):
    df = joins.spatial_join(parts(spark, sf), nations(spark, sf), {"nation": "n_nationkey"}, predicate="within")
    return df.select("p_partkey", "nation")


@query(f"""
WITH p AS {PARTS}, m AS (SELECT p_partkey, min(o_orderkey) AS inner_order FROM p JOIN (SELECT x, y, min(o_orderkey) AS o_orderkey FROM {ORDERS} GROUP BY x, y)
  ON x > x0 AND x < x1 AND y > y0 AND y < y1 GROUP BY p_partkey) SELECT p_partkey, inner_order FROM part LEFT JOIN m USING (p_partkey)""")
def spatial_join_contains(spark, sf):
    df = joins.spatial_join(parts(spark, sf), orders(spark, sf), {"inner_order": "o_orderkey"}, predicate="contains")
    return df.select("p_partkey", "inner_order")


@query(f"""
WITH p AS {PARTS}, n AS {NATIONS} SELECT p_partkey, arg_min(n_name, (-({OVERLAP}), n_nationkey)) AS nation
FROM p JOIN n ON x0 <= nx1 AND x1 >= nx0 AND y0 <= ny1 AND y1 >= ny0 GROUP BY p_partkey
UNION ALL SELECT p_partkey, NULL FROM p WHERE NOT EXISTS (SELECT 1 FROM n WHERE x0 <= nx1 AND x1 >= nx0 AND y0 <= ny1 AND y1 >= ny0)""")
def spatial_join_largest_overlap(spark, sf):
    df = joins.spatial_join(parts(spark, sf), nations(spark, sf, "n_name"), {"nation": "n_name"}, on_multiple="largest_overlap")
    return df.select("p_partkey", "nation")


NEAREST = f"""
WITH c AS (SELECT DISTINCT {point_sql('c_custkey')} FROM customer), s AS (SELECT s_suppkey, {point_sql('s_suppkey')} FROM supplier),
m AS (SELECT c.x, c.y, arg_min(s_suppkey, ((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y), s_suppkey)) AS supplier,
  min((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) AS d2 FROM c CROSS JOIN s {{where}} GROUP BY c.x, c.y)
SELECT c_custkey, supplier, round(sqrt(d2), 6) AS dist FROM (SELECT c_custkey, {point_sql('c_custkey')} FROM customer) LEFT JOIN m USING (x, y)"""


@query(NEAREST.format(where=""))
def nearest_unbounded(spark, sf):
    df = joins.nearest_neighbor(customers(spark, sf), suppliers(spark, sf), {"supplier": "s_suppkey"}, distance_field="dist")
    return df.select("c_custkey", "supplier", F.round("dist", 6).alias("dist"))


@query(NEAREST.format(where="WHERE (c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) <= 900"))
def nearest_bounded(spark, sf):
    df = joins.nearest_neighbor(customers(spark, sf), suppliers(spark, sf), {"supplier": "s_suppkey"}, 30.0, "dist")
    return df.select("c_custkey", "supplier", F.round("dist", 6).alias("dist"))


# A dense town, the country around it, and some far-off places: (x, y) of a key, in both languages.
TOWN = (
    "CASE WHEN {k} % 499 = 0 THEN 1000000 + {k} WHEN {k} % {share} = 1 THEN {k} * 7919 % 1000 ELSE 500 + {k} * 7919 % 10007 / 4096 END",
    "CASE WHEN {k} % 499 = 0 THEN {k} % 1000 WHEN {k} % {share} = 1 THEN {k} * 104729 % 997 ELSE 500 + {k} * 104729 % 10009 / 4096 END",
)


def town_sql(k: str, share: int) -> str:
    x, y = (c.format(k=k, share=share).replace("/ 4096", "/ 4096.0::DOUBLE") for c in TOWN)
    return f"CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y"


@query(f"""
WITH c AS (SELECT c_custkey, {town_sql('c_custkey', 2)} FROM customer), p AS (SELECT p_partkey, {town_sql('p_partkey', 9)} FROM part),
d AS (SELECT c_custkey, p_partkey, sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y)) AS d FROM c CROSS JOIN p)
SELECT c_custkey, arg_min(p_partkey, (d, p_partkey)) AS part, round(min(d), 6) AS dist FROM d GROUP BY c_custkey""")
def nearest_clustered(spark, sf):
    """Most shapes in a town, some in the country around it, a few very far off."""
    def placed(df, key, share):
        return keyed(df, key, geo.point(*(as_double(c.format(k=key, share=share)) for c in TOWN)))

    base = placed(table(spark, sf, "customer", "c_custkey"), "c_custkey", 2)
    df = joins.nearest_neighbor(base, placed(table(spark, sf, "part", "p_partkey"), "p_partkey", 9), {"part": "p_partkey"}, distance_field="dist")
    return df.select("c_custkey", "part", F.round("dist", 6).alias("dist"))


@query(f"""
WITH p AS {PARTS}, s AS (SELECT s_suppkey, {point_sql('s_suppkey')} FROM supplier),
d AS (SELECT p_partkey, s_suppkey, greatest(0, x0 - x, x - x1) AS dx, greatest(0, y0 - y, y - y1) AS dy FROM p CROSS JOIN s)
SELECT p_partkey, arg_min(s_suppkey, (dx * dx + dy * dy, s_suppkey)) AS supplier, round(sqrt(min(dx * dx + dy * dy)), 6) AS dist FROM d GROUP BY p_partkey""")
def nearest_to_boxes(spark, sf):
    df = joins.nearest_neighbor(parts(spark, sf), suppliers(spark, sf), {"supplier": "s_suppkey"}, distance_field="dist")
    return df.select("p_partkey", "supplier", F.round("dist", 6).alias("dist"))


@query(f"""
WITH c AS (SELECT DISTINCT {point_sql('c_custkey')} FROM customer), s AS (SELECT DISTINCT {point_sql('s_suppkey')} FROM supplier)
SELECT count(*) AS pairs FROM c JOIN s ON (c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) <= 400""")
def within_distance(spark, sf):
    return joins.within_distance(customers(spark, sf), suppliers(spark, sf), 20.0).agg(F.count("*").alias("pairs"))


# ---- overlays ----------------------------------------------------------------

def area(name: str = "area") -> F.Column:
    return F.expr(f"round({geo.area('geom')}, 6)").alias(name)


@query(f"""
WITH p AS {PARTS}, n AS {NATIONS} SELECT p_partkey, n_nationkey AS nation, CAST({OVERLAP} AS DOUBLE) AS area
FROM p JOIN n ON x0 < nx1 AND x1 > nx0 AND y0 < ny1 AND y1 > ny0""")
def intersect_overlay_area(spark, sf):
    df = polygons.intersect_overlay(parts(spark, sf), nations(spark, sf), {"nation": "n_nationkey"})
    return df.select("p_partkey", "nation", area())


CLIP = f"""
WITH p AS {PARTS}, n AS (SELECT * FROM {NATIONS}),
m AS (SELECT p_partkey, min(n_nationkey) AS nation FROM p JOIN n ON x0 <= nx1 AND x1 >= nx0 AND y0 <= ny1 AND y1 >= ny0 GROUP BY p_partkey),
c AS (SELECT p.*, CAST(CASE WHEN nation IS NULL THEN 0 ELSE {OVERLAP} END AS DOUBLE) AS cut FROM p LEFT JOIN m USING (p_partkey) LEFT JOIN n ON n_nationkey = nation)"""


@query(CLIP + " SELECT p_partkey, cut AS area FROM c WHERE cut > 0")
def clip_area(spark, sf):
    return polygons.clip(parts(spark, sf), nations(spark, sf)).filter("__matched").select("p_partkey", area())


@query(CLIP + " SELECT p_partkey, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area FROM c WHERE cut = 0")
def clip_rejects(spark, sf):
    return polygons.clip(parts(spark, sf), nations(spark, sf)).filter("NOT __matched").select("p_partkey", area())


@query(f"""
WITH p AS {PARTS}, s AS {SUPPLIERS},
gone AS (SELECT DISTINCT a.cx, b.cy FROM s, unnest(range(sx0, sx1)) AS a(cx), unnest(range(sy0, sy1)) AS b(cy)),
cells AS (SELECT p_partkey, a.cx, b.cy FROM p, unnest(range(x0, x1)) AS a(cx), unnest(range(y0, y1)) AS b(cy))
SELECT p_partkey, CAST(count(*) AS DOUBLE) AS area FROM cells ANTI JOIN gone USING (cx, cy) GROUP BY p_partkey""")
def erase_area(spark, sf):
    return polygons.erase(parts(spark, sf), supplier_boxes(spark, sf)).select("p_partkey", area())


@query(f"""
WITH p AS {PARTS}, cells AS (SELECT DISTINCT p_brand, a.cx, b.cy FROM p, unnest(range(x0, x1)) AS a(cx), unnest(range(y0, y1)) AS b(cy))
SELECT p_brand AS brand, CAST(count(*) AS DOUBLE) AS area FROM cells GROUP BY p_brand""")
def dissolve_area(spark, sf):
    return polygons.dissolve(parts(spark, sf, "p_brand"), ["p_brand"], []).select(F.col("p_brand").alias("brand"), area())


@query(f"""
WITH p AS {PARTS}, cells AS (SELECT DISTINCT a.cx, b.cy FROM p, unnest(range(x0, x1)) AS a(cx), unnest(range(y0, y1)) AS b(cy))
SELECT (SELECT count(*) FROM part) AS n, CAST(count(*) AS DOUBLE) AS area FROM cells""")
def dissolve_everything(spark, sf):
    return polygons.dissolve(parts(spark, sf), [], [Aggregate("n", how="count")]).select("n", area())


@query(f"""
WITH p AS (SELECT *, (x1 - x0) * (y1 - y0) AS a, p_size % 3 AS band FROM {PARTS}), types AS (
  SELECT band, p_type, count(*) AS n FROM p GROUP BY band, p_type QUALIFY row_number() OVER (PARTITION BY band ORDER BY n DESC, p_type) = 1)
SELECT band, min(band) AS any_band, min(types.p_type) AS usual_type, arg_min(p_partkey, (-a, p_partkey)) AS largest,
  string_agg(DISTINCT p.p_type, ', ' ORDER BY p.p_type) AS every_type, CAST(sum(p_size) AS BIGINT) AS total, round(avg(p_size), 6) AS mean,
  min(p_partkey) AS lowest, max(p_partkey) AS highest, count(*) AS n FROM p JOIN types USING (band) GROUP BY band""")
def dissolve_aggregates(spark, sf):
    df = parts(spark, sf, "p_type", "p_size")
    out = polygons.dissolve(df, [("band", "p_size % 3")], [
        Aggregate("any_band", expr="any_value(p_size % 3)"), Aggregate("usual_type", "p_type", "most_common"), Aggregate("largest", "p_partkey", "from_largest"),
        Aggregate("every_type", "p_type", "all"), Aggregate("total", "p_size", "sum"), Aggregate("mean", expr="round(avg(p_size), 6)"),
        Aggregate("lowest", "p_partkey", "min"), Aggregate("highest", "p_partkey", "max"), Aggregate("n", how="count"),
    ])
    return out.drop("geom", ROW)


@query("""SELECT o_orderstatus AS status, CAST(count(DISTINCT (x, y)) AS BIGINT) AS dots FROM
(SELECT o_orderstatus, o_orderkey * 7919 % 1000 + o_orderkey // 7500 * 1000 AS x, o_orderkey * 104729 % 1000 AS y FROM orders) GROUP BY o_orderstatus""")
def dissolve_points(spark, sf):
    df = polygons.dissolve(orders(spark, sf, "o_orderstatus"), ["o_orderstatus"], [])
    return df.select(F.col("o_orderstatus").alias("status"), F.expr("CAST(size(geom.parts) AS BIGINT)").alias("dots"))


@query("""
WITH s AS (SELECT o_orderkey % 2 AS way, o_orderkey * 17 % 900 AS x, o_orderkey * 31 % 200 AS y, 10 + o_orderkey % 50 AS len FROM orders),
u AS (SELECT DISTINCT way, CASE WHEN way = 0 THEN x + i ELSE x END AS ux, CASE WHEN way = 0 THEN y ELSE y + i END AS uy FROM s, unnest(range(0, len)) AS r(i))
SELECT CAST(count(*) AS DOUBLE) AS length FROM u""")
def dissolve_lines_length(spark, sf):
    df = polygons.dissolve(order_lines(spark, sf), [], [])
    return df.select(F.expr(f"round({geo.length('geom')}, 6)").alias("length"))


def tiles(spark, sf, shape: str) -> DataFrame:
    return keyed(table(spark, sf, "part", "p_partkey"), "p_partkey", shape)


@query("""
WITH t AS (SELECT p_partkey, p_partkey % 50 * 10 AS x, p_partkey // 50 * 10 AS y FROM part),
b AS (SELECT p_partkey * 2 AS k, x AS x0, y AS y0, x + 10 AS x1, CASE WHEN p_partkey % 3 = 0 THEN y + 9 ELSE y + 10 END AS y1, false AS sliver FROM t
  UNION ALL SELECT p_partkey * 2 + 1, x, y + 9, x + 10, y + 10, true FROM t WHERE p_partkey % 3 = 0),
n AS (SELECT s.k AS s, t.k AS t, greatest(0, least(s.x1, t.x1) - greatest(s.x0, t.x0)) + greatest(0, least(s.y1, t.y1) - greatest(s.y0, t.y0)) AS border
  FROM b s JOIN b t ON s.sliver AND NOT t.sliver AND abs(s.k - t.k) <= 104 AND s.x0 <= t.x1 AND s.x1 >= t.x0 AND s.y0 <= t.y1 AND s.y1 >= t.y0),
m AS (SELECT s, arg_min(t, (-border, t)) AS t FROM n WHERE border > 0 GROUP BY s)
SELECT k, CAST((x1 - x0) * (y1 - y0) + 10 * (SELECT count(*) FROM m WHERE m.t = b.k) AS DOUBLE) AS area FROM b WHERE k NOT IN (SELECT s FROM m)""")
def eliminate_slivers(spark, sf):
    base = table(spark, sf, "part", "p_partkey")
    x, y = "p_partkey % 50 * 10", "(p_partkey DIV 50) * 10"
    main = base.withColumn("k", F.expr("p_partkey * 2")).withColumn("geom", F.expr(box_of(x, y, "10", "(CASE WHEN p_partkey % 3 = 0 THEN 9 ELSE 10 END)")))
    thin = base.filter("p_partkey % 3 = 0").withColumn("k", F.expr("p_partkey * 2 + 1")).withColumn("geom", F.expr(box_of(x, f"({y} + 9)", "10", "1")))
    df = main.unionByName(thin).withColumn(ROW, F.array("k")).drop("p_partkey")
    return polygons.eliminate_slivers(df, 15.0).select("k", area())


@query("""SELECT p_partkey, CAST(CASE WHEN p_partkey % 50 = 0 THEN 110 ELSE 100 END AS DOUBLE) AS area FROM part""")
def clean_coverage_area(spark, sf):
    # every tile reaches one unit into the next one of its row
    df = tiles(spark, sf, box_of("p_partkey % 50 * 10", "(p_partkey DIV 50) * 10", "11", "10"))
    return polygons.clean_coverage(df).select("p_partkey", area())


@query("SELECT p_partkey, CAST(100 AS DOUBLE) AS area, 5 AS points FROM part")
def simplify_shared_boundaries(spark, sf):
    # tiles with a bump in the middle of every edge, shared with the tile beyond it
    ring = ", ".join(geo.vertex(f"x + {dx}", f"y + {dy}") for dx, dy in (
        ("0", "0"), ("5", "0.25"), ("10", "0"), ("10.25", "5"), ("10", "10"), ("5", "10.25"), ("0", "10"), ("0.25", "5"), ("0", "0")))
    base = table(spark, sf, "part", "p_partkey").withColumn("x", F.expr(as_double("p_partkey % 50 * 10"))).withColumn("y", F.expr(as_double("(p_partkey DIV 50) * 10")))
    df = keyed(base, "p_partkey", geo.polygon(f"array(array({ring}))"))
    return lines.simplify(df, 2.0, shared_boundaries=True).select("p_partkey", area(), F.expr(geo.npoints("geom")).alias("points"))


@query("SELECT o_orderkey, 2 AS points FROM orders")
def simplify_points(spark, sf):
    x = as_double("o_orderkey % 1000")
    ring = ", ".join(geo.vertex(f"{x} + {dx}", dy) for dx, dy in (("0", "0"), ("5", "0.01"), ("10", "0"), ("15", "-0.01"), ("20", "0")))
    df = keyed(table(spark, sf, "orders", "o_orderkey"), "o_orderkey", geo.line(f"array({ring})"))
    return lines.simplify(df, 0.1).select("o_orderkey", F.expr(geo.npoints("geom")).alias("points"))


# ---- rows --------------------------------------------------------------------

@query("""SELECT p_partkey, p_type, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_type, p_size ORDER BY p_partkey) = 1""")
def remove_duplicates(spark, sf):
    df = rows.remove_duplicates(parts(spark, sf, "p_type", "p_size"), ["p_type", "p_size"])
    return df.filter("__matched").select("p_partkey", "p_type", "p_size")


@query("""SELECT o_orderkey FROM (SELECT *, o_orderkey * 7919 % 1000 AS x, o_orderkey * 104729 % 1000 AS y FROM orders)
QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY o_orderkey) > 1""")
def remove_duplicate_geometry_rejects(spark, sf):
    repeated = geo.point(as_double("o_orderkey * 7919 % 1000"), as_double("o_orderkey * 104729 % 1000"))  # every thousandth place is the same
    return rows.remove_duplicates(keyed(table(spark, sf, "orders", "o_orderkey"), "o_orderkey", repeated), [], geometry=True).filter("NOT __matched").select("o_orderkey")


@query("""
SELECT id, name, nation, balance, segment FROM (SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer
  UNION ALL BY NAME SELECT s_suppkey AS id, s_name AS name, 'N' || s_nationkey AS nation, s_acctbal AS balance FROM supplier)""")
def merge_by_name(spark, sf):
    a = customers(spark, sf, "c_name", "c_nationkey", "c_acctbal", "c_mktsegment").selectExpr(
        "c_custkey AS id", "c_name AS name", "c_nationkey AS nation", "c_acctbal AS balance", "c_mktsegment AS segment", ROW)
    b = suppliers(spark, sf, "s_name", "s_nationkey", "s_acctbal").selectExpr(
        "s_suppkey AS id", "s_name AS name", "'N' || s_nationkey AS nation", "s_acctbal AS balance", ROW)
    return rows.merge(a, b).drop(ROW)


@query("""
SELECT p_partkey, n AS part_no, CAST((5 + n) * (5 + n) AS DOUBLE) AS area FROM part, unnest(range(1, CAST(2 + p_partkey % 3 AS BIGINT))) AS r(n)""")
def explode_parts(spark, sf):
    squares = (
        "transform(sequence(1, CAST(1 + p_partkey % 3 AS INT)), n -> named_struct('dim', 2, 'rings', array(array("
        + ", ".join(geo.vertex(f"100 * n + {a}", b) for a, b in (("0", "0"), ("5 + n", "0"), ("5 + n", "5 + n"), ("0", "5 + n"), ("0", "0"))) + "))))"
    )
    df = keyed(table(spark, sf, "part", "p_partkey"), "p_partkey", geo._geometry("'MULTIPOLYGON'", squares))
    return rows.explode(df, "part_no").select("p_partkey", F.col("part_no").cast("bigint").alias("part_no"), area())


@query("""
SELECT p_partkey, CAST(CASE WHEN hole * hole < 9 THEN 400 ELSE 400 - hole * hole END AS DOUBLE) AS area, CAST(400 AS DOUBLE) AS filled
FROM (SELECT p_partkey, 1 + p_partkey % 6 AS hole FROM part)""")
def fill_holes_area(spark, sf):
    shell = ", ".join(geo.vertex(a, b) for a, b in (("0", "0"), ("20", "0"), ("20", "20"), ("0", "20"), ("0", "0")))
    size = "(2 + p_partkey % 6 + 1)"
    hole = ", ".join(geo.vertex(a, b) for a, b in (("2", "2"), ("2", size), (size, size), (size, "2"), ("2", "2")))
    df = keyed(table(spark, sf, "part", "p_partkey"), "p_partkey", geo.polygon(f"array(array({shell}), array({hole}))"))
    small = df.withColumn("whole", F.expr(f"round({geo.area(geo.fill_holes('geom'))}, 6)")).withColumn("geom", F.expr(geo.fill_holes("geom", 9.0)))
    return small.select("p_partkey", area(), F.col("whole").alias("filled"))


@query("""SELECT o_orderkey, round(round(o_totalprice / 3.7 / 0.5) * 0.5, 6) AS x, round(round(o_totalprice / 5.3 / 0.5) * 0.5, 6) AS y FROM orders""")
def snap_to_grid(spark, sf):
    df = keyed(table(spark, sf, "orders", "o_orderkey", "o_totalprice"), "o_orderkey", geo.point("o_totalprice / 3.7", "o_totalprice / 5.3"))
    snapped = df.withColumn("geom", F.expr(geo.snap_to_grid("geom", 0.5)))
    at = "geom.parts[0].rings[0][0]"
    return snapped.select("o_orderkey", F.expr(f"round({at}.x, 6)").alias("x"), F.expr(f"round({at}.y, 6)").alias("y"))


@query(f"SELECT p_partkey, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area, CAST(2 * (x1 - x0 + y1 - y0) AS DOUBLE) AS length, 'POLYGON' AS kind FROM {PARTS}")
def area_length(spark, sf):
    items = spec.map_items([
        {"to": "p_partkey", "from": "p_partkey"}, {"to": "area", "func": "area"}, {"to": "length", "func": "length"}, {"to": "kind", "func": "geom_type"},
    ], "mapping")
    return mapping.mapped(parts(spark, sf), items, "EPSG:25833")


@query(f"SELECT p_partkey, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM {PARTS}")
def centroid_xy(spark, sf):
    items = spec.map_items([{"to": "p_partkey", "from": "p_partkey"}, {"to": "x", "func": "x"}, {"to": "y", "func": "y"}], "mapping")
    return mapping.mapped(parts(spark, sf), items, "EPSG:25833")


@query("""
SELECT o_orderkey, 'POINT (' || x || ' ' || y || ')' AS wkt, '{"type":"Point","coordinates":[' || x || '.0,' || y || '.0]}' AS geojson
FROM (SELECT o_orderkey, o_orderkey * 7919 % 1000 + o_orderkey // 7500 * 1000 AS x, o_orderkey * 104729 % 1000 AS y FROM orders)""")
def text_forms(spark, sf):
    return orders(spark, sf).select("o_orderkey", F.expr(text.as_wkt("geom")).alias("wkt"), F.expr(text.as_geojson("geom")).alias("geojson"))


@query("""
WITH p AS (SELECT c_custkey, CAST(c_acctbal AS VARCHAR) AS sx, CASE WHEN c_custkey % 5 = 0 THEN 'north' ELSE CAST(c_custkey AS VARCHAR) END AS sy FROM customer)
SELECT c_custkey, TRY_CAST(sy AS DOUBLE) IS NOT NULL AS placed, CASE WHEN TRY_CAST(sy AS DOUBLE) IS NOT NULL THEN round(CAST(sx AS DOUBLE), 2) END AS x FROM p""")
def make_points(spark, sf):
    base = table(spark, sf, "customer", "c_custkey", "c_acctbal").selectExpr(
        "c_custkey", "CAST(c_acctbal AS STRING) AS sx", "CASE WHEN c_custkey % 5 = 0 THEN 'north' ELSE CAST(c_custkey AS STRING) END AS sy")
    df = rows.make_points(base, "sx", "sy", "EPSG:25833", "EPSG:25833")
    return df.select("c_custkey", F.col("__matched").alias("placed"), F.expr("round(geom.parts[0].rings[0][0].x, 2)").alias("x"))


@query("SELECT c_custkey, round(16 * (1 + c_custkey % 7) * (1 + c_custkey % 7) * sin(2 * pi() / 32), 6) AS area FROM customer")
def buffer_points(spark, sf):
    df = customers(spark, sf)
    ring = geo.circle("geom.parts[0].rings[0][0].x", "geom.parts[0].rings[0][0].y", "(1 + c_custkey % 7)")
    return df.withColumn("geom", F.expr(ring)).select("c_custkey", area())


@query(f"""
SELECT p_partkey, CAST((x1 - x0 - 4) * (y1 - y0 - 4) AS DOUBLE) AS inner_area FROM {PARTS} WHERE x1 - x0 > 4""")
def buffer_inwards(spark, sf):
    return polygons.buffer(parts(spark, sf), -2.0).select("p_partkey", area("inner_area")).filter("inner_area > 0")


@query(f"""
SELECT p_partkey, round((x1 - x0) * (y1 - y0) + 2 * 2 * (x1 - x0 + y1 - y0) + 16 * 4 * sin(2 * pi() / 32), 6) AS outer_area FROM {PARTS}""")
def buffer_outwards(spark, sf):
    return polygons.buffer(parts(spark, sf), 2.0).select("p_partkey", area("outer_area"))


# ---- lines -------------------------------------------------------------------

@query("""
WITH h AS (SELECT o_orderkey AS k, o_orderkey * 17 % 900 AS x, o_orderkey * 31 % 200 AS y, 10 + o_orderkey % 50 AS len FROM orders WHERE o_orderkey % 2 = 0),
v AS (SELECT DISTINCT o_orderkey * 17 % 900 AS x, o_orderkey * 31 % 200 AS y, 10 + o_orderkey % 50 AS len FROM orders WHERE o_orderkey % 2 = 1),
g AS (SELECT DISTINCT x, y, len FROM h),
c AS (SELECT g.x, g.y, g.len, v.x - g.x AS pos FROM g JOIN v ON v.x BETWEEN g.x AND g.x + g.len AND g.y BETWEEN v.y AND v.y + v.len
  UNION SELECT x, y, len, 0 FROM g UNION SELECT x, y, len, len FROM g),
p AS (SELECT x, y, len, pos, lead(pos) OVER (PARTITION BY x, y, len ORDER BY pos) - pos AS size FROM c)
SELECT k AS o_orderkey, CAST(x + pos AS DOUBLE) AS x0, CAST(size AS DOUBLE) AS length FROM h JOIN p USING (x, y, len) WHERE size > 0""")
def split_lines_pieces(spark, sf):
    all_lines = order_lines(spark, sf)
    df = lines.split_lines(all_lines.filter("o_orderkey % 2 = 0"), all_lines.filter("o_orderkey % 2 = 1"))
    return df.select("o_orderkey", F.expr("round(geom.parts[0].rings[0][0].x, 6)").alias("x0"), F.expr(f"round({geo.length('geom')}, 6)").alias("length"))


@query("""
WITH l AS (SELECT o_orderkey, o_orderkey % 2 AS way, o_orderkey * 17 % 900 AS x, o_orderkey * 31 % 200 AS y, 10 + o_orderkey % 50 AS len FROM orders),
s AS (SELECT s_suppkey % 200 AS y, s_suppkey * 9 % 900 AS a, s_suppkey * 9 % 900 + 20 AS b, min(s_suppkey) AS guide FROM supplier GROUP BY ALL),
j AS (SELECT l.*, guide, greatest(a, x) AS lo, least(b, x + len) AS hi FROM l LEFT JOIN s ON way = 0 AND s.y = l.y AND a < x + len AND b > x)
SELECT o_orderkey, guide, CAST(hi - lo AS DOUBLE) AS length FROM j WHERE guide IS NOT NULL
UNION ALL SELECT o_orderkey, NULL, CAST(lo - x AS DOUBLE) FROM j WHERE guide IS NOT NULL AND lo > x
UNION ALL SELECT o_orderkey, NULL, CAST(x + len - hi AS DOUBLE) FROM j WHERE guide IS NOT NULL AND hi < x + len
UNION ALL SELECT o_orderkey, NULL, CAST(len AS DOUBLE) FROM j WHERE guide IS NULL""")
def line_overlay_pieces(spark, sf):
    guide = keyed(table(spark, sf, "supplier", "s_suppkey"), "s_suppkey", geo.segment(
        as_double("s_suppkey * 9 % 900"), as_double("s_suppkey % 200"), as_double("s_suppkey * 9 % 900 + 20"), as_double("s_suppkey % 200")))
    df = lines.line_overlay(order_lines(spark, sf), guide, {"guide": "s_suppkey"})
    return df.select("o_orderkey", "guide", F.expr(f"round({geo.length('geom')}, 6)").alias("length"))


@query("""
WITH k AS (SELECT c_custkey AS k FROM customer WHERE c_custkey * 7 % 11 <> 0), i AS (SELECT k, k - row_number() OVER (ORDER BY k) AS island FROM k)
SELECT min(k) AS first, count(*) AS members, CAST(count(*) AS DOUBLE) AS length FROM i GROUP BY island
UNION ALL SELECT c_custkey, 1, 1.0 FROM customer WHERE c_custkey * 7 % 11 = 0""")
def combine_lines_chains(spark, sf):
    aside = "CASE WHEN c_custkey * 7 % 11 = 0 THEN 1D ELSE 0D END"  # every eleventh link lies beside the chain
    links = keyed(table(spark, sf, "customer", "c_custkey"), "c_custkey", geo.segment(as_double("c_custkey"), aside, as_double("c_custkey + 1"), aside))
    df = lines.combine_lines(links, [], [Aggregate("first", "c_custkey", "min"), Aggregate("members", how="count")])
    return df.select("first", "members", F.expr(f"round({geo.length('geom')}, 6)").alias("length"))


@query("""
WITH k AS (SELECT c_custkey AS k, c_nationkey AS nation FROM customer),
i AS (SELECT k, nation, row_number() OVER (ORDER BY k) - row_number() OVER (PARTITION BY nation ORDER BY k) AS island FROM k)
SELECT nation, min(k) AS first, CAST(count(*) AS DOUBLE) AS length FROM i GROUP BY nation, island""")
def combine_lines_reversible(spark, sf):
    # every other link runs backwards, so only chains that may be reversed go through
    x, y = as_double("c_custkey"), as_double("c_custkey + 1")
    shape = f"CASE WHEN c_custkey % 2 = 0 THEN {geo.segment(x, '0D', y, '0D')} ELSE {geo.segment(y, '0D', x, '0D')} END"
    links = keyed(table(spark, sf, "customer", "c_custkey", "c_nationkey"), "c_custkey", shape)
    df = lines.combine_lines(links, [("nation", "c_nationkey")], [Aggregate("first", "c_custkey", "min")], preserve_direction=False)
    return df.select("nation", "first", F.expr(f"round({geo.length('geom')}, 6)").alias("length"))


# ---- coordinates and codes ---------------------------------------------------

LONLAT = "CAST(c_custkey * 37 % 36000 AS DOUBLE) / 100 - 180 AS lon, CAST(c_custkey * 91 % 16000 AS DOUBLE) / 100 - 80 AS lat"


@query(f"""
WITH p AS (SELECT c_custkey, {LONLAT} FROM customer), b AS (
  SELECT c_custkey, least(1073741823, CAST(floor((lon + 180) / 360 * 1073741824) AS BIGINT)) AS i, least(1073741823, CAST(floor((lat + 90) / 180 * 1073741824) AS BIGINT)) AS j FROM p)
SELECT c_custkey, array_to_string(list_transform(range(0, 12), lambda n: substring('0123456789bcdefghjkmnpqrstuvwxyz', CAST(1 + list_sum(list_transform(range(0, 5), lambda m:
  (1 << (4 - m)) * (CASE WHEN (5 * n + m) % 2 = 0 THEN (i >> (29 - (5 * n + m) // 2)) & 1 ELSE (j >> (29 - (5 * n + m) // 2)) & 1 END))) AS INTEGER), 1)), '') AS hash FROM b""")
def geohash(spark, sf):
    df = table(spark, sf, "customer", "c_custkey").selectExpr("c_custkey", *LONLAT.split(", "))
    return df.select("c_custkey", F.expr(codes.geohash("lon", "lat")).alias("hash"))


def _utm_sql() -> str:
    """Easting and northing in zone 33 by the same series, as CTEs."""
    k = crs._kruger("GRS80")
    scale = crs.UTM_SCALE * k.radius
    east = " + ".join(f"{c!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(k.forward, 1))
    north = " + ".join(f"{c!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(k.forward, 1))
    return f"""
WITH p AS (SELECT c_custkey, 9 + CAST(c_custkey * 37 % 1200 AS DOUBLE) / 100 AS lon, 50 + CAST(c_custkey * 91 % 2500 AS DOUBLE) / 100 AS lat FROM customer),
s AS (SELECT *, sin(radians(lat)) AS sn, radians(lon - 15) AS dl FROM p), t AS (SELECT *, sinh(atanh(sn) - {k.ecc!r} * atanh({k.ecc!r} * sn)) AS t FROM s),
e AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM t)
SELECT c_custkey, round(500000 + {scale!r} * (eta + {east}), 3) AS easting, round({scale!r} * (xi + {north}), 3) AS northing, round(lon, 7) AS lon, round(lat, 7) AS lat FROM e"""


@query(_utm_sql())
def lonlat_utm(spark, sf):
    df = table(spark, sf, "customer", "c_custkey").selectExpr(
        "c_custkey", "9 + CAST(c_custkey * 37 % 1200 AS DOUBLE) / 100 AS lon0", "50 + CAST(c_custkey * 91 % 2500 AS DOUBLE) / 100 AS lat0")
    there = stored(df.select("c_custkey", F.expr(crs.transform_xy("lon0", "lat0", "EPSG:4258", "EPSG:25833")).alias("u")))
    back = there.withColumn("g", F.expr(crs.transform_xy("u.x", "u.y", "EPSG:25833", "EPSG:4258")))
    return back.selectExpr("c_custkey", "round(u.x, 3) AS easting", "round(u.y, 3) AS northing", "round(g.x, 7) AS lon", "round(g.y, 7) AS lat")


@query("""
WITH p AS (SELECT c_custkey, 3.05 + CAST(c_custkey % 50 AS DOUBLE) / 10 AS lon FROM customer)
SELECT c_custkey, CASE WHEN lon < 6 THEN '31' ELSE '32' END AS zone, 'U' AS band, 15 AS size FROM p""")
def mgrs(spark, sf):
    df = table(spark, sf, "customer", "c_custkey").selectExpr("c_custkey", "3.05D + CAST(c_custkey % 50 AS DOUBLE) / 10 AS lon")
    ref = df.withColumn("ref", F.expr(codes.mgrs("lon", "50D")))
    return ref.selectExpr("c_custkey", "substring(ref, 1, 2) AS zone", "substring(ref, 3, 1) AS band", "length(ref) AS size")


# ---- enrichment, pipelines, sources ------------------------------------------

@query("""
SELECT event_id, json_extract_string(body, '$.hits[0].k') AS k, event_type <> 'error' AND json_extract(body, '$.hits[0]') IS NOT NULL AS hit
FROM (SELECT event_id, event_type, '{"hits": [' || props || ']}' AS body FROM events)""")
def http_fields(spark, sf):
    df = table(spark, sf, "events", "event_id", "event_type", "props").selectExpr(
        "event_id", "CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status", "'{\"hits\": [' || props || ']}' AS body")
    values, hit = http.response_columns({"k": "k"}, "hits")
    return df.select("event_id", F.expr(values["k"]).alias("k"), F.expr(hit).alias("hit"))


def _answer(url: str, headers: dict, timeout: float):
    """Stands for a service: what it knows of a user, an error for every seventh, no hit for every fifth."""
    user = int(url.rsplit("=", 1)[1])
    if user % 7 == 0:
        return 404, b"", {}
    return 200, json.dumps({"hits": [] if user % 5 == 0 else [{"who": {"name": f"user {user}", "group": user % 3}}]}).encode(), {}


@query("""
SELECT event_id, CASE WHEN hit THEN 'user ' || user_id END AS name, CASE WHEN hit THEN CAST(user_id % 3 AS VARCHAR) END AS grp,
  CASE WHEN user_id % 7 = 0 THEN 404 ELSE 200 END AS status, hit
FROM (SELECT event_id, user_id, user_id % 7 <> 0 AND user_id % 5 <> 0 AS hit FROM events)""")
def http_lookup(spark, sf):
    step = {"url": "http://service/find?type=user&id={user_id}", "records": "hits", "fields": {"name": "who.name", "grp": "who.group"},
            "status_field": "status", "max_rate": 1e9, "concurrency": 4}
    out = http.http_lookup(table(spark, sf, "events", "event_id", "user_id"), step, scratch_path(spark), _answer)
    return out.select("event_id", "name", "grp", "status", F.col("__matched").alias("hit"))


@query("""
SELECT c_custkey, 'https://example.org/find?q=' || replace(c_mktsegment || ' ' || c_nationkey, ' ', '%20') || '&k=' || c_custkey AS url FROM customer""")
def http_request_urls(spark, sf):
    df = table(spark, sf, "customer", "c_custkey", "c_mktsegment", "c_nationkey").withColumn("q", F.expr("c_mktsegment || ' ' || c_nationkey"))
    return df.select("c_custkey", F.expr(http.request_sql("https://example.org/find?q={q}", None, {"k": "c_custkey"})).alias("url"))


def _pipeline(spark, frames: dict[str, DataFrame], base: str, steps: list[dict], items: list[dict] = [], source_crs: str = "EPSG:25833", **more) -> PipelineRun:
    made = spec.load({
        "name": "q", "working_crs": "EPSG:25833", "base": base, "steps": steps, "mapping": items, **more,
        "sources": [{"id": n, "format": "parquet", "uri": n, "crs": source_crs, "make_valid": False} for n in frames],
        "output": {"path": "unused.parquet", "layer": "out", "crs": "EPSG:25833"},
    })
    return PipelineRun(spark, made.pipelines[0], frames=frames)


FLAGSHIP = f"""
WITH p AS {PARTS}, d AS (SELECT DISTINCT x, y FROM {ORDERS}),
m AS (SELECT x, y, min(p_partkey) AS part FROM d JOIN p ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY x, y)
SELECT o_orderkey AS id, p_name AS part_name, CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END AS size_class,
  TRY_CAST(o_totalprice AS BIGINT) AS price, CAST(x AS DOUBLE) AS easting, CAST(y AS DOUBLE) AS northing
FROM {ORDERS} JOIN m USING (x, y) JOIN part ON p_partkey = part WHERE o_orderstatus <> 'P'"""


def flagship(spark, sf) -> DataFrame:
    """Orders made points, matched to the part box around them, filtered and mapped."""
    base = table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_totalprice").withColumn(ROW, F.array("o_orderkey"))
    run = _pipeline(spark, {"orders": base, "parts": parts(spark, sf, "p_name")}, "orders", [
        {"type": "make_points", "x": east_of("o_orderkey"), "y": "o_orderkey * 104729 % 1000", "crs": "EPSG:25833"},
        {"type": "spatial_join", "source": "parts", "fields": {"part_name": "p_name"}, "rejects": "unplaced"},
        {"type": "filter", "where": "o_orderstatus <> 'P'"},
    ], [
        {"to": "id", "from": "o_orderkey"}, {"to": "part_name", "from": "part_name"},
        {"to": "size_class", "expr": "CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END"},
        {"to": "price", "from": "o_totalprice", "cast": "BIGINT"}, {"to": "easting", "func": "x"}, {"to": "northing", "func": "y"},
    ])
    return run.layer(run.build().main, run.p.layers[0]).drop("geom")


query(FLAGSHIP)(flagship)


@query("""
WITH big AS (SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_acctbal > 0 GROUP BY c_nationkey)
SELECT c_custkey, n AS peers, total FROM customer LEFT JOIN big USING (c_nationkey)""")
def snapshot_self_join(spark, sf):
    run = _pipeline(spark, {"customers": customers(spark, sf, "c_nationkey", "c_acctbal")}, "customers", [
        {"type": "snapshot", "id": "solvent"},
        {"type": "filter", "branch": "solvent", "where": "c_acctbal > 0"},
        {"type": "attribute_join", "source": "solvent", "left": "c_nationkey", "right": "c_nationkey", "match": "summarize",
         "fields": {"peers": {"expr": "nullif(count(*), 0)"}, "total": {"expr": "round(sum(c_acctbal), 2)"}}},
    ], [{"to": "c_custkey", "from": "c_custkey"}, {"to": "peers", "from": "peers"}, {"to": "total", "from": "total"}])
    return run.layer(run.build().main, run.p.layers[0]).drop("geom")


@query("""
SELECT 'base' AS stage, count(*) AS n FROM customer UNION ALL SELECT 'filter', count(*) FROM customer WHERE c_acctbal > 0
UNION ALL SELECT 'poor', count(*) FROM customer WHERE (c_acctbal > 0) IS NOT TRUE
UNION ALL SELECT 'distinct', count(DISTINCT (c_nationkey, c_mktsegment)) FROM customer WHERE c_acctbal > 0""")
def step_counts(spark, sf):
    run = _pipeline(spark, {"customers": customers(spark, sf, "c_nationkey", "c_acctbal", "c_mktsegment")}, "customers", [
        {"type": "filter", "where": "c_acctbal > 0", "rejects": "poor"},
        {"type": "remove_duplicates", "by": ["c_nationkey", "c_mktsegment"]},
    ])
    counted = run.counts()
    stages = [("base", counted["base"]), ("filter", counted["steps"][1]), ("poor", counted["rejects"][1]), ("distinct", counted["steps"][2])]
    return spark.createDataFrame(stages, "stage string, n long")


@query(f"""
WITH p AS {PARTS}, wide AS (SELECT p_partkey, x0 - 3 AS x0, x1 + 3 AS x1, y0 AS ya, y1 AS yb, y0 - 3 AS y0, y1 + 3 AS y1, x0 AS xa, x1 AS xb FROM p WHERE p_size > 40)
SELECT s_suppkey, min(p_partkey) AS part FROM (SELECT s_suppkey, {point_sql('s_suppkey')} FROM supplier) JOIN wide
  ON (x BETWEEN xa AND xb AND y BETWEEN y0 AND y1) OR (x BETWEEN x0 AND x1 AND y BETWEEN ya AND yb) OR
     (greatest(xa - x, x - xb) BETWEEN 0 AND 3 AND greatest(ya - y, y - yb) BETWEEN 0 AND 3 AND
      (greatest(xa - x, x - xb), greatest(ya - y, y - yb)) IN ((1, 1), (1, 2), (2, 1), (2, 2), (0, 3), (3, 0))) GROUP BY s_suppkey""")
def derived_source_buffer(spark, sf):
    run = _pipeline(spark, {"suppliers": suppliers(spark, sf), "parts": parts(spark, sf, "p_size")}, "suppliers", [
        {"type": "spatial_join", "source": "around", "fields": {"part": "p_partkey"}, "rejects": "elsewhere"},
    ], [{"to": "s_suppkey", "from": "s_suppkey"}, {"to": "part", "from": "part"}],
        derived_sources=[{"id": "around", "from": "parts", "where": "p_size > 40", "buffer": 3}])
    return run.layer(run.build().main, run.p.layers[0]).drop("geom")


# Places in longitude and latitude, and as Web Mercator metres.
ORDER_LONLAT = "SELECT o_orderkey, -30 + CAST(o_orderkey * 37 % 12000 AS DOUBLE) / 100 AS lon, -60 + CAST(o_orderkey * 91 % 12500 AS DOUBLE) / 100 AS lat FROM orders"
MERCATOR_RADIUS = 6378137.0


def lonlat(spark, sf) -> DataFrame:
    return table(spark, sf, "orders", "o_orderkey").selectExpr(
        "o_orderkey", "-30 + CAST(o_orderkey * 37 % 12000 AS DOUBLE) / 100 AS lon", "-60 + CAST(o_orderkey * 91 % 12500 AS DOUBLE) / 100 AS lat",
    ).withColumn(ROW, F.array("o_orderkey"))


def _placed(spark, sf, items: list[dict]) -> PipelineRun:
    """Orders made points from degrees, in a pipeline that works in Web Mercator."""
    return _pipeline(spark, {"orders": lonlat(spark, sf)}, "orders", [{"type": "make_points", "x": "lon", "y": "lat"}], items, working_crs="EPSG:3857")


@query(f"""
SELECT o_orderkey, round({MERCATOR_RADIUS} * radians(lon), 3) AS east, round({MERCATOR_RADIUS} * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS north,
  round(lon, 7) AS lon, round(lat, 7) AS lat FROM ({ORDER_LONLAT})""")
def make_points_reprojected(spark, sf):
    """make_points from degrees into another system, and the x, y, lon and lat functions back."""
    items = [{"to": "o_orderkey", "from": "o_orderkey"}, *({"to": n, "func": f} for n, f in (("east", "x"), ("north", "y"), ("lon", "lon"), ("lat", "lat")))]
    run = _placed(spark, sf, items)
    out = run.layer(run.build().main, run.p.layers[0])
    return out.select("o_orderkey", *(F.round(c, 3).alias(c) for c in ("east", "north")), *(F.round(c, 7).alias(c) for c in ("lon", "lat")))


@query(f"SELECT o_orderkey FROM ({ORDER_LONLAT}) WHERE lon BETWEEN -10.005 AND 20.005 AND lat BETWEEN 30.005 AND 55.005")
def bbox_restriction(spark, sf):
    """A longitude and latitude window over a base that is brought to metres."""
    places = lonlat(spark, sf).withColumn("geom", F.expr(geo.point("lon", "lat")))
    run = _pipeline(spark, {"orders": places}, "orders", [], source_crs="EPSG:4326", working_crs="EPSG:3857")
    return run.build(bbox=(-10.005, 30.005, 20.005, 55.005)).main.select("o_orderkey")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, year(o_orderdate) AS y, 1 AS copies FROM orders")
def parquet_partitioned_source(spark, sf):
    """A table in folders of two columns, whose file names repeat: every row once, with a key of its own."""
    path = scratch_path(spark)
    rows = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate").withColumn("y", F.year("o_orderdate")).drop("o_orderdate")
    rows.repartition(2).write.partitionBy("o_orderstatus", "y").parquet(path)
    back = read_source(spark, spec.source({"id": "orders", "format": "parquet", "uri": path, "geometry": False}))
    keys = back.groupBy(ROW).agg(F.count("*").alias("copies"))
    return back.join(keys, ROW).select("o_orderkey", "o_custkey", "o_orderstatus", F.col("y").cast("long").alias("y"), "copies")


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_custkey) AS BIGINT) AS n FROM customer")
def csv_file_order(spark, sf):
    """CSV in several files: rows are numbered by file, then by their place in it."""
    path = scratch_path(spark)
    table(spark, sf, "customer", "c_custkey", "c_name").repartitionByRange(5, "c_custkey").sortWithinPartitions("c_custkey").write.option("header", True).csv(path)
    src = read_source(spark, spec.source({"id": "customers", "format": "csv", "uri": path}))
    return rows.seq(src, "n").select(F.col("c_custkey").cast("long").alias("c_custkey"), F.col("n").cast("long").alias("n"))


@query(f"SELECT p_partkey, p_name, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area FROM {PARTS}")
def geoparquet_roundtrip(spark, sf):
    path = scratch_path(spark)
    sinks.write_layer(parts(spark, sf, "p_name"), "parts", path, "EPSG:25833")
    src = spec.source({"id": "parts", "format": "parquet", "uri": path, "crs": "EPSG:25833"})
    return read_source(spark, src).select("p_partkey", "p_name", area())


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area FROM {PARTS}")
def csv_wkt_source(spark, sf):
    path = scratch_path(spark)
    parts(spark, sf).select("p_partkey", F.expr(text.as_wkt("geom")).alias("shape")).write.option("header", True).csv(path)
    src = spec.source({"id": "parts", "format": "csv", "uri": path, "geom_field": "shape", "header_row": True})
    return read_source(spark, src).select("p_partkey", area())


@query(f"SELECT p_partkey, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area FROM {PARTS}")
def geojson_source(spark, sf):
    path = scratch_path(spark)
    feature = f"""concat('{{"type":"Feature","properties":', to_json(struct(p_partkey)), ',"geometry":', {text.as_geojson('geom')}, '}}')"""
    parts(spark, sf).select(F.expr(feature).alias("value")).write.text(path)
    src = spec.source({"id": "parts", "format": "geojson", "uri": path, "lines": True})
    return read_source(spark, src).select("p_partkey", area())


@query("SELECT event_id, k FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)")
def json_records_source(spark, sf):
    path = scratch_path(spark)
    table(spark, sf, "events", "event_id", "props").selectExpr("to_json(struct(event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k)) AS value").write.text(path)
    return read_source(spark, spec.source({"id": "events", "format": "json", "uri": path, "lines": True})).select("event_id", "k")


@query(f"""
SELECT p_partkey, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS a, x0 AS west, round(sqrt(2) * (x1 - x0), 6) AS diagonal, p_name LIKE '%ring%' AS ringed FROM {PARTS}""")
def sql_functions(spark, sf):
    dialect.register(spark, "ST_Area ST_XMin ST_YMin ST_XMax ST_YMax ST_Distance ST_Point regexp_matches")
    return parts(spark, sf, "p_name").selectExpr(
        "p_partkey", "ST_Area(geom) AS a", "CAST(ST_XMin(geom) AS BIGINT) AS west",
        "round(ST_Distance(ST_Point(ST_XMin(geom), ST_YMin(geom)), ST_Point(ST_XMax(geom), ST_YMax(geom))), 6) AS diagonal",
        "regexp_matches(p_name, 'ring') AS ringed")
