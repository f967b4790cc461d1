"""Output columns: copied, constant, computed, looked up, and cast."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codes, crs
from ..functions import geometry as geo
from ..functions import text, wkb
from ..operators.rows import seq

# ---- fixed values: the computed columns, and other engines' names for Spark's types ----
FUNCS = (
    "uuid", "seq", "now", "today", "lat", "lon", "x", "y", "mgrs", "geohash", "wkb", "wkt", "geom_type", "area", "length",
)
PLAIN_FUNCS = ("uuid", "seq", "now", "today")
MEASURES = ("area", "length")
TYPE_NAMES = {
    "VARCHAR": "STRING", "TEXT": "STRING", "CHAR": "STRING", "HUGEINT": "DECIMAL(38, 0)", "UBIGINT": "DECIMAL(20, 0)",
    "UINTEGER": "BIGINT", "USMALLINT": "INT", "UTINYINT": "SMALLINT", "INTEGER": "INT", "INT4": "INT", "INT8": "BIGINT",
    "LONG": "BIGINT", "REAL": "FLOAT", "FLOAT4": "FLOAT", "FLOAT8": "DOUBLE", "BOOL": "BOOLEAN", "TIMESTAMP": "TIMESTAMP_NTZ",
    "BLOB": "BINARY",
}
INTEGER_TYPES = ("TINYINT", "SMALLINT", "INT", "BIGINT", "DECIMAL(38, 0)", "DECIMAL(20, 0)")
# ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class CodeRule:
    test: str
    pattern: str | None
    value: str


@dataclass(frozen=True)
class CodeList:
    source: str
    rules: list[CodeRule] = field(default_factory=list)
    default: str | None = None
    case_insensitive: bool = True
    file: str | None = None
    file_match_col: str | None = None
    file_value_col: str | None = None


@dataclass(frozen=True)
class MapItem:
    to: str
    column: str | None = None
    const: object = None
    has_const: bool = False
    expr: str | None = None
    func: str | None = None
    codelist: CodeList | None = None
    cast: str | None = None


def func_column(name: str, working_crs: str) -> Column:
    """A computed column over `geom` (in the working CRS)."""
    center = geo.centroid("geom")

    def lonlat(fn) -> Column:
        c = text.let(center, lambda p: text.let(f"{p}.parts[0].rings[0][0]", lambda v: text.let(
            crs.transform_xy(f"{v}.x", f"{v}.y", working_crs, "EPSG:4326"), lambda q: fn(f"{q}.x", f"{q}.y"))))
        return F.expr(f"CASE WHEN size(geom.parts) > 0 THEN {c} END")

    first = f"({center}).parts[0].rings[0][0]"
    return {
        "uuid": lambda: F.expr("uuid()"),
        "now": F.current_timestamp,
        "today": F.current_date,
        "lon": lambda: lonlat(lambda x, y: f"round({x}, 7)"),
        "lat": lambda: lonlat(lambda x, y: f"round({y}, 7)"),
        "x": lambda: F.expr(f"CASE WHEN size(geom.parts) > 0 THEN round({first}.x, 3) END"),
        "y": lambda: F.expr(f"CASE WHEN size(geom.parts) > 0 THEN round({first}.y, 3) END"),
        "mgrs": lambda: lonlat(codes.mgrs),
        "geohash": lambda: lonlat(codes.geohash),
        "wkt": lambda: F.expr(text.let(crs.transform("geom", working_crs, "EPSG:4326"), text.as_wkt)),
        "geom_type": lambda: F.expr("geom.kind"),
        "area": lambda: F.expr(geo.area("geom")),
        "length": lambda: F.expr(f"{geo.length('geom')} + {geo.perimeter('geom')}"),
    }[name]()


# ---- casts ------------------------------------------------------------------

DAY_FIRST = r"^\s*(\d{1,2})\.(\d{1,2})\.(\d{4})(?: (\d{1,2}):(\d{1,2})(?::(\d{1,2}))?)?\s*$"
YEAR_FIRST = r"^\s*\d{4,}-\d{1,2}-\d{1,2}"


def cast_sql(value: str, kind: T.DataType, target: str) -> str:
    """`value` (of type `kind`) as another SQL type, NULL where it can't be. Dates are read in
    ISO form or as dd.mm.yyyy with an optional time; integers are rounded to, not cut off."""
    name = TYPE_NAMES.get(target.strip().upper(), target.strip().upper())
    if name in ("DATE", "TIMESTAMP_NTZ"):
        if not isinstance(kind, T.StringType):
            return f"try_cast({value} AS {name})"
        pattern = geo.literal(DAY_FIRST)
        part = lambda i, size=2: f"lpad(coalesce(nullif(regexp_extract({value}, {pattern}, {i}), ''), '0'), {size}, '0')"
        turned = f"concat({part(3, 4)}, '-', {part(2)}, '-', {part(1)}, ' ', {part(4)}, ':', {part(5)}, ':', {part(6)})"
        return (
            f"CASE WHEN {value} RLIKE {geo.literal(YEAR_FIRST)} THEN try_cast({value} AS {name}) "
            f"WHEN {value} RLIKE {pattern} THEN CAST(try_cast({turned} AS TIMESTAMP_NTZ) AS {name}) END"
        )
    if name in INTEGER_TYPES:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return f"try_cast(rint({value}) AS {name})"
        if isinstance(kind, T.StringType):
            return f"try_cast(round(try_cast({value} AS DECIMAL(38, 10))) AS {name})"
        if isinstance(kind, T.DecimalType):
            return f"try_cast(round({value}) AS {name})"
    if name == "STRING":
        return f"CAST({value} AS STRING)"
    return f"try_cast({value} AS {name})"


# ---- codelists --------------------------------------------------------------

def rules_sql(cl: CodeList) -> str:
    """The first rule that holds gives the value."""
    col = f"CAST({geo.quote(cl.source)} AS STRING)"
    side = f"lower({col})" if cl.case_insensitive else col
    fold = str.lower if cl.case_insensitive else str

    def holds(rule: CodeRule) -> str:
        if rule.test == "is_blank":
            return f"({col} IS NULL OR {col} = '')"
        if rule.test == "regex":
            return f"{col} RLIKE {geo.literal(('(?i)' if cl.case_insensitive else '') + rule.pattern)}"
        pattern = fold(rule.pattern)
        if rule.test == "like":
            return f"{side} LIKE {geo.literal(pattern.replace(chr(92), chr(92) * 2))}"
        return f"{side} = {geo.literal(pattern)}"

    arms = " ".join(f"WHEN {holds(r)} THEN {geo.literal(r.value)}" for r in cl.rules)
    return f"CASE {arms} ELSE {'NULL' if cl.default is None else geo.literal(cl.default)} END"


def with_file_codes(df: DataFrame, cl: CodeList, name: str) -> DataFrame:
    """`df` plus the value a CSV gives for each row's code (the first row of a repeated code)."""
    table = df.sparkSession.read.option("header", True).csv(cl.file)
    return with_code_table(df, table, cl, name)


def with_code_table(df: DataFrame, table: DataFrame, cl: CodeList, name: str) -> DataFrame:
    fold = (lambda c: F.lower(c)) if cl.case_insensitive else (lambda c: c)
    codes_ = (
        table.select(
            fold(F.col(geo.quote(cl.file_match_col)).cast("string")).alias("__code"), F.col(geo.quote(cl.file_value_col)).alias("__value"),
            F.monotonically_increasing_id().alias("__line"),
        ).groupBy("__code").agg(F.min_by("__value", "__line").alias("__value"))
    )
    joined = df.withColumn("__key", fold(F.col(geo.quote(cl.source)).cast("string"))).join(codes_, F.col("__key") == F.col("__code"), "left")
    value = F.col("__value") if cl.default is None else F.coalesce("__value", F.lit(cl.default))
    return joined.withColumn(name, value).drop("__key", "__code", "__value")


# ---- items ------------------------------------------------------------------

def item_value(df: DataFrame, item: MapItem, working_crs: str, scratch: str) -> tuple[DataFrame, Column]:
    """The column of one item, and the rows to take it from (a lookup or numbering adds one)."""
    if item.func in FUNCS and item.func not in PLAIN_FUNCS and "geom" not in df.columns:
        raise ValueError(f"mapping uses ['{item.func}'] but the rows have no geometry")
    if item.func == "seq":
        df = seq(df, scratch)
        value = F.col(scratch)
    elif item.func == "wkb":
        df = df.withColumn(scratch, F.expr(crs.transform("geom", working_crs, "EPSG:4326")))
        value = F.hex(wkb.to_wkb(F.col(scratch)))
    elif item.codelist is not None and item.codelist.file:
        df = with_file_codes(df, item.codelist, scratch)
        value = F.col(scratch)
    elif item.codelist is not None:
        value = F.expr(rules_sql(item.codelist))
    elif item.func is not None:
        value = func_column(item.func, working_crs)
    elif item.has_const:
        value = F.lit(item.const)
    elif item.expr is not None:
        value = F.expr(f"({item.expr})")
    else:
        value = F.col(geo.quote(item.column))
    if item.cast:
        # the source type decides how a cast behaves; only the plan is looked at
        named = df.withColumn(f"{scratch}v", value)
        kind = named.schema[f"{scratch}v"].dataType
        df, value = named, F.expr(cast_sql(f"{scratch}v", kind, item.cast))
    return df, value


def mapped(df: DataFrame, items: list[MapItem], working_crs: str, keep: list[str] = []) -> DataFrame:
    """One column per item, in order, then the columns to `keep`."""
    values = []
    for i, item in enumerate(items):
        df, value = item_value(df, item, working_crs, f"__m{i}_")
        values.append(value.alias(item.to))
    return df.select(*values, *[F.col(geo.quote(c)) for c in keep])


def set_items(df: DataFrame, items: list[MapItem], drop: list[str], working_crs: str) -> DataFrame:
    """The attributes step: items set one after another, each seeing the ones before it."""
    for i, item in enumerate(items):
        names = df.columns
        rows, value = item_value(df, item, working_crs, f"__m{i}_")
        kept = [F.col(geo.quote(c)) for c in names if c.lower() != item.to.lower()]
        df = rows.select(*kept, value.alias(item.to))
    gone = {d.lower() for d in drop}
    return df.select(*[F.col(geo.quote(c)) for c in df.columns if c.lower() not in gone])


# ---- conditions -------------------------------------------------------------

def condition(column: str, operator: str, value=None, kind: T.DataType | None = None) -> str:
    """One test of the condition builder as SQL; text columns are compared as text."""
    c = geo.quote(column)
    textual = kind is None or isinstance(kind, T.StringType)

    def lit(v) -> str:
        if isinstance(v, bool) or (isinstance(v, (int, float)) and not textual):
            return str(v).lower()
        return geo.literal(str(v))

    like = lambda p: geo.literal(p)
    if operator in ("in", "not in"):
        listed = ", ".join(lit(v) for v in value)
        return f"{c} {operator.upper()} ({listed})"
    compare = {"is": "=", "is not": "<>", ">": ">", ">=": ">=", "<": "<", "<=": "<="}
    if operator in compare:
        return f"{c} {compare[operator]} {lit(value)}"
    return {
        "contains": lambda: f"CAST({c} AS STRING) ILIKE {like(f'%{value}%')}",
        "doesn't contain": lambda: f"CAST({c} AS STRING) NOT ILIKE {like(f'%{value}%')}",
        "starts with": lambda: f"CAST({c} AS STRING) ILIKE {like(f'{value}%')}",
        "is empty": lambda: f"({c} IS NULL OR CAST({c} AS STRING) = '')",
        "is not empty": lambda: f"({c} IS NOT NULL AND CAST({c} AS STRING) <> '')",
    }[operator]()


def conditions(tests: list[str], any_of: bool = False) -> str:
    return (" OR " if any_of else " AND ").join(f"({t})" for t in tests) or "true"
