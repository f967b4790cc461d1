"""Reading sources into DataFrames with a `geom` column and a row key."""
from __future__ import annotations

import json
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import crs, text, wkb
from ..functions import geometry as geo
from ..operators.grid import stored
from ..operators.joins import ROW

GEOJSON_GEOMETRY = "STRUCT<type: STRING, coordinates: STRING, geometries: ARRAY<STRUCT<type: STRING, coordinates: STRING>>>"


def read_source(spark: SparkSession, src, landing: str | None = None, fetch=None) -> DataFrame:
    """The raw rows of a source: its columns, `geom` if it has geometry, and `__src_row`."""
    from . import services

    remote = src.uri.startswith(("http://", "https://")) or src.format == "wfs"
    if src.format in ("oapif", "arcgis_rest"):
        df = services.read_features(spark, src, landing, fetch)
    else:
        path = services.landed_file(spark, src, landing, fetch) if remote else src.uri
        df = READERS[src.format](spark, src, path)
    if ROW not in df.columns:
        # sources that aren't tables of files: numbered by partition
        df = df.withColumn(ROW, F.array(F.monotonically_increasing_id()))
    return df


# ---- row keys ---------------------------------------------------------------

# Bytes of a path that one long of a row key holds, so that longs sort as the bytes do.
PATH_BYTES = 7


def _spelled(path: str) -> str:
    """A path as Spark's metadata column spells it: `file:/`, where a listing has `file:///`."""
    return path.replace(":///", ":/")


def _beyond(a: bytes, b: bytes) -> int:
    """Bytes up to and with the first that differs."""
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) + 1


def file_rank(files: list[str]) -> list[Column]:
    """Longs that sort as the paths of the rows' files do: those bytes of a path that tell the
    files of this read apart, taken from the metadata column. They are constants of a file, so
    neither a join nor a pass over the rows is needed, and filters still reach the scan."""
    paths = sorted({_spelled(f).encode() for f in files})
    if len(paths) < 2:
        return [F.lit(0).cast("bigint")]
    start = _beyond(paths[0], paths[-1]) - 1
    width = max(_beyond(a, b) for a, b in zip(paths, paths[1:])) - start
    path = F.encode(F.replace(F.col("_metadata.file_path"), F.lit(":///"), F.lit(":/")), "UTF-8")
    # a path in another spelling would be ordered wrongly without a word
    known = F.substring(path, 1, start) == F.lit(paths[0][:start])
    def rank(at: int) -> Column:
        some = F.substring(path, start + at + 1, min(PATH_BYTES, width - at))
        return F.conv(F.rpad(F.hex(some), 2 * PATH_BYTES, F.lit("0")), 16, 10).cast("bigint")

    first, *more = (rank(at) for at in range(0, width, PATH_BYTES))
    unknown = F.raise_error(F.concat(F.lit("a file outside the source's listing: "), F.col("_metadata.file_path"))).cast("bigint")
    return [F.when(known, first).otherwise(unknown), *more]


def with_file_order(df: DataFrame, rows_numbered: bool = True) -> DataFrame:
    """`__src_row` of a read of files: (the file's rank in path order, place in the file). The
    place is Parquet's row number; of text it is where the row's block begins and the row's
    number in the task that reads it."""
    own = [F.col(geo.quote(c)) for c in df.columns]
    place = [F.col("_metadata.row_index")] if rows_numbered else [F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    return df.select(*own, F.array(*file_rank(df.inputFiles()), *place).alias(ROW))


# ---- parquet ----------------------------------------------------------------

def geo_metadata(spark: SparkSession, path: str) -> dict:
    """The `geo` entry a GeoParquet sink left beside a layer, or else that of a file's footer;
    both are read through the file system the data is on."""
    jvm = spark._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(conf)
    if not fs.exists(top):
        return {}
    beside = jvm.org.apache.hadoop.fs.Path(top, "_geo.json")
    if fs.exists(beside):
        source = fs.open(beside)
        try:
            return json.loads(bytes(source.readAllBytes()).decode("utf-8"))
        finally:
            source.close()
    files = sorted(f for f in spark.read.parquet(path).inputFiles())
    if not files:
        return {}
    first = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0])), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(first)
    try:
        entry = reader.getFooter().getFileMetaData().getKeyValueMetaData().get("geo")
    finally:
        reader.close()
    return json.loads(entry) if entry else {}


def geo_crs(meta: dict) -> str | None:
    """EPSG name of a GeoParquet file's CRS; CRS84, the default, is EPSG:4326."""
    column = meta.get("columns", {}).get(meta.get("primary_column", ""), {})
    ident = (column.get("crs") or {}).get("id") if column else None
    if not column:
        return None
    if not ident or str(ident.get("code")) == "CRS84":
        return "EPSG:4326"
    return f"{ident['authority']}:{ident['code']}"


def read_parquet(spark: SparkSession, src, path: str) -> DataFrame:
    df = with_file_order(spark.read.parquet(path))
    if not src.has_geometry:
        return df
    meta = geo_metadata(spark, path)
    if not src.crs and geo_crs(meta):
        warnings.warn(f"source '{src.id}' names no crs and is taken to be in the working CRS, but its file says {geo_crs(meta)}", stacklevel=2)
    name = meta.get("primary_column") or next(
        (f.name for f in df.schema.fields if isinstance(f.dataType, T.BinaryType)), None)
    if name is None:
        return df
    others = [F.col(geo.quote(c)) for c in df.columns if c not in (name, "bbox" if "bbox" in df.columns else "")]
    return df.select(*others, F.col(geo.quote(name)).alias("__wkb")).withColumn("geom", wkb.from_wkb(F.col("__wkb"))).drop("__wkb")


# ---- text tables ------------------------------------------------------------

def read_csv(spark: SparkSession, src, path: str) -> DataFrame:
    """A first row of names unless `header_row` is false; columns then are field_1, field_2, …
    With `lines` (the default for CSV) a row is a line, and large files are split; where quoted
    values hold line breaks, `lines: false` reads each file as a whole."""
    header = src.header_row is not False
    df = spark.read.option("header", header).option("multiLine", src.lines is False).option("escape", '"').csv(path)
    if not header:
        names = [f"field_{i}" for i in range(1, len(df.columns) + 1)]
        df = df.withColumnsRenamed(dict(zip(df.columns, names)))
    return with_table_geometry(with_file_order(df, rows_numbered=False), src)


def read_json(spark: SparkSession, src, path: str) -> DataFrame:
    """A document per file (a list of records, or `records` inside it), or with `lines: true` a
    record per line, which large files need to be split."""
    df = with_file_order(spark.read.option("multiLine", not src.lines).json(path), rows_numbered=False)
    if src.records:
        inside = F.col(".".join(geo.quote(p) for p in src.records.split(".")))
        df = df.select(ROW, F.posexplode(inside).alias("__pos", "r")).select("r.*", F.concat(ROW, F.array(F.col("__pos").cast("bigint"))).alias(ROW))
    return with_table_geometry(df, src)


def with_table_geometry(df: DataFrame, src) -> DataFrame:
    """`geom` built from the x/y or geometry column a table source names, which it replaces.
    Values that are no numbers or no geometry give a NULL one."""
    if src.x_field:
        x, y = (f"try_cast(CAST({geo.quote(c)} AS STRING) AS DOUBLE)" for c in (src.x_field, src.y_field))
        made, used = F.expr(geo.point(x, y)), {src.x_field.lower(), src.y_field.lower(), "geom"}
        rows = df
    elif src.geom_field:
        used = {src.geom_field.lower(), "geom"}
        c = geo.quote(src.geom_field)
        kind = df.schema[src.geom_field].dataType
        if isinstance(kind, T.StructType):
            made, rows = F.expr(text.from_geojson("__t")), df.withColumn("__t", F.to_json(c))
        else:
            rows = df.withColumn("__t", F.col(c).cast("string")).withColumn(
                "__h", F.expr("CASE WHEN __t RLIKE '^([0-9A-Fa-f]{2})+$' THEN unhex(__t) END")).withColumn("__b", wkb.from_wkb(F.col("__h")))
            made = F.expr(
                f"CASE WHEN trim(__t) = '' THEN NULL WHEN __t RLIKE '^[0-9A-Fa-f]+$' THEN __b "
                f"WHEN startswith(ltrim(__t), '{{') THEN {text.from_geojson('__t')} ELSE {text.from_wkt('__t')} END")
    else:
        return df
    kept = [F.col(geo.quote(c)) for c in df.columns if c.lower() not in used]
    return rows.select(*kept, made.alias("geom"))


# ---- GeoJSON ----------------------------------------------------------------

def read_geojson(spark: SparkSession, src, path: str) -> DataFrame:
    """A FeatureCollection per file, or with `lines: true` one feature per line. The properties'
    types are found over the whole file; coordinates are handed over as text and decoded per
    geometry type."""
    per_line = bool(src.lines)
    reader = spark.read.option("multiLine", not per_line)
    seen = reader.json(path).schema
    feature = seen if per_line else (seen["features"].dataType.elementType if "features" in seen.names else T.StructType())
    fields = [T.StructField("geometry", _type(spark, GEOJSON_GEOMETRY))]
    if "properties" in feature.names and isinstance(feature["properties"].dataType, T.StructType):
        fields.append(feature["properties"])
    one = T.StructType(fields)
    schema = one if per_line else T.StructType([T.StructField("features", T.ArrayType(one))])
    df = with_file_order(spark.read.option("multiLine", not per_line).schema(schema).json(path), rows_numbered=False)
    if not per_line:
        df = df.select(ROW, F.posexplode("features").alias("__pos", "f")).select("f.*", F.concat(ROW, F.array(F.col("__pos").cast("bigint"))).alias(ROW))
    properties = ["properties.*"] if len(fields) > 1 else []
    parts = f"flatten(transform(geometry.geometries, m -> {text.from_geojson_parts('m.type', 'm.coordinates')}.parts))"
    geom = (
        f"CASE WHEN geometry.type = 'GeometryCollection' THEN {geo._geometry(repr('GEOMETRYCOLLECTION'), parts)} "
        f"ELSE {text.from_geojson_parts('geometry.type', 'geometry.coordinates')} END"
    )
    return df.select(*properties, ROW, F.expr(geom).alias("geom"))


def _type(spark: SparkSession, ddl: str) -> T.DataType:
    return T._parse_datatype_string(ddl)


# ---- GML --------------------------------------------------------------------

# ---- fixed values: GML's geometry elements by the kind they make ----
GML_KINDS = (
    ("MultiSurface|MultiPolygon|CompositeSurface", "MULTIPOLYGON"), ("Polygon|Surface|PolygonPatch", "POLYGON"),
    ("MultiCurve|MultiLineString", "MULTILINESTRING"), ("LineString|Curve|LineStringSegment", "LINESTRING"),
    ("MultiPoint", "MULTIPOINT"), ("Point", "POINT"),
)
# ---------------------------------------------------------------------


def read_gml(spark: SparkSession, src, path: str) -> DataFrame:
    """Feature members by Spark's XML source; the geometry is taken as raw XML and its
    position lists split into vertices."""
    tag = src.layer or _first_member(spark, path)
    reader = lambda: spark.read.format("xml").option("rowTag", tag)
    seen = reader().load(path).schema
    wanted = {n for names, _ in GML_KINDS for n in names.split("|")}

    def holds(kind) -> bool:
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        return isinstance(kind, T.StructType) and any(f.name.split(":")[-1] in wanted or holds(f.dataType) for f in kind.fields)

    name = next((f.name for f in seen.fields if holds(f.dataType)), None)
    fields = [T.StructField(f.name, T.StringType() if f.name == name else f.dataType) for f in seen.fields]
    df = reader().schema(T.StructType(fields)).load(path)
    plain = {f.name: f.name.split(":")[-1].lstrip("_") for f in fields if f.name != name and not isinstance(f.dataType, T.StructType)}
    kept = [F.col(geo.quote(c)).alias(n) for c, n in plain.items()]
    if name is None:
        return df.select(*kept)
    swap = crs.lookup(src.crs or "EPSG:25833")
    flipped = bool(swap and swap.in_degrees)
    return df.select(*kept, F.expr(gml_geometry(geo.quote(name), flipped)).alias("geom"))


def gml_geometry(xml: str, lat_first: bool = False) -> str:
    """Geometry of a GML fragment; with `lat_first`, urn-style geographic CRS names mean the
    positions run latitude, longitude."""
    element = lambda names: f"'<(?:[A-Za-z0-9_]+:)?(?:{names})[ >]'"
    order = f"({str(lat_first).lower()} AND {xml} LIKE '%urn:ogc:def:crs:EPSG%')"
    n, i, r, p = geo.var("n"), geo.var("i"), geo.var("r"), geo.var("p")

    def ring(t: str) -> str:
        numbers = f"transform(split(trim(regexp_replace({t}, '[ ,\\n\\t]+', ' ')), ' '), {n} -> try_cast({n} AS DOUBLE))"
        return text.let(numbers, lambda v: (
            f"transform(sequence(0, CAST(size({v}) / 2 AS INT) - 1), {i} -> named_struct("
            f"'x', CASE WHEN {order} THEN {v}[2 * {i} + 1] ELSE {v}[2 * {i}] END, "
            f"'y', CASE WHEN {order} THEN {v}[2 * {i}] ELSE {v}[2 * {i} + 1] END, 'z', CAST(NULL AS DOUBLE)))"))

    lists = lambda t: f"regexp_extract_all({t}, '<(?:[A-Za-z0-9_]+:)?(?:posList|pos|coordinates)[^>]*>([^<]*)<', 1)"
    part = lambda dim, rings: f"named_struct('dim', {dim}, 'rings', {rings})"
    rings_of = lambda t: f"transform({lists(t)}, {r} -> {ring(r)})"
    areas = (
        f"transform(filter(split({xml}, '<(?:[A-Za-z0-9_]+:)?(?:Polygon|PolygonPatch)[ >]'), {p} -> size({lists(p)}) > 0), "
        f"{p} -> {part(2, rings_of(p))})"
    )
    lines = f"transform({lists(xml)}, {r} -> {part(1, f'array({ring(r)})')})"
    dots = f"transform({lists(xml)}, {r} -> {part(0, f'array({ring(r)})')})"
    cases = " ".join(
        f"WHEN {xml} RLIKE {element(names)} THEN {geo._geometry(geo.literal(kind), areas if 'POLYGON' in kind else lines if 'LINE' in kind else dots)}"
        for names, kind in GML_KINDS)
    return f"CASE {cases} END"


# ---- fixed values: elements that hold the features of a GML document ----
GML_MEMBERS = ("gml:featureMember", "wfs:member", "gml:featureMembers", "featureMember", "member", "featureMembers")
# --------------------------------------------------------------------------


def _first_member(spark: SparkSession, path: str) -> str:
    """The element inside the documents' members, found by reading them as rows."""
    for tag in GML_MEMBERS:
        for f in spark.read.format("xml").option("rowTag", tag).load(path).schema.fields:
            kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
            if isinstance(kind, T.StructType):
                return f.name
    raise ValueError(f"{path} has no feature members: say which element is a feature in the source's layer")


# ---- GeoPackage and databases -----------------------------------------------

def read_gpkg(spark: SparkSession, src, path: str) -> DataFrame:
    from .gpkg import GeoPackageSource

    spark.dataSource.register(GeoPackageSource)
    df = spark.read.format("geoweft_gpkg").option("path", path).option("table", src.layer or "").load()
    kept = [F.col(geo.quote(c)) for c in df.columns if c not in ("__blob", "__rowid")]
    key = F.array("__rowid").alias(ROW)
    if "__blob" not in df.columns:
        return df.select(*kept, key)
    return df.select(*kept, key, wkb.from_wkb(F.col("__blob")).alias("geom"))


def jdbc_options(src, partition: dict | None = None) -> dict[str, str]:
    """Options of Spark's JDBC source for `schema.table` (schema `public` when not given)."""
    schema, _, table = (src.layer or "").rpartition(".")
    url = src.uri if src.uri.startswith("jdbc:") else "jdbc:" + src.uri.replace("postgres://", "postgresql://", 1)
    return {"url": url, "dbtable": f'"{schema or "public"}"."{table}"', **(partition or {})}


def read_postgres(spark: SparkSession, src, _path: str) -> DataFrame:
    df = spark.read.format("jdbc").options(**jdbc_options(src)).load()
    name = next((f.name for f in df.schema.fields if f.name.lower() in ("geom", "geometry", "wkb_geometry", "the_geom")), None)
    return df if name is None else with_hex_geometry(df, name)


def with_hex_geometry(df: DataFrame, column: str) -> DataFrame:
    """A column of hex (E)WKB text as `geom`."""
    kept = [F.col(geo.quote(c)) for c in df.columns if c != column]
    raw = df.select(*kept, F.expr(f"unhex(CAST({geo.quote(column)} AS STRING))").alias("__wkb"))
    return raw.withColumn("geom", wkb.from_wkb(F.col("__wkb"))).drop("__wkb")


READERS = {
    "parquet": read_parquet, "csv": read_csv, "json": read_json, "geojson": read_geojson, "gml": read_gml, "wfs": read_gml,
    "gpkg": read_gpkg, "postgres": read_postgres,
}


# ---- loading ----------------------------------------------------------------

def loaded(df: DataFrame, src, working_crs: str) -> DataFrame:
    """A source's rows with their geometry in the working CRS, flattened and repaired as its
    settings say."""
    from ..operators.overlay import repaired

    if not src.has_geometry:
        return df.drop("geom") if src.geometry is False else df
    if "geom" not in df.columns:
        return df
    own = "EPSG:4326" if src.format in ("arcgis_rest", "oapif") else (src.crs or working_crs)
    geom = crs.transform("geom", own, working_crs)
    if geom != "geom":
        df = df.withColumn("geom", F.expr(geom))
    if src.force_2d:
        df = df.withColumn("geom", F.expr(geo.force_2d("geom")))
    if src.make_valid and not src.x_field:
        df = repaired(df)
    return df


def described(df: DataFrame, src) -> dict:
    """Columns, CRS and a warning where 500 features' extent doesn't fit the CRS."""
    info = {"columns": {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name not in (ROW, "geom")}, "crs": src.crs, "warning": None}
    if "geom" in df.columns and src.crs:
        b = df.limit(500).select(F.expr(geo.bbox("geom")).alias("b")).agg(
            F.min("b.xmin"), F.min("b.ymin"), F.max("b.xmax"), F.max("b.ymax")).first()
        if b[0] is not None:
            degrees = all(-180.5 <= v <= 180.5 for v in (b[0], b[2])) and all(-90.5 <= v <= 90.5 for v in (b[1], b[3]))
            declared = crs.require(src.crs).in_degrees
            if declared != degrees:
                info["warning"] = f"{src.crs} is in {'degrees' if declared else 'metres'}, but the coordinates look like {'degrees' if degrees else 'metres'}"
    return info
