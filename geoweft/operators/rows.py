"""Steps that work row by row or on whole rows: filter, attributes, duplicates, merging."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import crs as crs_functions
from ..functions import geometry as geo
from .joins import ROW


def filter_rows(df: DataFrame, where: str) -> DataFrame:
    """All rows, `__matched` where the condition holds (NULL counts as not)."""
    return df.withColumn("__matched", F.coalesce(F.expr(where), F.lit(False)))


def set_columns(df: DataFrame, columns: list, drop: list[str] = []) -> DataFrame:
    """`columns` are (name, SQL or Column), set in order; a replaced column moves to the end."""
    for name, value in columns:
        made = F.expr(value) if isinstance(value, str) else value
        kept = [F.col(geo.quote(c)) for c in df.columns if c.lower() != name.lower()]
        df = df.select(*kept, made.alias(name))
    gone = {d.lower() for d in drop}
    return df.select(*[F.col(geo.quote(c)) for c in df.columns if c.lower() not in gone])


def remove_duplicates(df: DataFrame, by: list[str], geometry: bool = False) -> DataFrame:
    """All rows, `__matched` on the first (in row order) of each set of equal ones.

    The first row of a set is found by an aggregate (partial per partition first), so a set
    holding a third of the table isn't sorted in one task."""
    keys = [F.col(geo.quote(c)).alias(f"__d{i}") for i, c in enumerate(by)]
    if geometry:
        keys.append(F.expr(geo.normalized("geom")).alias("__dg"))
    marked = df.withColumn("__dup", F.struct(*keys))
    first = marked.groupBy("__dup").agg(F.min(ROW).alias("__first")).select(F.col("__first").alias("__row"))
    joined = marked.drop("__dup").join(first, F.col(ROW) == F.col("__row"), "left")
    return joined.select(*[F.col(geo.quote(c)) for c in df.columns], F.col("__row").isNotNull().alias("__matched"))


def merge(df: DataFrame, source: DataFrame) -> DataFrame:
    """Rows of both, matched by column name. Columns of different types become text where one
    of them is text, and the row keys of the two tables are kept apart."""
    by_name = {f.name.lower(): f for f in df.schema.fields}
    other = {f.name.lower(): f for f in source.schema.fields}

    def aligned(frame: DataFrame, own: dict, theirs: dict, names: dict, tag: int) -> DataFrame:
        cols = []
        for f in frame.schema.fields:
            c = F.col(geo.quote(f.name))
            if f.name == ROW:
                c = F.concat(F.array(F.lit(tag).cast("bigint")), c)
            twin = theirs.get(f.name.lower())
            if twin is not None and twin.dataType != f.dataType and T.StringType() in (twin.dataType, f.dataType):
                c = c.cast("string")
            cols.append(c.alias(names.get(f.name.lower(), f.name)))
        return frame.select(*cols)

    names = {k: f.name for k, f in by_name.items()}
    return aligned(df, by_name, other, names, 0).unionByName(
        aligned(source, other, by_name, names, 1), allowMissingColumns=True)


def explode(df: DataFrame, part_field: str | None = None) -> DataFrame:
    """One row per part; no geometry or an empty one stays one row, part 1."""
    hidden = {"geom", ROW} | ({part_field.lower()} if part_field else set())
    kept = [F.col(geo.quote(c)) for c in df.columns if c.lower() not in hidden]
    split = df.select(*kept, F.col(ROW).alias("__row"), F.col("geom").alias("__whole"), F.posexplode_outer("geom.parts").alias("__pos", "__part"))
    number = F.coalesce(F.col("__pos"), F.lit(0)) + 1
    single = f"CASE WHEN __part IS NULL THEN __whole ELSE {geo.from_parts('array(__part)')} END"
    numbered = [number.alias(part_field)] if part_field else []
    return split.select(*kept, F.expr(single).alias("geom"), *numbered, F.concat("__row", F.array(number.cast("bigint"))).alias(ROW))


def make_points(df: DataFrame, x: str, y: str, source_crs: str = "EPSG:4326", working_crs: str = "EPSG:4326") -> DataFrame:
    """Point geometry from two expressions; `__matched` where both are numbers."""
    pair = df.withColumn("__x", F.expr(f"try_cast(({x}) AS DOUBLE)")).withColumn("__y", F.expr(f"try_cast(({y}) AS DOUBLE)"))
    moved = crs_functions.transform_xy("__x", "__y", source_crs, working_crs)
    p = geo.var("p")
    made = f"transform(array({moved}), {p} -> {geo.point(p + '.x', p + '.y')})[0]"
    geom = f"CASE WHEN __x IS NOT NULL AND __y IS NOT NULL THEN {made} END"
    kept = [F.col(geo.quote(c)) for c in df.columns if c != "geom"]
    return pair.select(*kept, F.expr(geom).alias("geom"), F.expr("__x IS NOT NULL AND __y IS NOT NULL").alias("__matched"))


# Rows that a range of `seq` aims at.
ROWS_PER_RANGE = 1_000_000


def seq(df: DataFrame, name: str) -> DataFrame:
    """Rows numbered 1…n in row order: they are sorted in ranges of the order, as many as the
    rows need, numbered where they lie, and moved up by what lies before their range. One
    shuffle; no task holds more than a range."""
    from .grid import stored

    rows = stored(df)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // ROWS_PER_RANGE)
    ranges = rows.repartitionByRange(parts, ROW).sortWithinPartitions(ROW)
    # the lower 33 bits of such an id are the row's number in its partition
    placed = stored(ranges.withColumn("__pid", F.spark_partition_id()).withColumn("__own", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1))
    counts = placed.groupBy("__pid").agg(F.max("__own").alias("__n"))  # a row per range
    earlier = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(offsets), "__pid").withColumn(name, F.col("__before") + F.col("__own")).drop("__pid", "__own", "__before")
