"""The joins: by geometry, by attribute, and to the nearest feature.

Each returns the running rows with the pulled fields and a boolean `__matched`. Spatial
matches are found between distinct geometries and then joined back to the rows by geometry
id, so a third of all rows sharing one point costs that point once."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from . import strips
from .aggregates import Aggregate, aggregate_column
from .grid import geometry_id, grown, meeting, overlapping_pairs, shapes, stored
from .nearest import CellTree, candidates

ROW = "__src_row"


def _distinct_sources(source: DataFrame, fields: dict[str, str]) -> DataFrame:
    """One row per distinct source geometry: the first source row having it, as `best`."""
    pulled = [F.col(col).alias(out) for out, col in fields.items()]
    return stored(
        source.filter("size(geom.parts) > 0")
        .select(geometry_id(F.col("geom")).alias("id"), "geom", F.struct(ROW, *pulled).alias("best"))
        .groupBy("id").agg(F.min_by("best", F.col(f"best.{ROW}")).alias("best"), F.first("geom").alias("geom"))
        .select("id", F.expr(geo.bbox("geom")).alias("box"), F.expr(geo.segments("geom")).alias("segs"), "best")
    )


def _matching(left: DataFrame, source_shapes: DataFrame, predicate: str) -> DataFrame:
    """Pairs (`l` a base shape, `r` a source shape) satisfying the predicate. Points and detailed
    polygons are matched by strips; their pairs come without `segs`, as they share no area."""
    sides = [df.withColumn("sort", F.expr(strips.sort_of_shape())) for df in (left, source_shapes)]
    l_sorts, r_sorts = (df.agg(F.collect_set("sort")).first()[0] for df in sides)

    def of(side: int, sorts) -> DataFrame:
        return sides[side].filter(F.col("sort").isin(list(sorts))).drop("sort")

    found = []
    by_strips = {strips.POINT: strips.DETAILED, strips.DETAILED: strips.POINT}
    plain = []  # sorts of the base's shapes, each with those it is matched with in the row
    for sort in sorted(l_sorts):
        other = by_strips.get(sort)
        if other not in r_sorts:
            plain.append((sort, frozenset(r_sorts)))
            continue
        plain.append((sort, frozenset(r_sorts) - {other}))
        pairs = strips.located(*(of(0, [sort]), of(1, [other])) if sort == strips.POINT else (of(1, [other]), of(0, [sort])))
        # a point can't contain a polygon, and one on its edge isn't within it
        inner = {"within": strips.POINT, "contains": strips.DETAILED}.get(predicate)
        if inner is None or sort == inner:
            kept = pairs if inner is None else pairs.filter("at = 1")
            l, r = ("l", "r") if sort == strips.POINT else ("r", "l")
            found.append(kept.select(_without_segs(l, left).alias("l"), _without_segs(r, source_shapes).alias("r")))
    for partners in sorted({p for _, p in plain if p}, key=sorted):
        pairs = overlapping_pairs(of(0, [s for s, p in plain if p == partners]), of(1, partners))
        found.append(pairs.filter(F.expr(geo.PREDICATES[predicate]("l.segs", "r.segs"))))
    if not found:
        found = [overlapping_pairs(left.limit(0), source_shapes.limit(0))]
    return reduce(DataFrame.unionAll, found)


def _source_pairs(base: DataFrame, source: DataFrame, fields: dict[str, str], predicate: str) -> DataFrame:
    """The matching pairs, the source's shapes with the first row having them."""
    left = shapes(base).drop("geom")
    return _matching(left, _distinct_sources(meeting(source, left), fields), predicate)


def _without_segs(name: str, like: DataFrame) -> Column:
    """The struct `name` with the columns of `like`, null in place of `segs`."""
    return F.struct(*[
        F.lit(None).cast(like.schema[c].dataType).alias(c) if c == "segs" else F.col(f"{name}.{c}") for c in like.columns
    ])


def _with_matches(base: DataFrame, matches: DataFrame, outs: list[Column]) -> DataFrame:
    """Base rows left-joined to one match per geometry (`id`, …), as `__matched` and `outs`."""
    keyed = base.withColumn("__gid", geometry_id(F.col("geom")))
    joined = keyed.join(matches.withColumnRenamed("id", "__mid"), F.col("__gid") == F.col("__mid"), "left")
    return joined.select(
        *[F.col(geo.quote(c)) for c in base.columns], *outs, F.col("__mid").isNotNull().alias("__matched"),
    )


def free_names(base: DataFrame, names) -> dict[str, str]:
    """Output names for pulled columns: `x_1` where the rows already have an `x`."""
    taken = {c.lower() for c in base.columns}
    result = {}
    for name in names:
        free, n = name, 0
        while free.lower() in taken:
            n += 1
            free = f"{name}_{n}"
        taken.add(free.lower())
        result[name] = free
    return result


def spatial_join(
    base: DataFrame, source: DataFrame, fields: dict, predicate: str = "intersects",
    match: str = "first", on_multiple: str = "first",
) -> DataFrame:
    if match == "all":
        return _join_all(base, source, fields, predicate)
    if match == "summarize":
        return _join_summarize(base, source, fields, predicate)
    names = free_names(base, fields)
    if on_multiple == "largest_overlap":
        best = _largest_overlap(base, source, fields, predicate)
    else:
        pairs = _source_pairs(base, source, fields, predicate)
        best = pairs.groupBy(F.col("l.id").alias("id")).agg(F.min_by("r.best", F.col(f"r.best.{ROW}")).alias("best"))
    return _with_matches(base, best, [F.col("best").getField(o).alias(names[o]) for o in fields])


def _largest_overlap(base: DataFrame, source: DataFrame, fields: dict, predicate: str) -> DataFrame:
    from .overlay import pair_areas, spread

    pairs = stored(
        _source_pairs(base, source, fields, predicate)
        .select(F.col("l.id").alias("id"), F.col("r.id").alias("rid"), "r.best", F.col("l.segs").alias("a"), F.col("r.segs").alias("b"))
        .withColumn("k", F.struct("id", "rid"))
    )
    areas = pair_areas(spread(pairs.filter("a IS NOT NULL").select("k", "a", "b"), pairs.count()))
    sized = pairs.select("k", "id", "best").join(areas, "k", "left")
    rank = F.struct(-F.coalesce(F.col("area"), F.lit(0.0)), F.col(f"best.{ROW}"))
    return sized.groupBy("id").agg(F.min_by("best", rank).alias("best"))


def _shape_pairs(base: DataFrame, source: DataFrame, predicate: str) -> DataFrame:
    left = shapes(base).drop("geom")
    return _matching(left, shapes(meeting(source, left)).drop("geom"), predicate).select(
        F.col("l.id").alias("__gid"), F.col("r.id").alias("__sid"),
    )


def _join_all(base: DataFrame, source: DataFrame, fields: dict, predicate: str) -> DataFrame:
    names = free_names(base, fields)
    pairs = _shape_pairs(base, source, predicate)
    pulled = [F.col(col).alias(f"__f_{i}") for i, col in enumerate(fields.values())]
    matched = (
        source.filter("size(geom.parts) > 0")
        .select(geometry_id(F.col("geom")).alias("__sid"), F.col(ROW).alias("__b_row"), *pulled)
        .join(pairs, "__sid").drop("__sid")
    )
    keyed = base.withColumn("__gid", geometry_id(F.col("geom"))).join(matched, "__gid", "left")
    row = F.when(F.col("__b_row").isNotNull(), F.concat(ROW, "__b_row")).otherwise(F.col(ROW))
    return keyed.select(
        *[row.alias(ROW) if c == ROW else F.col(geo.quote(c)) for c in base.columns],
        *[F.col(f"__f_{i}").alias(names[out]) for i, out in enumerate(fields)],
        F.col("__b_row").isNotNull().alias("__matched"),
    )


def _join_summarize(base: DataFrame, source: DataFrame, fields: dict[str, Aggregate], predicate: str) -> DataFrame:
    pairs = _shape_pairs(base, source, predicate)
    rows = source.filter("size(geom.parts) > 0").withColumn("__sid", geometry_id(F.col("geom"))).join(pairs, "__sid")
    return _with_matches(base, *_summaries(base, rows, "__gid", fields))


def _summaries(base: DataFrame, rows: DataFrame, key: str, fields: dict[str, Aggregate]):
    """Aggregates per matched key, and the output columns over them (a count of none is 0)."""
    names = free_names(base, fields)
    aggs = [aggregate_column(agg).alias(f"__f_{i}") for i, agg in enumerate(fields.values())]
    grouped = rows.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("__n"), *aggs).drop("__n")
    outs = [
        (F.coalesce(F.col(f"__f_{i}"), F.lit(0)) if agg.how == "count" else F.col(f"__f_{i}")).alias(names[out])
        for i, (out, agg) in enumerate(fields.items())
    ]
    return grouped, outs


def attribute_join(
    base: DataFrame, source: DataFrame, left: str, right: str, fields: dict, match: str = "first",
) -> DataFrame:
    """`left` is SQL over the running row, `right` a source column; the first source row (in
    row order) or aggregates over all of them."""
    keyed = base.withColumn("__key", F.expr(left))
    matchable = source.filter(F.col(geo.quote(right)).isNotNull())
    if match == "summarize":
        found, outs = _summaries(base, matchable, geo.quote(right), fields)
    else:
        names = free_names(base, fields)
        pulled = F.struct(ROW, *[F.col(col).alias(out) for out, col in fields.items()])
        found = matchable.select(F.col(geo.quote(right)).alias("id"), pulled.alias("best")).groupBy("id").agg(
            F.min_by("best", F.col(f"best.{ROW}")).alias("best"),
        )
        outs = [F.col("best").getField(o).alias(names[o]) for o in fields]
    joined = keyed.join(found.withColumnRenamed("id", "__mid"), F.col("__key") == F.col("__mid"), "left")
    return joined.select(
        *[F.col(geo.quote(c)) for c in base.columns], *outs, F.col("__mid").isNotNull().alias("__matched"),
    )


# ---- nearest ----------------------------------------------------------------

def nearest_neighbor(
    base: DataFrame, source: DataFrame, fields: dict[str, str],
    max_distance: float | None = None, distance_field: str | None = None,
) -> DataFrame:
    names = free_names(base, [*fields, *([distance_field] if distance_field else [])])
    best = nearest_shapes(shapes(base).drop("geom"), _distinct_sources(source, fields), max_distance)
    outs = [F.col("best").getField(o).alias(names[o]) for o in fields]
    if distance_field:
        outs.append(F.col("dist").alias(names[distance_field]))
    return _with_matches(base, best, outs)


def nearest_shapes(left: DataFrame, right: DataFrame, max_distance: float | None = None) -> DataFrame:
    """(`id`, `best`, `dist`): for each left shape its closest right shape, ties to the lower
    row."""
    tree = CellTree(right)
    if tree.members is None:
        return left.sparkSession.createDataFrame([], left.select("id").schema).select(
            "id", F.lit(None).cast(right.schema["best"].dataType).alias("best"), F.lit(None).cast("double").alias("dist"),
        )
    near = candidates(left, tree, max_distance)
    shapes_of = right.select(F.col("id").alias("rid"), F.col("segs").alias("b"), "best")
    measured = near.join(left.select("id", F.col("segs").alias("a")), "id").join(shapes_of, "rid").select(
        "id", "best", F.expr(geo.distance("a", "b")).alias("dist"),
    )
    if max_distance is not None:
        measured = measured.filter(F.col("dist") <= float(max_distance))
    ranked = F.struct("dist", F.col(f"best.{ROW}").alias("row"))
    return measured.groupBy("id").agg(F.min_by(F.struct("best", "dist"), ranked).alias("m")).select("id", "m.best", "m.dist")


def within_distance(base: DataFrame, source: DataFrame, radius: float) -> DataFrame:
    """Pairs of distinct shapes (`l`, `r`) no farther apart than `radius`."""
    left = shapes(base).drop("geom").withColumn("box", F.expr(grown("box", f"{float(radius)!r}D")))
    pairs = overlapping_pairs(left, shapes(source).drop("geom"))
    return pairs.filter(F.expr(f"{geo.distance('l.segs', 'r.segs')} <= {float(radius)!r}D"))
