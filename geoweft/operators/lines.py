"""Steps on lines: splitting, overlaying and chaining them, and simplifying shapes."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import kernels, noding
from ..functions.noding import TOUCH
from ..functions.text import let
from ..functions.wkb import PART_ARROW
from .aggregates import Aggregate, aggregate_column
from .chains import broken_cycles, ranked
from .grid import geometry_id, grown, overlapping_pairs, shapes, stored
from .joins import ROW, free_names

# ---- fixed values: how close counts as meeting, and as running along (cosine) ----
EXACT = 1e-6
MIN_ALIGNMENT = 0.95
# ----------------------------------------------------------------------------------

SEG_BOX = (
    "named_struct('xmin', least(e.x1, e.x2), 'ymin', least(e.y1, e.y2), "
    "'xmax', greatest(e.x1, e.x2), 'ymax', greatest(e.y1, e.y2))"
)


def _line_parts(rows: DataFrame) -> DataFrame:
    """One row per line part: `lid` (row key and part number), `ring`."""
    return rows.filter(F.expr(geo.is_line("geom"))).select(
        F.col(ROW), F.posexplode("geom.parts").alias("pno", "part"),
    ).select(ROW, F.concat(ROW, F.array(F.col("pno").cast("bigint"))).alias("lid"), F.expr("part.rings[0]").alias("ring"))


def _line_copies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Line parts as references (`part_row`, `lid`) and the distinct lines they refer to
    (`lid`, `ring`): copies of a line are cut once. Leaving a line's copies out of what cuts
    it changes nothing, as they meet along its whole length."""
    parts = stored(_line_parts(rows).select(ROW, F.col("lid").alias("part_row"), geometry_id(F.col("ring")).alias("lid"), "ring"))
    return parts.select(ROW, "part_row", "lid"), stored(parts.select("lid", "ring").distinct())


def _line_segments(parts: DataFrame) -> DataFrame:
    """Segments of line parts with where they start along their line: `lid`, `e`, `run`, `size`."""
    segs = parts.select("lid", F.posexplode(F.expr(geo.ring_segments("ring", "1"))).alias("pos", "e")).withColumn(
        "size", F.expr("sqrt(pow(e.x2 - e.x1, 2) + pow(e.y2 - e.y1, 2))"),
    )
    return stored(
        segs.withColumn("run", F.expr("sum(size) OVER (PARTITION BY lid ORDER BY pos) - size"))
        .withColumn("box", F.expr(SEG_BOX))
    )


def _contact(s: str, e: str) -> str:
    """The stretch of segment `s` that segment `e` meets, as STRUCT<lo, hi> fractions of it
    (lo = hi for a point), or NULL."""
    dx, dy = f"({s}.x2 - {s}.x1)", f"({s}.y2 - {s}.y1)"
    size2 = f"({dx} * {dx} + {dy} * {dy})"
    t = lambda i: f"try_divide(({e}.x{i} - {s}.x1) * {dx} + ({e}.y{i} - {s}.y1) * {dy}, {size2})"
    on_line = lambda i: f"pow({geo._edge_cross(s, f'{e}.x{i}', f'{e}.y{i}')}, 2) <= {TOUCH * TOUCH!r}D * {size2}"
    den = f"({dx} * ({e}.y2 - {e}.y1) - {dy} * ({e}.x2 - {e}.x1))"
    cross_at = (
        f"try_divide(({e}.x1 - {s}.x1) * ({e}.y2 - {e}.y1) - ({e}.y1 - {s}.y1) * ({e}.x2 - {e}.x1), {den})"
    )
    v = geo.var("v")
    eps = f"try_divide({TOUCH!r}D, sqrt({size2}))"
    span = lambda lo, hi: f"named_struct('lo', {lo}, 'hi', {hi})"
    touch = lambda i: (
        f"WHEN {on_line(i)} AND {t(i)} BETWEEN -{eps} AND 1 + {eps} THEN {span(f'greatest(0D, least(1D, {t(i)}))', f'greatest(0D, least(1D, {t(i)}))')}"
    )
    # an end of s on e: near e's line and within its length
    esize2 = f"(pow({e}.x2 - {e}.x1, 2) + pow({e}.y2 - {e}.y1, 2))"
    own = lambda i, at: (
        f"WHEN pow({geo._edge_cross(e, f'{s}.x{i}', f'{s}.y{i}')}, 2) <= {TOUCH * TOUCH!r}D * {esize2} AND "
        f"{geo.point_segment_distance2(f'{s}.x{i}', f'{s}.y{i}', e)} <= {TOUCH * TOUCH!r}D THEN {span(at, at)}"
    )
    return (
        f"CASE WHEN {on_line(1)} AND {on_line(2)} AND least(1D, greatest({t(1)}, {t(2)})) > greatest(0D, least({t(1)}, {t(2)})) "
        f"THEN {span(f'greatest(0D, least({t(1)}, {t(2)}))', f'least(1D, greatest({t(1)}, {t(2)}))')} "
        f"{touch(1)} {touch(2)} {own(1, '0D')} {own(2, '1D')} "
        f"WHEN {geo.segments_cross(s, e)} THEN {let(cross_at, lambda v: span(v, v))} END"
    )


def _islands(spans: DataFrame, by: list[str], gap: float) -> DataFrame:
    """Spans (`by`, `lo`, `hi`, …) with `island` numbering the runs that touch or overlap."""
    part = f"PARTITION BY {', '.join(by)} ORDER BY lo, hi"
    return (
        spans.withColumn("reach", F.expr(f"max(hi) OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
        .withColumn("island", F.expr(f"sum(CASE WHEN reach IS NULL OR lo > reach + {gap!r}D THEN 1 ELSE 0 END) OVER ({part})"))
    )


def _pieces(marks: DataFrame, lines: DataFrame, tolerance: float) -> DataFrame:
    """Lines cut at `marks` (`lid`, `at` along the line): (`lid`, `lo`, `hi`) in length units.
    Marks within the tolerance of the one before, or of the line's far end, are no cuts."""
    ends = lines.select("lid", F.expr("inline(array(named_struct('at', 0D), named_struct('at', total)))"))
    every = marks.select("lid", "at").unionByName(ends).distinct().join(lines.select("lid", "total"), "lid")
    kept = (
        every.withColumn("prev", F.expr("lag(at) OVER (PARTITION BY lid ORDER BY at)"))
        .filter(f"at = 0 OR at = total OR (at - prev > {tolerance!r}D AND at < total - {tolerance!r}D)")
    )
    return (
        kept.withColumn("hi", F.expr("lead(at) OVER (PARTITION BY lid ORDER BY at)"))
        .filter("hi > at").select("lid", F.col("at").alias("lo"), "hi")
    )


def _totals(segs: DataFrame) -> DataFrame:
    return segs.groupBy("lid").agg(F.max(F.expr("run + size")).alias("total"))


def _stretch(ring: str) -> str:
    """The line between `lo` and `hi` (length units) of `total`."""
    whole = "lo <= 0 AND hi >= total"
    return geo.line(f"CASE WHEN {whole} THEN {ring} ELSE {geo.substring(ring, 'lo / total', 'hi / total')} END")


def _with_pieces(
    df: DataFrame, parts: DataFrame, distinct: DataFrame, totals: DataFrame, pieces: DataFrame, extra: list[str] = [],
) -> DataFrame:
    """The rows of `df` with each line part replaced by its pieces; other rows as they are."""
    numbered = pieces.withColumn("n", F.expr("row_number() OVER (PARTITION BY lid ORDER BY lo)").cast("bigint"))
    shaped = stored(
        distinct.join(totals, "lid").join(numbered, "lid").select("lid", "n", F.expr(_stretch("ring")).alias("__geom"), *extra)
    )
    cut = parts.withColumnRenamed(ROW, "__row").join(shaped, "lid").withColumn("__new_row", F.concat("part_row", F.array("n"))).drop("lid", "part_row", "n")
    lines = df.join(cut, F.col(ROW) == F.col("__row")).drop("__row", ROW, "geom").withColumnsRenamed(
        {"__new_row": ROW, "__geom": "geom"})
    # a line of no length has no pieces, and passes through as what isn't a line does
    rest = df.filter(f"geom IS NULL OR NOT {geo.is_line('geom')} OR coalesce({geo.length('geom')}, 0D) = 0")
    return lines.unionByName(rest, allowMissingColumns=True).select(*df.columns, *extra)


def split_lines(df: DataFrame, source: DataFrame | None = None, tolerance: float | None = None) -> DataFrame:
    df = stored(df)
    parts, distinct = _line_copies(df)
    segs = _line_segments(distinct)
    totals = stored(_totals(segs).filter("total > 0"))
    if source is None:
        cutters = segs.select(F.col("lid").alias("oid"), "e", "box")
    else:
        cutters = stored(
            shapes(source).select(F.col("id").alias("oid"), F.explode("segs").alias("e")).withColumn("box", F.expr(SEG_BOX))
        )
    near = segs.withColumn("box", F.expr(grown("box", f"{TOUCH!r}D")))
    met = overlapping_pairs(near, cutters)
    if source is None:
        met = met.filter("l.lid <> r.oid")
    spans = met.select("l.lid", "r.oid", "l.run", "l.size", F.expr(_contact("l.e", "r.e")).alias("c")).filter("c IS NOT NULL").select(
        "lid", "oid", F.expr("run + c.lo * size").alias("lo"), F.expr("run + c.hi * size").alias("hi"),
    )
    # a stretch shared with another line counts at its two ends only
    merged = _islands(spans, ["lid", "oid"], EXACT).groupBy("lid", "oid", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    marks = merged.select("lid", F.explode(F.array("lo", "hi")).alias("at"))
    if tolerance is not None:
        marks = marks.unionByName(_near_ends(segs, distinct if source is None else source, source is None, tolerance))
    pieces = _pieces(marks, totals, tolerance if tolerance is not None else EXACT)
    return _with_pieces(df, parts, distinct, totals, pieces)


def _near_ends(segs: DataFrame, cutters: DataFrame, own: bool, tolerance: float) -> DataFrame:
    """Where lines pass within the tolerance of another line's end: (`lid`, `at`)."""
    if own:
        lines = cutters.select(F.col("lid").alias("oid"), "ring")
    else:
        lines = cutters.select(F.col(ROW).alias("oid"), F.explode("geom.parts").alias("p")).filter("p.dim = 1").select(
            "oid", F.expr("p.rings[0]").alias("ring"))
    tips = stored(
        lines.select("oid", F.explode(F.expr("array(ring[0], element_at(ring, -1))")).alias("v"))
        .select("oid", F.expr("v.x").alias("x"), F.expr("v.y").alias("y")).distinct()
        .withColumn("box", F.expr("named_struct('xmin', x, 'ymin', y, 'xmax', x, 'ymax', y)"))
    )
    wide = segs.withColumn("box", F.expr(grown("box", f"{tolerance!r}D")))
    close = overlapping_pairs(wide, tips)
    if own:
        close = close.filter("l.lid <> r.oid")
    d2 = geo.point_segment_distance2("r.x", "r.y", "l.e")
    t = "greatest(0D, least(1D, coalesce(try_divide((r.x - l.e.x1) * (l.e.x2 - l.e.x1) + (r.y - l.e.y1) * (l.e.y2 - l.e.y1), l.size * l.size), 0D)))"
    return close.withColumn("d2", F.expr(d2)).filter(f"d2 <= {tolerance * tolerance!r}D").groupBy(
        F.col("l.lid").alias("lid"), "r.x", "r.y",
    ).agg(F.min_by(F.expr(f"l.run + {t} * l.size"), F.struct("d2", "l.run")).alias("at")).select("lid", "at")


def line_overlay(df: DataFrame, source: DataFrame, fields: dict[str, str], tolerance: float | None = None) -> DataFrame:
    tol = tolerance if tolerance is not None else EXACT
    df = stored(df)
    names = free_names(df, fields)
    parts, distinct = _line_copies(df)
    segs = _line_segments(distinct)
    totals = stored(_totals(segs).filter("total > 0"))
    guides = stored(
        source.filter("size(geom.parts) > 0").select(geometry_id(F.col("geom")).alias("g"), "geom", ROW)
        .groupBy("g").agg(F.min(ROW).alias("b_row"), F.first("geom").alias("geom"))  # of copies, the first row counts
        .select("b_row", F.explode(F.expr(geo.segments("geom"))).alias("e")).withColumn("box", F.expr(SEG_BOX))
    )
    wide = segs.withColumn("box", F.expr(grown("box", f"{tol!r}D")))
    along = (
        overlapping_pairs(wide, guides).withColumn("c", F.expr(_beside("l.e", "r.e", tol))).filter("c IS NOT NULL")
        .select("l.lid", "r.b_row", F.expr("l.run + c.lo * l.size").alias("lo"), F.expr("l.run + c.hi * l.size").alias("hi"),
                "c.a0", "c.a1", "c.b0", "c.b1")
    )
    runs = _islands(along, ["lid", "b_row"], 2 * tol).groupBy("lid", "b_row", "island").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min_by(F.struct("a0", "b0"), "lo").alias("s"),
        F.max_by(F.struct("a1", "b1"), "hi").alias("t"),
    )
    gap = lambda p, q: f"sqrt(pow({p}.x - {q}.x, 2) + pow({p}.y - {q}.y, 2))"
    spans = stored(
        runs.filter(F.expr(f"hi > lo AND {gap('s.b0', 't.b1')} >= {MIN_ALIGNMENT} * {gap('s.a0', 't.a1')}"))
        .select("lid", "b_row", "lo", "hi")
        .withColumn("box", F.expr("named_struct('xmin', lo, 'ymin', 0D, 'xmax', hi, 'ymax', 0D)"))
    )
    marks = spans.select("lid", F.explode(F.array("lo", "hi")).alias("at"))
    pieces = stored(_pieces(marks, totals, tol).withColumn("mid", F.expr("(lo + hi) / 2")).withColumn(
        "box", F.expr("named_struct('xmin', mid, 'ymin', 0D, 'xmax', mid, 'ymax', 0D)")))
    # the first source line covering each piece's middle
    owner = overlapping_pairs(pieces, spans, on=["lid"]).groupBy("l.lid", "l.lo").agg(F.min("r.b_row").alias("b_row"))
    owned = pieces.select("lid", "lo", "hi").join(owner, ["lid", "lo"], "left")
    joined = (
        owned.withColumn("same", F.expr("b_row <=> lag(b_row) OVER (PARTITION BY lid ORDER BY lo) AND row_number() OVER (PARTITION BY lid ORDER BY lo) > 1"))
        .withColumn("run", F.expr("sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY lid ORDER BY lo)"))
        .groupBy("lid", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("b_row").alias("b_row")).drop("run")
    )
    pulled = source.select(F.col(ROW).alias("b_row"), *[F.col(c).alias(f"__f_{i}") for i, c in enumerate(fields.values())])
    extra = [f"__f_{i}" for i in range(len(fields))]
    result = _with_pieces(df, parts, distinct, totals, joined.join(pulled, "b_row", "left").drop("b_row"), extra)
    return result.withColumnsRenamed({f"__f_{i}": names[out] for i, out in enumerate(fields)})


def _beside(s: str, e: str, tol: float) -> str:
    """The stretch of segment `s` within `tol` of segment `e` and beside it: fractions `lo`,
    `hi`, its end points (`a0`, `a1`) and their closest points on `e` (`b0`, `b1`); or NULL."""
    n = geo.var("n")
    ex, ey = f"({e}.x2 - {e}.x1)", f"({e}.y2 - {e}.y1)"
    size = f"sqrt({ex} * {ex} + {ey} * {ey})"
    off = lambda i: f"(({ex} * ({s}.y{i} - {e}.y1) - ({s}.x{i} - {e}.x1) * {ey}) / {n})"
    run = lambda i: f"((({s}.x{i} - {e}.x1) * {ex} + ({s}.y{i} - {e}.y1) * {ey}) / {n})"

    def between(f0: str, f1: str, low: str, high: str) -> tuple[str, str]:
        """Fractions where a value going from f0 to f1 is between low and high."""
        at = lambda bound: f"(({bound} - {f0}) / ({f1} - {f0}))"
        flat = f"abs({f1} - {f0}) < 1e-300"
        inside = f"({f0} BETWEEN {low} AND {high})"
        lo = f"CASE WHEN {flat} THEN CASE WHEN {inside} THEN 0D ELSE 2D END ELSE least({at(low)}, {at(high)}) END"
        hi = f"CASE WHEN {flat} THEN CASE WHEN {inside} THEN 1D ELSE -1D END ELSE greatest({at(low)}, {at(high)}) END"
        return lo, hi

    def body(o0, o1, r0, r1):
        lo1, hi1 = between(o0, o1, f"-{tol!r}D", f"{tol!r}D")
        lo2, hi2 = between(r0, r1, "0D", n)
        spot = lambda f: f"named_struct('x', {s}.x1 + {f} * ({s}.x2 - {s}.x1), 'y', {s}.y1 + {f} * ({s}.y2 - {s}.y1))"
        foot = lambda f: (
            f"named_struct('x', {e}.x1 + {ex} * ({r0} + {f} * ({r1} - {r0})) / {n}, 'y', {e}.y1 + {ey} * ({r0} + {f} * ({r1} - {r0})) / {n})"
        )
        return let(f"greatest(0D, {lo1}, {lo2})", lambda lo: let(f"least(1D, {hi1}, {hi2})", lambda hi: (
            f"CASE WHEN {hi} >= {lo} THEN named_struct('lo', {lo}, 'hi', {hi}, 'a0', {spot(lo)}, 'a1', {spot(hi)}, "
            f"'b0', {foot(lo)}, 'b1', {foot(hi)}) END"
        )))

    inner = let(off(1), lambda o0: let(off(2), lambda o1: let(run(1), lambda r0: let(run(2), lambda r1: body(o0, o1, r0, r1)))))
    return f"transform(array({size}), {n} -> CASE WHEN {n} > 0 THEN {inner} END)[0]"


# ---- chains -----------------------------------------------------------------

def combine_lines(
    df: DataFrame, by: list, aggregates: list[Aggregate], preserve_direction: bool = True,
) -> DataFrame:
    from .polygons import group_keys

    names, cols = group_keys(by)
    key_ids = [f"__k{i}" for i in range(len(names))]
    keyed = stored(
        df.select("*", *[c.alias(i) for c, i in zip(cols, key_ids)])
        .withColumn("__k", F.struct(*key_ids) if key_ids else F.struct(F.lit(0).alias("one")))
    )
    parts = stored(
        _line_parts(keyed.select(ROW, "geom")).join(keyed.select(ROW, "__k"), ROW)
        .withColumn("s", F.expr("struct(ring[0].x, ring[0].y)")).withColumn("t", F.expr("struct(element_at(ring, -1).x, element_at(ring, -1).y)"))
    )
    order = _chain_order(parts, preserve_direction)
    member = parts.join(order, "lid")
    ring = F.expr("CASE WHEN back THEN reverse(ring) ELSE ring END")
    chain = member.withColumn("ring", ring).groupBy("tail").agg(
        F.first("__k").alias("__k"), F.min("lid").alias("__row"),
        F.expr("array_sort(collect_list(named_struct('r', -rank, 'ring', ring)))").alias("rings"),
    ).select("tail", "__k", "__row", F.expr(geo.line(
        "concat(rings[0].ring, flatten(transform(slice(rings, 2, size(rings)), m -> slice(m.ring, 2, size(m.ring)))))"
    )).alias("__line"))
    aggs = [aggregate_column(a).alias(f"__a{i}") for i, a in enumerate(aggregates)]
    members = member.select("tail", F.col(ROW)).distinct()
    outs = [F.col(f"__k.{i}").alias(n) for i, n in zip(key_ids, names)]
    tails = [F.col(f"__a{i}").alias(a.to) for i, a in enumerate(aggregates)]
    summed = keyed.drop("__k").join(members, ROW).groupBy("tail").agg(F.count(F.lit(1)).alias("__n"), *aggs)
    lines = chain.join(summed, "tail").select(*outs, F.col("__line").alias("geom"), *tails, F.concat(F.array(F.lit(0).cast("bigint")), "__row").alias(ROW))
    others = keyed.filter(f"geom IS NULL OR NOT {geo.is_line('geom')} OR size(geom.parts) = 0")
    own = others.groupBy(F.col(ROW).alias("__row")).agg(F.first("__k").alias("__k"), F.first("geom").alias("__geom"), *aggs)
    rest = own.select(*outs, F.col("__geom").alias("geom"), *tails, F.concat(F.array(F.lit(1).cast("bigint")), "__row").alias(ROW))
    return lines.unionByName(rest)


def _chain_order(parts: DataFrame, directed: bool) -> DataFrame:
    """(`lid`, `tail`, `rank`, `back`): each line part's chain, its place before the chain's end
    and whether it runs backwards in it."""
    ends = parts.select("__k", "lid", F.col("s").alias("node"), F.lit(1).alias("leaves")).unionByName(
        parts.select("__k", "lid", F.col("t").alias("node"), F.lit(0).alias("leaves")))
    degree = ends.groupBy("__k", "node").agg(F.count(F.lit(1)).alias("n"), F.sum("leaves").alias("out"))
    joints = degree.filter("n = 2 AND out = 1" if directed else "n = 2").select("__k", "node")
    forward = parts.filter("s <> t").select("__k", F.struct("lid", F.lit(False).alias("back")).alias("id"), "s", "t")
    half = forward
    if not directed:
        half = forward.unionByName(parts.filter("s <> t").select(
            "__k", F.struct("lid", F.lit(True).alias("back")).alias("id"), F.col("t").alias("s"), F.col("s").alias("t")))
    half = stored(half)
    arriving = half.select("__k", "id", F.col("t").alias("node")).join(joints, ["__k", "node"])
    leaving = half.select("__k", F.col("id").alias("next"), F.col("s").alias("node"))
    steps = arriving.join(leaving, ["__k", "node"]).filter("id.lid <> next.lid").select("id", "next")
    links = stored(half.select("id").join(steps, "id", "left"))
    order = stored(ranked(broken_cycles(links)))
    if not directed:
        # every chain comes once each way: the one its lowest line runs forward in stays
        ways = order.groupBy("tail").agg(F.min("id").alias("first")).filter("NOT first.back").select("tail")
        low = order.groupBy("tail").agg(F.min("id.lid").alias("lid"), F.min("id").alias("first"))
        ways = low.filter("first.lid = lid AND NOT first.back").select("tail")
        order = order.join(ways, "tail", "left_semi")
    placed = order.select("id.lid", "tail", "rank", "id.back")
    loops = parts.filter("s = t").select(
        "lid", F.struct("lid", F.lit(False).alias("back")).alias("tail"), F.lit(0).cast("bigint").alias("rank"), F.lit(False).alias("back"))
    return placed.unionByName(loops)


def union_line_parts(flat: DataFrame) -> DataFrame:
    """(`k`, `parts`): the lines of each group, every stretch once."""
    from .overlay import _cut_edges, precision_grid

    inverse = precision_grid(flat.select(F.expr(geo.bbox("geom")).alias("box")))
    segs = noding.on_grid_segments(geo.segments("geom"), inverse)
    edges = flat.select("k", F.xxhash64("geom").alias("g"), F.posexplode(F.expr(segs)).alias("pos", "s")).filter("s.d = 1").select(
        "k", F.struct("g", "pos").alias("eid"), F.expr("named_struct('x1', s.x1, 'y1', s.y1, 'x2', s.x2, 'y2', s.y2)").alias("e"))
    pieces = _cut_edges(edges, inverse).withColumn("u", F.expr(
        "CASE WHEN struct(e.x1, e.y1) <= struct(e.x2, e.y2) THEN e ELSE named_struct('x1', e.x2, 'y1', e.y2, 'x2', e.x1, 'y2', e.y1) END"))
    once = pieces.groupBy("k", "u").agg(F.min(F.struct("eid", "seq", "e")).alias("m"))
    return once.groupBy("k").agg(F.array_sort(F.collect_list("m")).alias("ms")).select(
        "k", F.expr(noding.runs("transform(ms, m -> m.e)")).alias("parts"))


# ---- simplify ---------------------------------------------------------------

def simplify(df: DataFrame, tolerance: float, shared_boundaries: bool = False, keep_outer_boundary: bool = False) -> DataFrame:
    tol = float(tolerance)

    @F.arrow_udf(f"ARRAY<{geo.PART}>")
    def thinned(parts: pa.Array, _same: pa.Array) -> pa.Array:
        done = [None if ps is None else [kernels.simplify_part(p, tol) for p in ps] for ps in parts.to_pylist()]
        return pa.array(done, pa.list_(PART_ARROW))

    thinned = thinned.asNondeterministic()  # computed once, outside other expressions' lambdas

    def one_by_one(rows: DataFrame) -> DataFrame:
        parts = rows.withColumn("__parts", F.col("geom.parts"))
        done = parts.withColumn("__thin", thinned("__parts", "__parts"))
        return done.withColumn("geom", F.expr(f"CASE WHEN geom IS NOT NULL THEN {geo._geometry('geom.kind', '__thin')} END")).select(*rows.columns)

    if not shared_boundaries:
        return one_by_one(df)
    df = stored(df)
    shared = _simplified_coverage(df.filter(F.expr(geo.is_polygon("geom"))).select(ROW, "geom"), tol, keep_outer_boundary)
    # merged: what is stored is far smaller than its rows, and would be broadcast at any size
    polys = df.join(shared.hint("merge"), ROW, "left").filter(F.expr(geo.is_polygon("geom"))).withColumn("geom", F.expr(
        f"CASE WHEN __parts IS NULL THEN geom ELSE {geo._geometry('geom.kind', '__parts')} END"))
    rest = df.filter(f"geom IS NULL OR NOT {geo.is_polygon('geom')}")
    return polys.select(*df.columns).unionByName(one_by_one(rest))


def _simplified_coverage(polys: DataFrame, tol: float, keep_outer: bool) -> DataFrame:
    """(`__src_row`, `__parts`). A vertex is a junction where the rings through it don't all
    come from and go to the same neighbours. Between junctions neighbours share one arc, and
    thinning an arc depends on its vertices alone, so both sides come out the same."""
    rings = polys.select(ROW, F.posexplode("geom.parts").alias("p", "part")).select(
        ROW, "p", F.posexplode("part.rings").alias("q", "ring"))
    corner = (
        "transform(sequence(0, size(ring) - 2), i -> named_struct('i', i, 'x', ring[i].x, 'y', ring[i].y, "
        "'u', struct(ring[CASE WHEN i = 0 THEN size(ring) - 2 ELSE i - 1 END].x, ring[CASE WHEN i = 0 THEN size(ring) - 2 ELSE i - 1 END].y), "
        "'w', struct(ring[i + 1].x, ring[i + 1].y)))"
    )
    corners = stored(rings.select(ROW, "p", "q", F.explode(F.expr(corner)).alias("c")).select(
        ROW, "p", "q", "c.i", "c.x", "c.y", F.expr("struct(least(c.u, c.w) AS a, greatest(c.u, c.w) AS b)").alias("pair")))
    kinds = corners.groupBy("x", "y").agg(
        F.expr("min(pair) <> max(pair)").alias("junction"), F.count(F.lit(1)).alias("rings"))
    marked = corners.drop("pair").join(kinds.hint("merge"), ["x", "y"]).groupBy(ROW, "p", "q").agg(
        F.expr("array_sort(collect_list(named_struct('i', i, 'x', x, 'y', y, 'junction', junction, 'rings', rings)))").alias("v"))

    @F.arrow_udf(geo.RING)
    def thinned(vertices: pa.Array, _same: pa.Array) -> pa.Array:
        return pa.array([kernels.simplify_marked_ring(v, tol, keep_outer) for v in vertices.to_pylist()], pa.list_(kernels.VERTEX))

    done = marked.select(ROW, "p", "q", thinned("v", "v").alias("ring"))
    parts = done.groupBy(ROW, "p").agg(F.expr("transform(array_sort(collect_list(named_struct('q', q, 'r', ring))), c -> c.r)").alias("rings"))
    return parts.groupBy(ROW).agg(F.expr(
        "transform(array_sort(collect_list(named_struct('p', p, 'rings', rings))), c -> named_struct('dim', 2, 'rings', c.rings))").alias("__parts"))
