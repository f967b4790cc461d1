"""Points against detailed polygons, by strips of their outlines.

An outline of many edges is cut across its height or width, whichever way fewer edges lie side
by side, into strips of some edges each. Whether a point is inside, outside or on the edge is
told by the edges that reach its height, so by those of its strip alone: pairs of a point and a
polygon carry ids only, meet the edges of one strip, and no point ever sees the whole outline.
The strips of a polygon lie in different tasks, however many points it holds.

Strips are placed by operations that keep the order of numbers, so an edge is in every strip a
point at its height may have: answers are those of the whole outline, to the bit."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from .grid import overlapping_pairs, stored

# Edges from which a polygon is cut, and those a strip should hold.
DETAILED_EDGES = 256
STRIP_EDGES = 16
# Strips are made wider where edges, all along, would be held more often than this.
MOST_COPIES = 4

POINT, DETAILED, OTHER = "point", "detailed", "other"


def sort_of_shape(segs: str = "segs") -> str:
    """SQL: whether a shape is one point, a polygon (or several) of many edges, or another."""
    e = geo.var("e")
    return (
        f"CASE WHEN size({segs}) = 1 AND {segs}[0].d = 0 THEN '{POINT}' "
        f"WHEN size({segs}) > {DETAILED_EDGES} AND forall({segs}, {e} -> {e}.d = 2) THEN '{DETAILED}' ELSE '{OTHER}' END"
    )


def _placed(v: str) -> str:
    """The strip of a height (in turned shapes: of an x)."""
    return f"CASE WHEN strips > 1 THEN least(strips - 1, CAST(floor(({v} - lowest) / (highest - lowest) * strips) AS INT)) ELSE 0 END"


def _cut(polygons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The polygons without their edges but with what places a point in a strip, and the edges
    of every strip. Both are stored."""
    a, e = geo.var("a"), geo.var("e")

    def way(axis: str) -> str:
        return f"aggregate(segs, 0D, ({a}, {e}) -> {a} + abs({e}.{axis}2 - {e}.{axis}1))"

    flat = polygons.withColumns({"dx": F.expr(way("x")), "dy": F.expr(way("y"))}).withColumn(
        # edges side by side, on average: their way along an axis by the extent
        "turned", F.expr("dx * (box.ymax - box.ymin) < dy * (box.xmax - box.xmin)"),
    ).withColumns({
        "lowest": F.expr("if(turned, box.xmin, box.ymin)"), "highest": F.expr("if(turned, box.xmax, box.ymax)"), "way": F.expr("if(turned, dx, dy)"),
    })
    sized = flat.withColumn("strips", F.expr(
        f"CAST(CASE WHEN highest > lowest THEN greatest(1D, least(size(segs) / {STRIP_EDGES}, "
        f"{MOST_COPIES - 1} * size(segs) * ((highest - lowest) / way))) ELSE 1 END AS INT)"))
    placing = ["turned", "lowest", "highest", "strips"]
    slim = stored(sized.drop("segs", "dx", "dy", "way"))
    edges = sized.select("id", *placing, F.explode("segs").alias("e")).selectExpr(
        "id", *placing,
        "named_struct('x1', if(turned, e.y1, e.x1), 'y1', if(turned, e.x1, e.y1), 'x2', if(turned, e.y2, e.x2), 'y2', if(turned, e.x2, e.y2), 'd', e.d) AS e",
    )
    reach = f"sequence({_placed('least(e.y1, e.y2)')}, {_placed('greatest(e.y1, e.y2)')})"
    parts = edges.select("id", F.explode(F.expr(reach)).alias("strip"), "e").groupBy("id", "strip").agg(F.collect_list("e").alias("edges"))
    return slim, stored(parts)


def located(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Pairs of a point and a detailed polygon that it isn't outside of: structs `l` and `r`
    with their columns but for `segs`, and `at`: 1 inside, 2 on the edge. Both inputs are
    stored and have an id, a box and segs."""
    slim, parts = _cut(polygons)
    pairs = overlapping_pairs(points.drop("segs"), slim).select(
        "l", "r", F.col("r.id").alias("id"), "r.turned", "r.lowest", "r.highest", "r.strips",
        F.expr("if(r.turned, l.box.ymin, l.box.xmin)").alias("px"), F.expr("if(r.turned, l.box.xmin, l.box.ymin)").alias("py"),
    ).withColumn("strip", F.expr(_placed("py"))).select("l", "r", "id", "strip", "px", "py")
    found = pairs.join(parts, ["id", "strip"]).select("l", "r", F.expr(geo.location("edges", "px", "py")).alias("at"))
    own = [F.col(f"r.{c}") for c in polygons.columns if c != "segs"]
    return found.filter("at > 0").select("l", F.struct(*own).alias("r"), "at")
