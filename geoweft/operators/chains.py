"""Putting links in order: lists and cycles by pointer doubling.

Every round joins each still-moving row with the row it points to, doubling its reach, so a
chain of a million links takes twenty joins. Pointers of moving rows are all different, so no
join key is ever hot."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as geo
from ..functions import kernels
from .grid import overlapping_pairs, stored


def broken_cycles(links: DataFrame) -> DataFrame:
    """Links (`id`, `next`, NULL at a list's end) with every cycle opened before its lowest id."""
    state = stored(links.select("id", "next", F.col("next").alias("ptr"), F.col("id").alias("low")))
    while True:
        moving = state.filter("ptr IS NOT NULL").alias("s")
        ahead = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("low").alias("low2"))
        moved = stored(
            moving.join(ahead, "ptr").selectExpr("id", "next", "ptr2 AS ptr", "least(low, low2) AS low", "low2 < low AS changed")
        )
        if moved.filter("changed AND ptr IS NOT NULL").isEmpty():
            # whoever still points anywhere is on a cycle, and knows its lowest id
            cycles = moved.filter("ptr IS NOT NULL").select("id", F.col("low").alias("low"))
            return links.join(cycles, "id", "left").selectExpr(
                "id", "CASE WHEN low IS NOT NULL AND next = low THEN NULL ELSE next END AS next",
            )
        rest = state.filter("ptr IS NULL")
        state = stored(rest.unionByName(moved.drop("changed")))


def ranked(links: DataFrame) -> DataFrame:
    """(`id`, `tail`, `rank`): the end of each link's list and how many links away it is."""
    state = stored(links.selectExpr(
        "id", "coalesce(next, id) AS ptr", "CASE WHEN next IS NULL THEN 0L ELSE 1L END AS rank", "next IS NULL AS done",
    ))
    while not state.filter("NOT done").isEmpty():
        ahead = state.select(
            F.col("id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("rank").alias("rank2"), F.col("done").alias("done2"),
        )
        moved = state.filter("NOT done").join(ahead, "ptr").selectExpr(
            "id", "ptr2 AS ptr", "rank + rank2 AS rank", "done2 AS done",
        )
        state = stored(state.filter("done").unionByName(moved))
    return state.select("id", F.col("ptr").alias("tail"), "rank")


@F.arrow_udf(T.ArrayType(T.ArrayType(geo.VERTEX_TYPE)))
def _simple_loops(walks: pa.Array) -> pa.Array:
    return pa.array(kernels.simple_loops(walks), pa.list_(pa.list_(kernels.VERTEX)))


def closed_rings(edges: DataFrame) -> DataFrame:
    """Rings (`k`, `ring`, their signed `size`, …) from the directed edges (`k`, `e`) of large
    boundaries: shells are positive, holes negative."""
    e = edges.select("k", F.struct("k", "e").alias("id"), "e")
    # at a vertex several edges leave, the first one clockwise from the way back goes on
    turn = "pmod(atan2(e.y1 - e.y2, e.x1 - e.x2) - atan2(f.y2 - f.y1, f.x2 - f.x1), 2 * pi())"
    ahead = e.select("k", F.col("id").alias("next"), F.col("e").alias("f"), F.col("e.x1").alias("x"), F.col("e.y1").alias("y"))
    choices = e.withColumn("x", F.col("e.x2")).withColumn("y", F.col("e.y2")).join(ahead, ["k", "x", "y"])
    links = stored(choices.withColumn("turn", F.expr(f"CASE WHEN {turn} = 0 THEN 2 * pi() ELSE {turn} END")).groupBy("id").agg(
        F.min_by("next", F.struct("turn", "next")).alias("next"),
    ))
    order = ranked(broken_cycles(links))
    ring = order.groupBy("tail").agg(F.expr(
        "transform(array_sort(collect_list(named_struct('r', -rank, 'x', id.e.x1, 'y', id.e.y1))), "
        "v -> named_struct('x', v.x, 'y', v.y, 'z', CAST(NULL AS DOUBLE)))"
    ).alias("v"))
    loops = ring.select(F.col("tail.k").alias("k"), F.explode(_simple_loops("v")).alias("v"))
    return stored(
        loops.select("k", F.expr("concat(v, slice(v, 1, 1))").alias("ring"))
        .withColumn("size", F.expr(f"{geo.ring_area2('ring')} / 2")).filter("size <> 0")
        .withColumn("g", F.expr(geo.polygon("array(ring)"))).withColumn("box", F.expr(geo.bbox("g")))
        .withColumn("rid", F.xxhash64("k", "ring")).withColumn("segs", F.expr(geo.segments("g"))).drop("g")
    )

def assembled(closed: DataFrame) -> DataFrame:
    """(`k`, `parts`): rings as polygons, each hole in the smallest shell around it."""
    shells, holes = closed.filter("size > 0"), closed.filter("size < 0")
    probe = holes.select(
        "k", F.col("rid").alias("hid"), "ring", "size",
        F.expr("(ring[0].x + ring[1].x) / 2").alias("px"), F.expr("(ring[0].y + ring[1].y) / 2").alias("py"),
    ).withColumn("box", F.expr("named_struct('xmin', px, 'ymin', py, 'xmax', px, 'ymax', py)"))
    around = overlapping_pairs(stored(probe), shells.select("k", "rid", "size", "segs", "box"), on=["k"]).filter(
        F.expr(f"r.size >= -l.size AND {geo.location('r.segs', 'l.px', 'l.py')} = 1")
    )
    owned = around.groupBy("l.hid").agg(F.first("l.ring").alias("hole"), F.min_by("r.rid", F.col("r.size")).alias("rid"))
    per_shell = owned.groupBy("rid").agg(F.collect_list("hole").alias("holes"))
    parts = shells.join(per_shell, "rid", "left").selectExpr(
        "k", "named_struct('dim', 2, 'rings', concat(array(ring), coalesce(holes, array()))) AS part",
    )
    return parts.groupBy("k").agg(F.collect_list("part").alias("parts"))
