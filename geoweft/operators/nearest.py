"""The nearest shape by a search down an adaptive tree of cells.

The tree is a quadtree by density: a cell is split while more than `LEAF_SHAPES` shapes have
their centre in it, several halvings at a time. It is built from the top by one aggregate a rung
over the shapes whose cells are still too full, so a town gets small cells, the country around
it large ones, and an outlier costs nobody else a thing.

A left shape first goes down the cells around its own centre: how far the nearest child of the
last full one is at its farthest bounds its reach. The search then takes the rungs in the same
order. Each left shape holds the cells that may hold its nearest one: those within its reach, which
shrinks to how far the closest of its cells is at its farthest. Full cells are replaced by their
children, those out of reach are never kept, leaves wait. At the bottom only boxes meet, rows of
crowded leaves dealt over tasks; shapes are fetched for the pairs that are left."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .grid import deal_hot_cells, stored

# Shapes that a cell may hold before it is split, the halvings of its side by a split, and the
# halvings of the whole extent at which cells aren't split any more (a town beside an outlier, at
# any number of shapes, is split well before).
LEAF_SHAPES = 8
STRIDE = 3
DEPTH = 42
# Full cells up to which a rung's cells (64 at most in each) are broadcast.
MOST_FULL_CELLS = 2_000

# Bounds of distances are computed apart from the distances: they may differ in the last digits.
SLACK = "1.000000001D"
LOW = (
    "sqrt(pow(greatest(0D, {b}.xmin - {a}.xmax, {a}.xmin - {b}.xmax), 2) + "
    "pow(greatest(0D, {b}.ymin - {a}.ymax, {a}.ymin - {b}.ymax), 2))"
)
HIGH = (
    "sqrt(pow(greatest({b}.xmax - {a}.xmin, {a}.xmax - {b}.xmin), 2) + "
    "pow(greatest({b}.ymax - {a}.ymin, {a}.ymax - {b}.ymin), 2))"
)


def _code(level: int) -> Column:
    """A cell's place within its rung, from the centre's place on the finest grid."""
    return F.expr(f"named_struct('x', shiftright(ix, {DEPTH - level}), 'y', shiftright(iy, {DEPTH - level}))")


def _extent() -> Column:
    return F.struct(*[getattr(F, f)(f"box.{c}").alias(c) for f, c in (("min", "xmin"), ("min", "ymin"), ("max", "xmax"), ("max", "ymax"))])


class CellTree:
    """Cells of the shapes `right` (`id`, `box`). `rungs`: (level, cells, full) with cells as
    rows (`code`, `parent`, `cbox`, `leaf`) and the number of full ones; `members`: (`level`,
    `code`, `rid`, `rbox`), each shape under its leaf."""

    def __init__(self, right: DataFrame):
        seen = right.agg(*[getattr(F, f)(f"box.{c}").alias(c) for f, c in (("min", "xmin"), ("min", "ymin"), ("max", "xmax"), ("max", "ymax"))]).first()
        self.rungs: list[tuple[int, DataFrame, int]] = []
        self.members: DataFrame | None = None
        if seen.xmin is None:
            return
        self._start = seen.xmin, seen.ymin
        self._cell = max(seen.xmax - seen.xmin, seen.ymax - seen.ymin, 1e-9) / 2**DEPTH
        open_ = self.placed(right)
        settled = []
        for level in range(STRIDE, DEPTH + 1, STRIDE):
            leaf = (F.col("n") <= LEAF_SHAPES) if level < DEPTH else F.lit(True)
            counted = open_.groupBy(_code(level).alias("code"), _code(level - STRIDE).alias("parent")).agg(F.count(F.lit(1)).alias("n"), _extent().alias("cbox"))
            cells = stored(counted.select("code", "parent", "cbox", leaf.alias("leaf")))
            total, full = cells.agg(F.count(F.lit(1)), F.count_if(~F.col("leaf"))).first()
            self.rungs.append((level, cells, full))
            known = cells.select("code", "leaf")
            if total <= MOST_FULL_CELLS * 4**STRIDE:
                known = F.broadcast(known)
            told = stored(open_.withColumn("code", _code(level)).join(known, "code"))
            settled.append(told.filter("leaf").select(F.lit(level).alias("level"), "code", F.col("id").alias("rid"), F.col("box").alias("rbox")))
            if not full:
                break
            open_ = told.filter("NOT leaf").select("id", "box", "ix", "iy")
        self.members = settled[0]
        for more in settled[1:]:
            self.members = self.members.unionByName(more)

    def placed(self, shapes: DataFrame) -> DataFrame:
        """Shapes with the place of their centre on the finest grid, or the one next to it."""
        def place(low: str, high: str, start: float) -> str:
            steps = f"(box.{low} / 2 + box.{high} / 2 - {start!r}D) / {self._cell!r}D"
            return f"CAST(floor(greatest(0D, least({float(2**DEPTH - 1)!r}D, {steps}))) AS BIGINT)"

        x, y = self._start
        return shapes.select("id", "box", F.expr(place("xmin", "xmax", x)).alias("ix"), F.expr(place("ymin", "ymax", y)).alias("iy"))

    def children(self, rung: int) -> DataFrame:
        """(`code` of a full cell of the rung above, `kids`), 64 at most."""
        level, cells, _ = self.rungs[rung]
        kid = F.struct(F.lit(level).alias("level"), "code", "cbox", "leaf")
        return cells.groupBy("parent").agg(F.collect_list(kid).alias("kids")).withColumnRenamed("parent", "code")


def _within(rows: DataFrame, limit: str) -> DataFrame:
    return rows.filter(F.expr(f"low <= reach * {SLACK}{limit}"))


def _nearer(state: DataFrame, limit: str) -> DataFrame:
    """Without the cells of a shape that can't hold its nearest one."""
    closest = F.min("high").over(Window.partitionBy("id"))
    return _within(state.withColumn("reach", F.least("reach", closest)), limit)


def _with_reach(left: DataFrame, tree: CellTree) -> DataFrame:
    """Left shapes (`id`, `box`) with `reach`, a distance at which each has met some shape."""
    rows = tree.placed(left).withColumn("rung", F.lit(0)).withColumn("code", F.expr("named_struct('x', 0L, 'y', 0L)"))
    kids = tree.children(0).withColumn("rung", F.lit(0))
    for rung in range(1, len(tree.rungs)):
        above, cells, full = tree.rungs[rung - 1]
        split = cells.filter("NOT leaf").select(F.col("code").alias("own"), F.lit(True).alias("split"))
        if full <= MOST_FULL_CELLS:
            split = F.broadcast(split)
        rows = rows.withColumn("own", _code(above)).join(split, "own", "left").select(
            "id", "box", "ix", "iy", F.when(F.col("split"), F.lit(rung)).otherwise(F.col("rung")).alias("rung"),
            F.when(F.col("split"), F.col("own")).otherwise(F.col("code")).alias("code"))
        kids = kids.unionByName(tree.children(rung).withColumn("rung", F.lit(rung)))
    kids = kids.select("rung", "code", F.expr("transform(kids, k -> k.cbox)").alias("boxes"))
    if sum(full for _, _, full in tree.rungs) <= MOST_FULL_CELLS:
        kids = F.broadcast(kids)
    met = rows.select("id", "box", "rung", "code").join(kids, ["rung", "code"]).select("id", "box", F.explode("boxes").alias("cbox"))
    sides = ("xmin", "ymin", "xmax", "ymax")
    found = met.select("id", *[F.col(f"box.{c}") for c in sides], F.expr(HIGH.format(a="box", b="cbox")).alias("high"))
    found = found.groupBy("id", *sides).agg(F.min("high").alias("reach"))
    return stored(found.select("id", F.struct(*sides).alias("box"), "reach"))


def candidates(left: DataFrame, tree: CellTree, max_distance: float | None = None) -> DataFrame:
    """(`id`, `rid`): of each left shape (`id`, `box`) the shapes that may be its nearest one."""
    limit = "" if max_distance is None else f" AND low <= {float(max_distance)!r}D"
    low, high = (F.expr(f.format(a="box", b="cell.cbox")) for f in (LOW, HIGH))

    def opened(rows: DataFrame, kids: Column) -> DataFrame:
        return rows.withColumn("cell", F.explode(kids)).select("id", "box", "reach", "cell.level", "cell.code", "cell.leaf", low.alias("low"), high.alias("high"))

    # the first rung has at most 4^STRIDE cells: one small row, held by every left shape
    state = _within(opened(_with_reach(left, tree), tree.children(0).select("kids").scalar()), limit)
    for rung in range(1, len(tree.rungs)):
        above, _, full = tree.rungs[rung - 1]
        kids = tree.children(rung).withColumn("level", F.lit(above))
        if full <= MOST_FULL_CELLS:
            kids = F.broadcast(kids)
        if full > MOST_FULL_CELLS or rung % 2 == 0:
            state = _nearer(state, limit)
        met = state.join(kids, ["level", "code"], "left")
        as_it_is = F.array(F.struct("level", "code", F.lit(None).cast("struct<xmin:double,ymin:double,xmax:double,ymax:double>").alias("cbox"), "leaf"))
        told = met.withColumn("cell", F.explode(F.coalesce("kids", as_it_is)))
        state = _within(told.select(
            "id", "box", "reach", "cell.level", "cell.code", "cell.leaf",
            *[F.when(F.col("cell.cbox").isNull(), F.col(name)).otherwise(value).alias(name) for name, value in (("low", low), ("high", high))]), limit)
    leaves = stored(_nearer(state, limit).select("id", "box", "reach", "level", "code"))
    at = F.xxhash64("level", "code").alias("at")
    lc = leaves.select(at, F.struct("id", "box", "reach", "level", "code").alias("l"))
    rc = tree.members.select(at, F.struct("rid", "rbox", "level", "code").alias("r"))
    lc, rc, by = deal_hot_cells(lc, rc)
    met = lc.join(rc, by).filter("l.level = r.level AND l.code = r.code").select("l.id", "l.box", "l.reach", "r.rid", "r.rbox")
    near = met.select("id", "rid", "reach", *[F.expr(f.format(a="box", b="rbox")).alias(name) for name, f in (("low", LOW), ("high", HIGH))])
    return _nearer(_within(near, limit), limit).select("id", "rid")
