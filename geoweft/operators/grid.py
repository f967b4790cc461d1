"""Box-overlap joins as equi-joins on grid cells, and shared DataFrame helpers.

Every box belongs to a level, the power of two just above its longer side, so it touches at
most four cells of its own level. Two boxes can only overlap where the smaller one meets a
cell of the larger one's level, so each row is keyed by its own level's cells and by the
cells of the coarser levels the *other* side uses. A country and a doorstep both produce a
handful of keys: no cell size to tune, no row that has to be broadcast.

Cells holding too many rows are split: both sides are counted per cell and the rows of a hot
cell are dealt over an n × m block of sub-groups, each pair still meeting exactly once.
"""
from __future__ import annotations

import math
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo

# Boxes smaller than 2^FLOOR share the lowest level (points have no size).
FLOOR_LEVEL = -16
# Rows of one side meeting in a cell before its rows are dealt over sub-groups.
HOT_CELL_ROWS = 20_000
# Rows of both sides of a pair join per task, and the fewest worth a task of their own.
ROWS_PER_TASK = 100_000
LEAST_ROWS_PER_TASK = 500
# Rows from which a table in too few files is spread over more before its cells are made.
SPREAD_ROWS = 50_000


# Hot cells up to which their table may be broadcast.
MOST_HOT_CELLS = 100_000

# Words of 64 bits for each box of a map of taken cells, and the most of them (8 MB).
WORDS_PER_BOX = 4
MOST_WORDS = 1 << 20
# Boxes from which such a map has only every third level.
MANY_BOXES = 1 << 20

_own_folders: dict[str, str] = {}
_scopes: list[str] = []


@contextmanager
def scratch_scope(spark: SparkSession):
    """Tables stored within are deleted at its end."""
    _scopes.append(uuid.uuid4().hex)
    try:
        yield
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark)).getParent()
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
        _scopes.pop()


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder the cluster names. Only where driver and executors are
    one process may it be missing: then a folder of our own does."""
    app = spark.sparkContext.applicationId
    folder = spark.conf.get("spark.checkpoint.dir", None) or _own_folders.get(app)
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own_folders[app] = tempfile.mkdtemp(prefix="geoweft-")
    return "/".join([folder.rstrip("/"), "geoweft", app, *_scopes, uuid.uuid4().hex])


def stored(df: DataFrame) -> DataFrame:
    """The rows written once, as Parquet in the shared checkpoint folder, and read back: what
    is read several times is computed once, the lineage is cut, and a lost executor costs
    nothing. The file sizes also tell the planner which tables are small."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def geometry_id(geom: Column) -> Column:
    """128 bits naming a geometry by its exact value."""
    return F.when(geom.isNotNull(), F.struct(
        F.xxhash64(geom).alias("h1"), F.xxhash64(F.lit(1), geom).alias("h2"),
    ))


def _with_level(df: DataFrame) -> DataFrame:
    side = "greatest(box.xmax - box.xmin, box.ymax - box.ymin)"
    return df.filter("box IS NOT NULL").withColumn(
        "level", F.expr(f"CAST(greatest({FLOOR_LEVEL}, ceil(log2({side}))) AS INT)"),
    )


def _with_cells(df: DataFrame, own_tag: int, other_levels: list[int], strict: bool) -> DataFrame:
    """One row per (tag, level, cx, cy). Tag 0 pairs a left row at its own level with right
    rows as small or smaller; tag 1 a right row at its own level with smaller left rows. Where
    the other side has none as small, a row has no cells of its own level."""
    listed = ", ".join(map(str, sorted(other_levels)))
    smallest = min(other_levels, default=FLOOR_LEVEL)
    coarser = f"filter(CAST(array({listed}) AS ARRAY<INT>), l -> l {'>' if strict else '>='} level)"
    cells = (
        "transform({levels}, l -> transform(sequence(CAST(floor(box.xmin / pow(2D, l)) AS BIGINT), "
        "CAST(floor(box.xmax / pow(2D, l)) AS BIGINT)), cx -> transform(sequence("
        "CAST(floor(box.ymin / pow(2D, l)) AS BIGINT), CAST(floor(box.ymax / pow(2D, l)) AS BIGINT)), "
        "cy -> named_struct('tag', {tag}, 'level', l, 'cx', cx, 'cy', cy))))"
    )
    own = cells.format(levels=f"filter(array(level), l -> l {'>=' if strict else '>'} {smallest})", tag=own_tag)
    rest = cells.format(levels=coarser, tag=1 - own_tag)
    return df.withColumn("cell", F.explode(F.expr(f"concat(flatten(flatten({own})), flatten(flatten({rest})))")))


def overlapping_pairs(
    left: DataFrame, right: DataFrame, on: list[str] = [],
) -> DataFrame:
    """Every pair of rows whose boxes overlap (touching included), exactly once.

    Both inputs have a `box` struct and should be stored tables, as they are read more than
    once; `on` names further columns that have to be equal. The result has the structs `l`
    and `r` holding the two rows."""
    keys = list(on)
    lv, rv = _with_level(left), _with_level(right)
    # row count and the (at most some dozens of) levels in use
    stats = [df.agg(F.count(F.lit(1)).alias("n"), F.collect_set("level").alias("levels")).first() for df in (lv, rv)]
    (l_rows, l_levels), (r_rows, r_levels) = stats
    l_cols, r_cols = left.columns, right.columns

    def packed(df, cols, name):
        # joined on one hash of cell and keys (a long sorts and hashes fast); the pairs are
        # checked on the values themselves below
        own = [F.col(k).alias(f"{name}_{k}") for k in keys]
        return df.select(
            F.xxhash64("cell", *[F.col(k) for k in keys]).alias("at"), F.col("cell").alias(f"{name}_cell"), *own, F.struct(*cols).alias(name),
        )

    # What is done with a row or pair costs far more than its bytes tell: tasks are cut by rows.
    tasks = _tasks(left.sparkSession, l_rows + r_rows)
    lv, rv = (_spread(df, rows, tasks) for df, rows in ((lv, l_rows), (rv, r_rows)))
    lc = packed(_with_cells(lv, 0, r_levels, strict=True), l_cols, "l")
    rc = packed(_with_cells(rv, 1, l_levels, strict=False), r_cols, "r")
    by = ["at"]
    if max(l_rows, r_rows) > HOT_CELL_ROWS:  # a row is in a cell once: else none can be hot
        lc, rc, by = deal_hot_cells(lc, rc)
    # Merged, never broadcast: the planner's sizes know nothing of the rows the cells add.
    joined = lc.repartition(tasks, *by).join(rc.repartition(tasks, *by).hint("merge"), by)
    size = "pow(2D, l_cell.level)"
    same = " AND ".join(["l_cell = r_cell", *[f"l_{k} = r_{k}" for k in keys]])
    return joined.filter(F.expr(
        "l.box.xmin <= r.box.xmax AND r.box.xmin <= l.box.xmax AND "
        f"l.box.ymin <= r.box.ymax AND r.box.ymin <= l.box.ymax AND {same} AND "
        # the one cell that holds the upper of both lower-left corners keeps the pair
        f"l_cell.cx = greatest(floor(l.box.xmin / {size}), floor(r.box.xmin / {size})) AND "
        f"l_cell.cy = greatest(floor(l.box.ymin / {size}), floor(r.box.ymin / {size}))"
    )).select("l", "r")


def _spread(df: DataFrame, rows: int, tasks: int) -> DataFrame:
    """A large table lying in few files, in as many as there are tasks for it. (Written, not
    just repartitioned: below an explode the optimizer then loses fields of its structs.)"""
    if rows < SPREAD_ROWS or df.rdd.getNumPartitions() >= tasks:
        return df
    return stored(df.repartition(tasks, "box"))


def _tasks(spark: SparkSession, rows: int) -> int:
    """Tasks for a join of this many rows: enough for every core once there is work for them,
    and more as the rows grow."""
    return max(1, rows // ROWS_PER_TASK, min(spark.sparkContext.defaultParallelism, rows // LEAST_ROWS_PER_TASK))


def deal_hot_cells(lc: DataFrame, rc: DataFrame):
    """Spread the rows of crowded cells over sub-groups both sides agree on: sides (`at`, struct
    `l` or `r`), and the columns that they are to be joined by."""
    by = ["at"]
    ln = lc.groupBy(by).agg(F.count(F.lit(1)).alias("ln"))
    rn = rc.groupBy(by).agg(F.count(F.lit(1)).alias("rn"))
    hot = stored(ln.join(rn, by).filter((F.col("ln") > HOT_CELL_ROWS) | (F.col("rn") > HOT_CELL_ROWS)).select(
        *by, F.ceil(F.col("ln") / HOT_CELL_ROWS).alias("ls"), F.ceil(F.col("rn") / HOT_CELL_ROWS).alias("rs"),
    ))
    cells = hot.count()
    if not cells:
        return lc, rc, by
    if cells <= MOST_HOT_CELLS:  # otherwise the hot keys themselves would be shuffled before they are split
        hot = F.broadcast(hot)

    def dealt(df, name, own, other, own_col, other_col):
        return (
            df.join(hot, by, "left")
            .withColumn(own_col, F.expr(f"pmod(xxhash64({name}), coalesce({own}, 1))"))
            .withColumn(other_col, F.explode(F.expr(f"sequence(0L, coalesce({other}, 1L) - 1)")))
            .drop("ls", "rs")
        )

    return (
        dealt(lc, "l", "ls", "rs", "li", "ri"), dealt(rc, "r", "rs", "ls", "ri", "li"), [*by, "li", "ri"],
    )


def meeting(rows: DataFrame, boxed: DataFrame, geom: str = "geom") -> DataFrame:
    """The rows whose geometry's box overlaps one of `boxed` (a stored table with `box`; touching
    included), and some others: what is dropped meets nothing, so it needn't be shuffled or stored.

    The boxes are marked in a map of bits by the cells they touch, from cells that hold few of them
    up to one that holds all. It has a bounded size and is broadcast; where it is crowded, more rows
    stay. The rows are read once."""
    finite = "abs(box.xmin) < double('Infinity') AND abs(box.xmax) < double('Infinity') AND abs(box.ymin) < double('Infinity') AND abs(box.ymax) < double('Infinity')"
    known = boxed.filter("box IS NOT NULL").select("box")
    n, strange, x0, x1, y0, y1 = known.agg(
        F.count(F.lit(1)), F.count_if(~F.expr(finite)), F.min("box.xmin"), F.max("box.xmax"), F.min("box.ymin"), F.max("box.ymax")).first()
    if not n:
        return rows.filter("false")
    wide, high = x1 - x0, y1 - y0
    if strange or max(wide, high) == math.inf:
        return rows
    apart = max(math.sqrt(wide) * math.sqrt(high) / math.sqrt(n), max(wide, high) / n) / 8
    lowest = max(FLOOR_LEVEL, math.frexp(apart)[1] - 1) if apart else FLOOR_LEVEL
    top = max(lowest, math.frexp(max(wide, high))[1])
    step = 1 if n <= MANY_BOXES else 3
    levels = [*range(lowest, top + step, step)]
    words = min(MOST_WORDS, 1 << math.ceil(math.log2(WORDS_PER_BOX * n)))
    listed = f"CAST(array({', '.join(map(str, levels))}) AS ARRAY<INT>)"
    # the lowest of the levels at which a box touches four cells at most; null beyond the highest
    side = "greatest(box.xmax - box.xmin, box.ymax - box.ymin)"
    level = f"array_min(filter({listed}, l -> pow(2D, l) >= {side}))"
    places = (
        "flatten(flatten(transform({levels}, l -> transform(sequence(CAST(floor(box.xmin / pow(2D, l)) AS BIGINT), "
        "CAST(floor(box.xmax / pow(2D, l)) AS BIGINT)), cx -> transform(sequence("
        "CAST(floor(box.ymin / pow(2D, l)) AS BIGINT), CAST(floor(box.ymax / pow(2D, l)) AS BIGINT)), "
        f"cy -> pmod(xxhash64(l, cx, cy), {words * 64}L))))))"
    )
    marked = known.withColumn("level", F.expr(level))
    own = [r.level for r in marked.select("level").distinct().collect()]
    taken = marked.select(F.explode(F.expr(places.format(levels=f"filter({listed}, l -> l >= level)"))).alias("at")).select(
        F.expr("at DIV 64").alias("word"), F.expr("shiftleft(1L, CAST(at % 64 AS INT))").alias("bits"))
    every = taken.unionByName(rows.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits")))
    bits = every.groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).agg(
        F.expr("array_sort(collect_list(named_struct('word', word, 'bits', bits)))").alias("b")).select(F.col("b.bits").alias("__bits"))
    coarser = ", ".join(map(str, own))
    tested = places.format(levels=f"filter(array_union(array({level}), CAST(array({coarser}) AS ARRAY<INT>)), l -> l >= {level})")
    hit = "exists({}, at -> shiftright(__bits[CAST(at DIV 64 AS INT)], CAST(at % 64 AS INT)) & 1L = 1L)"
    box = "transform(array({}), box -> {})[0]"
    may = (
        f"CASE WHEN box IS NULL THEN false WHEN NOT ({finite}) THEN true "
        f"WHEN box.xmin > {x1!r}D OR box.xmax < {x0!r}D OR box.ymin > {y1!r}D OR box.ymax < {y0!r}D THEN false "
        f"WHEN {level} IS NULL THEN true ELSE {hit.format(tested)} END"
    )
    return rows.join(F.broadcast(bits), F.expr(box.format(geo.bbox(geom), may)), "left_semi")


def grown(box: str, by: str) -> str:
    return (
        f"named_struct('xmin', {box}.xmin - {by}, 'ymin', {box}.ymin - {by}, "
        f"'xmax', {box}.xmax + {by}, 'ymax', {box}.ymax + {by})"
    )


def shapes(df: DataFrame, geom: str = "geom") -> DataFrame:
    """The distinct non-empty geometries of a table: id, box, flat segments, geometry. Copies
    of one geometry, however many, are worked on once."""
    return stored(
        df.select(F.col(geom).alias("geom")).filter("size(geom.parts) > 0").distinct()
        .select(
            geometry_id(F.col("geom")).alias("id"), F.expr(geo.bbox("geom")).alias("box"),
            F.expr(geo.segments("geom")).alias("segs"), "geom",
        )
    )
