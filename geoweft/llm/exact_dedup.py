"""Exact deduplication by progressive refinement, in DataFrame functions only.

Documents are first told apart by the length of their text, then by a hash of its first
characters, and only where both agree by a hash of the whole text. Texts count as equal when
they agree after every blank of `[\\x20\\x09-\\x0D]` is deleted.

Defined cases: a null text counts as empty, and all empty texts are equal; null ids sort after
all others; of rows that agree in everything one stays; an empty table gives an empty result;
other columns of the input, whatever their names, are ignored or carried along untouched.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.grid import stored
from .bits import bitmap, flagged

# Characters of a text that the second round compares.
PREFIX = 64
BLANKS = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    """The text without blanks."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def _measured(docs: DataFrame, id_col: str, text_col: str, rest: Column) -> DataFrame:
    text = docs[text_col]
    return docs.select(
        docs[id_col].alias("id"), F.char_length(F.coalesce(text.cast("string"), F.lit(""))).cast("long").alias("points"),
        normalised(text).alias("body"), rest.alias("rest"),
    ).withColumn("length", F.octet_length("body").cast("long")).withColumn("prefix", F.xxhash64(F.substring("body", 1, PREFIX)))


def _hashed(docs: DataFrame, id_col: str, text_col: str, rest: Column) -> DataFrame:
    """Every row with the hash of its whole text, `whole`, where the rounds before it found
    another row of the same length and prefix (elsewhere null)."""
    light = stored(_measured(docs, id_col, text_col, F.lit(None)).select("length", "prefix"))
    lengths = stored(bitmap(light.groupBy("length").count().filter("count > 1"), F.xxhash64("length")))
    some = flagged(light, F.xxhash64("length"), lengths, "met").filter("met")
    groups = some.groupBy("length", "prefix").count().filter("count > 1")
    bits = stored(bitmap(groups, F.xxhash64("length", "prefix")))
    rows = flagged(_measured(docs, id_col, text_col, rest), F.xxhash64("length", "prefix"), bits, "shared")
    return rows.select("id", "points", "rest", F.when(F.col("shared"), F.sha2("body", 256)).alias("whole"))


def _groups(rows: DataFrame) -> DataFrame:
    """Of each whole text found more than once: its rows and the one that stays."""
    first = F.struct((-F.col("points")).alias("order"), F.isnull("id").alias("no_id"), "id", "row_no")
    return (
        rows.filter("whole IS NOT NULL").groupBy("whole").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first"))
        .filter("n > 1")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: its id, keep_id, group_size, kept, and the columns to carry.

    Of equal texts the row with the most code points in its original text stays, then the one
    with the smallest id."""
    rest = F.struct(*[docs[c] for c in carry]) if carry else F.lit(None).cast("string")
    rows = stored(_hashed(docs, id_col, text_col, rest).withColumn("row_no", F.monotonically_increasing_id()))
    # One row at most for each text and task leaves the aggregation, so no copy group is hot
    # there; the join after it splits skewed keys.
    groups = stored(_groups(rows))
    carried = [F.col(f"rest.{c}").alias(c) for c in carry]
    alone = rows.filter("whole IS NULL")
    met = rows.filter("whole IS NOT NULL").join(groups, "whole", "left")
    single = [F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")]
    return alone.select(*single, *carried).unionByName(met.select(
        F.col("id").alias(id_col), F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row_no") == F.col("first.row_no"), F.lit(True)).alias("kept"), *carried,
    ))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns. Texts are only shuffled where a row's
    id and hash are those of a row to drop."""
    every = F.struct(*[docs[c] for c in docs.columns])
    hashed = _hashed(docs, id_col, text_col, every)
    rows = stored(hashed.select("id", "points", "whole").filter("whole IS NOT NULL").withColumn("row_no", F.monotonically_increasing_id()))
    groups = stored(_groups(rows))
    dropped = rows.join(groups, "whole").filter("row_no != first.row_no")
    bits = stored(bitmap(dropped, F.xxhash64("id", "whole")))
    marked = flagged(hashed, F.when(F.col("whole").isNotNull(), F.xxhash64("id", "whole")), bits, "suspect")
    met = marked.filter("suspect").join(groups, "whole", "left")
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("points") == -F.col("first.order"))
    rest = met.filter(F.col("n").isNull()).select("rest")
    # Rows that agree with the one that stays in everything counted: one of them is left.
    keepers = met.filter(F.col("n").isNotNull() & same).groupBy("whole").agg(F.first("rest").alias("rest")).select("rest")
    return marked.filter("NOT suspect").select("rest").unionByName(rest).unionByName(keepers).select("rest.*")
