"""Contiguous shards of near-equal bytes from global prefix sums, in DataFrame functions only.

Rows are put in order of their id by range partitioning; every partition sums its own sizes,
the (few) totals are summed up once, and each row's place in the whole table is its
partition's offset plus a running sum within. Cutting that line at equal targets gives shards
that hold consecutive rows. No step needs more than a partition's rows in one task.

Defined cases: a null text has no bytes, so its size is 1; null ids come first; rows of one id
are ordered by checksum, size and place in the input, so a repeated row is an ordinary row;
an empty table gives no rows; further columns of the input are ignored.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.grid import stored

# Rows (of some 30 bytes) that a range partition aims at.
ROWS_PER_PART = 1_000_000


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: its id, size, text_crc32, shard and slot in the shard."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    light = stored(docs.select(
        docs[id_col].alias("id"), (F.octet_length(text) + F.lit(1).cast("long")).alias("size"), F.crc32(text).alias("text_crc32"),
    ).withColumn("row_no", F.monotonically_increasing_id()))
    order = ["id", "text_crc32", "size", "row_no"]
    session = docs.sparkSession
    rows = light.count()
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), rows // ROWS_PER_PART)
    # written once: the partition a row is in and its place there are fixed from here on
    ranged = stored(light.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    sums = F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(*sums)  # a row per partition, whatever the table's size
    offsets = totals.select(
        "part", F.sum("bytes").over(Window.partitionBy()).alias("bytes_in_all"),
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
    )
    within = Window.partitionBy("part").orderBy(*order)
    placed = stored(
        ranged.withColumn("sum_here", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("row_here", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), "part")
        .select(
            "id", "size", "text_crc32", (F.col("rows_before") + F.col("row_here")).alias("place"),
            # a row goes where its first byte is
            F.expr(f"CAST(((bytes_before + coalesce(sum_here, 0)) * {shards}L) DIV bytes_in_all AS INT)").alias("shard"),
        )
    )
    starts = placed.groupBy("shard").agg(F.min("place").alias("start"))  # a row per shard
    return placed.join(F.broadcast(starts), "shard").select(
        F.col("id").alias(id_col), F.col("size").cast("long"), F.col("text_crc32").cast("long"), "shard",
        (F.col("place") - F.col("start")).cast("long").alias("slot"),
    )
