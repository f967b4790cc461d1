"""Bitmaps of a fixed size that tell which rows are worth a closer look.

A set of keys, however large, is folded into `WORDS` × 64 bits. As a table of (word, bits)
it never exceeds `WORDS` rows, so it may always be broadcast. A clear bit proves that a key
is not in the set; a set bit only says that it may be, so whatever is done with the flagged
rows has to be exact by itself. A crowded bitmap costs time, never a result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 8.4 million bits; 2 MB as a table of longs.
WORDS = 1 << 17


def _place(key: Column) -> Column:
    return F.pmod(key, F.lit(WORDS * 64))


def bitmap(keys: DataFrame, key: Column) -> DataFrame:
    """The bits of all keys (longs, best a hash): at most `WORDS` rows."""
    at = keys.select(_place(key).alias("at")).filter("at IS NOT NULL")
    return at.groupBy(F.expr("CAST(at DIV 64 AS INT)").alias("__word")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(at % 64 AS INT)))").alias("__bits"),
    )


def flagged(df: DataFrame, key: Column, bits: DataFrame, name: str) -> DataFrame:
    """The rows with a boolean column that is false only where the key isn't in the bitmap."""
    own = df.withColumn("__at", _place(key)).withColumn("__word", F.expr("CAST(__at DIV 64 AS INT)"))
    return own.join(F.broadcast(bits), "__word", "left").withColumn(
        name, F.expr("coalesce(shiftright(__bits, CAST(__at % 64 AS INT)) & 1L = 1L, false)"),
    ).drop("__at", "__word", "__bits")
