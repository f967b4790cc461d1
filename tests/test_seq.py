"""Numbering rows in their order."""
import random
import re

import pytest
from pyspark.sql import functions as F

from geoweft.operators import rows


@pytest.mark.parametrize("per_range", [rows.ROWS_PER_RANGE, 40])
def test_numbers_follow_the_row_order(spark, monkeypatch, per_range):
    monkeypatch.setattr(rows, "ROWS_PER_RANGE", per_range)
    keys = [(k // 7, k % 7) for k in range(1000)]
    random.Random(1).shuffle(keys)
    df = spark.createDataFrame([([a, b], f"{a}/{b}") for a, b in keys], "__src_row array<long>, name string").repartition(5)
    out = rows.seq(df, "n")
    assert [r.name for r in out.orderBy("n").collect()] == [f"{a}/{b}" for a, b in sorted(keys)]
    assert sorted(r.n for r in out.collect()) == list(range(1, 1001))
    assert not re.search("SortMergeJoin", out._jdf.queryExecution().executedPlan().toString())


def test_no_rows(spark):
    df = spark.createDataFrame([], "__src_row array<long>, name string")
    assert rows.seq(df, "n").count() == 0
    assert rows.seq(df.withColumn("x", F.lit(1)), "n").columns == ["__src_row", "name", "x", "n"]
