"""Row keys of file sources: their order, and that they cost neither a join nor a pushed filter."""
import os
import re

import pytest
from pyspark.sql import functions as F

from geoweft import sources
from geoweft.plans import spec
from geoweft.sources import file_rank, read_source, with_file_order

ROW = "__src_row"


def source(path, fmt="parquet", **more):
    return spec.Source(id="s", uri=str(path), format=fmt, **more)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def layers(spark, tmp_path):
    """Rows 0 … 299 in files whose paths sort in the rows' order, in awkward folders."""
    names = ["a/part-9", "a b/é%20", "a b/é 1/x=1", "b/part-00010-long-name-that-goes-on", "b/part-00010-long-name-that-goes-on-further", "b/part-00011"]
    full = sorted((str(tmp_path / "top" / n) for n in names), key=lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).toUri().toString().encode() + b"/")
    for i, path in enumerate(full):
        spark.range(i * 50, i * 50 + 50).withColumn("v", F.col("id") * 2).coalesce(1).write.parquet(path)
    return str(tmp_path / "top"), full


def test_rows_sort_by_path_and_place(spark, layers):
    _, full = layers
    df = with_file_order(spark.read.parquet(*reversed(full)))
    assert [r.id for r in df.orderBy(ROW).collect()] == list(range(300))
    assert df.select(ROW).distinct().count() == 300


def test_filters_reach_the_scan_and_nothing_is_shuffled(spark, layers):
    _, full = layers
    keyed = with_file_order(spark.read.parquet(*full))
    for df in (keyed.filter("v > 50").select("v"), keyed.filter("v > 50")):
        text = plan(df)
        assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(v,50\)", text), text
        assert not re.search("Exchange|Join|PythonRDD|ExistingRDD|LocalTableScan", text)
    assert re.search(r"ReadSchema: struct<v:bigint[,>]", plan(keyed.select("v")))


def test_one_file_needs_no_path(spark, tmp_path):
    spark.range(9).coalesce(1).write.parquet(str(tmp_path / "one"))
    df = read_source(spark, source(tmp_path / "one", geometry=False))
    assert "file_path" not in plan(df) and [r[0] for r in df.orderBy(ROW).select(F.element_at(ROW, 2)).collect()] == list(range(9))


@pytest.mark.parametrize("count", [2, 7, 1200])
def test_ranks_of_many_files_are_short(spark, count):
    files = [f"hdfs://name:8020/table/day=2024-01-{i % 28:02d}/part-{i:05d}-{hash((i, 1)) & 0xFFFFFFFF:08x}.parquet" for i in range(count)]
    paths = spark.createDataFrame([(f,) for f in files], "p string").select(F.struct(F.col("p").alias("file_path")).alias("_metadata"))
    rows = paths.select(F.col("_metadata.file_path").alias("p"), F.array(*file_rank(files)).alias("k")).collect()
    assert [r.p for r in sorted(rows, key=lambda r: r.k)] == sorted(files)
    assert len(rows[0].k) <= 3


def test_a_path_that_the_listing_lacks_is_refused(spark):
    listed = ["file:///data/a/1.parquet", "file:///data/a/2.parquet"]
    for path, fits in (("file:/data/a/2.parquet", True), ("file:///data/a/2.parquet", True), ("file:/elsewhere/2.parquet", False)):
        df = spark.createDataFrame([((path,),)], "_metadata struct<file_path: string>").select(*file_rank(listed))
        if fits:
            assert df.count() == 1 and df.collect()
        else:
            with pytest.raises(Exception, match="outside the source's listing"):
                df.collect()


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_text_files_keep_their_order(spark, tmp_path, fmt):
    os.makedirs(tmp_path / "t")
    for k, name in enumerate(["a", "b", "c"]):
        with open(tmp_path / "t" / f"{name}.{fmt}", "w") as out:
            if fmt == "csv":
                out.write("id,v\n")
            for i in range(k * 20, k * 20 + 20):
                out.write(f"{i},x\n" if fmt == "csv" else f'{{"id": {i}}}\n')
    df = read_source(spark, source(tmp_path / "t", fmt, geometry=False, lines=True))
    assert [int(r.id) for r in df.orderBy(ROW).select("id").collect()] == list(range(60))
    assert not re.search("Exchange|Join", plan(df))


def test_a_long_of_a_key_sorts_as_its_bytes():
    assert sources.PATH_BYTES * 8 < 63
