"""Writing layers as GeoParquet directories, and the ledger of runs."""
from __future__ import annotations

import hashlib
import json
import os
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import crs as crs_functions
from ..functions import geometry as geo
from ..functions import wkb
from ..operators.joins import ROW

RUNS_KEPT = 200


def layer_path(output: str, layer: str, several: bool) -> str:
    """The output itself for a single layer, else `<output without ending>/<layer>.parquet`."""
    return f"{os.path.splitext(output)[0]}/{layer}.parquet" if several else output


def drop_other_layers(spark: SparkSession, output: str, kept: set[str]) -> None:
    """Delete the layers that an earlier run left beside those of this one: folders named as
    layers are, finished by Spark."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(os.path.splitext(output)[0])
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = {os.path.basename(path) for path in kept}
    for status in fs.listStatus(folder):
        path = status.getPath()
        if status.isDirectory() and path.getName().endswith(".parquet") and path.getName() not in names:
            if fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
                fs.delete(path, True)


def geo_json(crs: str, kinds: list[str], bbox: list[float] | None) -> str:
    column = {
        "encoding": "WKB", "geometry_types": kinds,
        "crs": {"id": {"authority": crs.split(":")[0], "code": int(crs.split(":")[1]) if crs.split(":")[1].isdigit() else crs.split(":")[1]}},
        "covering": {"bbox": {k: ["bbox", k] for k in ("xmin", "ymin", "xmax", "ymax")}},
    }
    if bbox and bbox[0] is not None:
        column["bbox"] = bbox
    return json.dumps({"version": "1.1.0", "primary_column": "geom", "columns": {"geom": column}})


def narrowed(df: DataFrame, layer: str) -> DataFrame:
    """Wide decimals as the types files commonly hold: whole ones BIGINT (with an error naming
    the column where one doesn't fit), others DOUBLE."""
    cols = []
    for f in df.schema.fields:
        c = geo.quote(f.name)
        if isinstance(f.dataType, T.DecimalType) and f.dataType.precision > 18:
            if f.dataType.scale == 0:
                message = geo.literal(f"column '{f.name}' of layer '{layer}' has a value too large for 64 bits")
                cols.append(F.expr(f"CASE WHEN {c} IS NULL THEN NULL ELSE coalesce(try_cast({c} AS BIGINT), raise_error({message})) END").alias(f.name))
            else:
                cols.append(F.col(c).cast("double").alias(f.name))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


def write_layer(df: DataFrame, layer: str, path: str, crs: str, metadata: dict | None = None, overwrite: bool = True) -> int:
    """Rows written to a directory of Parquet files (counted in the same job)."""
    seen = Observation()
    df = narrowed(df.drop(ROW), layer)
    if "geom" not in df.columns:
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite" if overwrite else "errorifexists").option("compression", "zstd").parquet(path)
        return seen.get["rows"]
    boxed = df.withColumn("bbox", F.expr(geo.bbox("geom")))
    counted = boxed.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.min("bbox.xmin").alias("x0"), F.min("bbox.ymin").alias("y0"),
        F.max("bbox.xmax").alias("x1"), F.max("bbox.ymax").alias("y1"), F.collect_set("geom.kind").alias("kinds"),
    )
    geom = wkb.to_wkb(F.col("geom"))
    counted.withColumn("geom", geom).write.mode("overwrite" if overwrite else "errorifexists").option("compression", "zstd").parquet(path)
    got = seen.get
    text = geo_json(crs, sorted(k.title().replace("string", "String").replace("Multip", "MultiP").replace("Multil", "MultiL").replace("collection", "Collection") for k in got["kinds"] or []), [got[k] for k in ("x0", "y0", "x1", "y1")])
    _side_file(df.sparkSession, f"{path}/_geo.json", text)
    if metadata:
        _side_file(df.sparkSession, f"{path}/_metadata.json", json.dumps(metadata))
    return got["rows"]


def _side_file(spark: SparkSession, path: str, content: str) -> None:
    """A small file beside the data, through the file system the data is on."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(target, True)
    try:
        out.write(bytearray(content, "utf-8"))
    finally:
        out.close()


def layer_geometry(df: DataFrame, working_crs: str, layer_crs: str) -> DataFrame:
    moved = crs_functions.transform("geom", working_crs, layer_crs)
    return df if moved == "geom" else df.withColumn("geom", F.expr(moved))


# ---- the ledger -------------------------------------------------------------

RUN = "id string, started timestamp, finished timestamp, ok boolean, error string, config_hash string, layers string, log string"


def record_run(spark: SparkSession, folder: str, started: datetime, layers: list[dict], config: dict, error: str | None = None, log: str = "") -> str:
    run = uuid.uuid4().hex
    row = (run, started, datetime.now(timezone.utc), error is None, error, hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest(), json.dumps(layers), log)
    spark.createDataFrame([row], RUN).coalesce(1).write.mode("append").json(folder)
    _forget_old_runs(spark, folder)
    return run


def _forget_old_runs(spark: SparkSession, folder: str) -> None:
    """Only the newest runs are kept; each is a file of its own."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    records = sorted((f for f in files.listStatus(top) if f.getPath().getName().endswith(".json")), key=lambda f: f.getModificationTime())
    for old in records[:-RUNS_KEPT]:
        files.delete(old.getPath(), False)


def list_runs(spark: SparkSession, folder: str, limit: int = RUNS_KEPT) -> DataFrame:
    """The newest runs first."""
    return spark.read.schema(RUN).json(folder).orderBy(F.col("started").desc(), F.col("id")).limit(limit)


def get_run(spark: SparkSession, folder: str, run: str) -> dict | None:
    rows = spark.read.schema(RUN).json(folder).filter(F.col("id") == run).take(1)
    return None if not rows else {**rows[0].asDict(), "layers": json.loads(rows[0].layers)}
