import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session


@pytest.fixture(scope="session")
def features(spark):
    """A table of (name, WKT) features in row order."""
    from pyspark.sql import functions as F

    from geoweft.functions import text
    from geoweft.operators.grid import stored

    def make(rows):
        df = spark.createDataFrame([(i, n, w) for i, (n, w) in enumerate(rows)], "i long, name string, w string")
        return stored(df.select("name", F.expr(text.from_wkt("w")).alias("geom"), F.array("i").alias("__src_row")))

    return make


@pytest.fixture(scope="session")
def shown():
    """Rows in order: the columns named, then WKT, then the area."""
    from pyspark.sql import functions as F

    from geoweft.functions import geometry as geo
    from geoweft.functions import text

    def collect(df, *cols, wkt=False, area=True):
        extra = ([F.expr(text.as_wkt("geom"))] if wkt else []) + ([F.expr(f"round({geo.area('geom')}, 6)")] if area else [])
        return [tuple(r) for r in df.orderBy("__src_row").select(*cols, *extra).collect()]

    return collect
