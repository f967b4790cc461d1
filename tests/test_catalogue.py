"""Every query of the catalogue against DuckDB at the smallest scale."""
import os

import pytest

from geoweft import catalogue
from tests.check_queries import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query_equals_its_sql(spark, name):
    line, _ = compare(spark, SF, name)
    assert line.startswith("ok" if name in catalogue.SQL else "ran"), line


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", ["spatial_join_first", "attribute_join_first", "nearest_bounded"])
def test_no_nested_loops(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
