"""Plans: what reaches the scan, and what must not be in them."""

import os

import pytest

import __spark_entry__ as entry
from cloudloom.plans import clouds, records

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", [*clouds.QUERIES, *records.QUERIES])
def test_no_cross_joins(spark, name):
    text = plan(entry.queries()[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "BatchEvalPython" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(clouds.scaled_rect(spark, DATA))
    assert "GreaterThanOrEqual(X," in text and "LessThanOrEqual(Y," in text and "ReadSchema: struct<point_id:bigint,X:int,Y:int>" in text
    assert "ReadSchema: struct<point_id:bigint,classification:smallint,point_source_ID:int>" in plan(records.p3_found(spark, DATA))
    assert "EqualTo(classification,2)" in plan(clouds.classification_thin(spark, DATA))
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan(clouds.scaled_xyz(spark, DATA))
