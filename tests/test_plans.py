"""Plans stay free of pair-wise joins, and filters and columns reach the scan."""

import pytest

from quaycheck.plans import registry

QUERIES, SQL = registry.load()
SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_query_has_sql_but_the_listing():
    assert set(QUERIES) - set(SQL) == {"landing_inventory"}


def test_no_query_pairs_rows(spark):
    for name, fn in QUERIES.items():
        if name == "landing_inventory":
            continue
        text = plan(fn(spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        assert "PythonEval" not in text and "InPandas" not in text, name


@pytest.mark.parametrize("name,parts", [
    ("history_scan", ["PushedFilters: [IsNotNull(o_orderdate)", "TakeOrderedAndProject", "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double,o_orderdate:timestamp"]),
    ("lake_scan", ["ReadSchema: struct<event_type:string,value:double>"]),
    ("adjudication_queue", ["TakeOrderedAndProject"]),
    ("history_scope", ["WindowGroupLimit"]),
    ("sample_records", ["WindowGroupLimit"]),
    ("row_accounting", ["HashAggregate(keys=[file_id", "partial_count"]),
])
def test_plan_shapes(spark, name, parts):
    text = plan(QUERIES[name](spark, SF))
    for p in parts:
        assert p in text, (p, text[:3000])
