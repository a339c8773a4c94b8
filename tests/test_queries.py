"""Every registered query against its SQL counterpart, and the plans that must scale."""

import re

import pytest

import __spark_entry__ as contract
from corpusbundle.queries import QUERIES
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    assert compare(spark, duck, name, lambda *_: df, ORACLES[name], SF) is None
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert not re.search(r"BatchEvalPython\b", text), "row-at-a-time Python"


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["source", "part_no", "n_sections", "byte_offset", "text"]
    assert df.count() > 0


@pytest.mark.parametrize(
    "name, columns",
    [
        ("type_filter", "doc_id:bigint,lang:string,source:string"),
        ("tree_order", None),
        ("url_parts", "page_id:bigint,url:string"),
        ("seed_urls", "url:string"),
        ("seed_coverage", "url:string"),
        ("bundle_names", "event_id:bigint,ts:timestamp_ntz,event_type:string"),
    ],
)
def test_scans_read_only_needed_columns(spark, name, columns):
    found = re.findall(r"ReadSchema: struct<([^>]*)>", plan(QUERIES[name](spark, SF)))
    assert all(schema == columns for schema in found)


@pytest.mark.parametrize("name", ["type_filter", "glob_filter", "url_parts", "page_filename", "size_labels"])
def test_row_wise_queries_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(QUERIES[name](spark, SF))
