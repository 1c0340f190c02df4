"""Physical plans: what is pushed down, what is never used."""

import pytest

import __spark_entry__ as entry
from pricewright.plans.catalog import QUERIES

STREAMS_AND_SINKS = {n for n in QUERIES if n.startswith("stream_")} | {"written_by_year"}


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS_AND_SINKS))
def test_no_nested_loops(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("name", ["top_prices", "deduped_lines"])
def test_row_number_filter_limits_groups_on_the_map_side(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_columns_and_dates_reach_the_scan(spark, sf_dir):
    text = plan(entry.queries()["revenue_split"](spark, sf_dir))
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_extendedprice:double,l_shipdate:timestamp_ntz>" in text
    assert "LessThan(l_shipdate,1998-01-01" in text or "LessThan(l_shipdate,1997-01-01" in text


def test_one_scan_for_the_index(spark, sf_dir):
    text = plan(entry.queries()["price_index"](spark, sf_dir))
    assert text.count("lineitem.parquet") == 1


def test_one_scan_for_both_sides_of_the_asof(spark, sf_dir):
    text = plan(entry.queries()["asof_last_view"](spark, sf_dir))
    assert text.count("events.parquet") == 1
    assert "In(event_type, [purchase,view])" in text


@pytest.mark.parametrize(
    "name",
    ["price_fact", "price_quantiles", "asof_last_view", "interval_join", "supplier_position", "list_price_position",
     "revenue_classes", "quartile_outliers", "median_deviation", "price_index", "lead_time_curve"],
)
def test_nothing_small_enough_to_broadcast(spark, sf_dir, name):
    """As with dimensions that have outgrown the broadcast threshold."""
    from compare import connect, differences

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = entry.queries()[name](spark, sf_dir)
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text
        assert differences(df, connect(sf_dir), entry.oracle_sql()[name]) == []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
