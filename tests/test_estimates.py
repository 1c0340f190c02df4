"""Estimates against exact answers, within the error they promise."""

from pyspark.sql import functions as F

from pricewright.operators import aggregates, sketches
from pricewright.operators.facts import branded_lines
from pricewright.sources.tables import load


def _lines(spark, sf_dir):
    return branded_lines(load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")).cache()


def test_quantiles_within_rank_error(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    accuracy = 100
    estimates = aggregates.approx_quantiles(lines, "p_brand", {"q": 0.75}, accuracy)
    ranks = (
        lines.join(estimates, "p_brand")
        .groupBy("p_brand")
        .agg(F.count_if(F.col("unit_price") < F.col("q")).alias("below"), F.count_if(F.col("unit_price") <= F.col("q")).alias("upto"), F.count(F.lit(1)).alias("n"))
    )
    for r in ranks.collect():
        slack = r["n"] / accuracy + 1
        assert r["below"] - slack <= 0.75 * r["n"] <= r["upto"] + slack


def test_products_near_exact(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    exact = {r[0]: r[1] for r in lines.groupBy("p_brand").agg(F.count_distinct("l_partkey")).collect()}
    for r in aggregates.approx_products(lines, "p_brand", 0.02).collect():
        assert abs(r["products"] - exact[r["p_brand"]]) <= max(1, 0.1 * exact[r["p_brand"]])


def test_merged_daily_sketches_count_as_one(spark):
    """Items seen on several days count once; nulls count for nothing."""
    rows = [("a", i % 50, f"2024-01-{1 + i % 9:02d}") for i in range(900)] + [("a", None, "2024-01-01"), ("b", None, "2024-01-01"), ("b", 1, None)]
    days = sketches.daily_sketches(spark.createDataFrame(rows, "k string, item long, at string"), ["k"], "item", "at")
    assert days.count() == 11
    got = sketches.merged_counts(days, ["k"], F.year("day")).collect()
    assert {(r["k"], r["period"]): r["items"] for r in got} == {("a", 2024): 50, ("b", 2024): 0, ("b", None): 1}
    assert sketches.merged_counts(days.limit(0), ["k"], F.year("day")).count() == 0
