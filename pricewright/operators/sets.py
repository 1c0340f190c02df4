"""Set operations between periods and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pricewright.functions import columns as C
from pricewright.operators.facts import in_year


def _sold(lineitem: DataFrame, year: int) -> DataFrame:
    return in_year(lineitem, year).select("l_partkey")


def sold_in_both(lineitem: DataFrame, first: int, second: int) -> DataFrame:
    """Products with sales in both years. Each side is made distinct on the
    map side before the two meet."""
    return _sold(lineitem, first).distinct().intersect(_sold(lineitem, second).distinct())


def sold_only_first(lineitem: DataFrame, first: int, second: int) -> DataFrame:
    return _sold(lineitem, first).distinct().subtract(_sold(lineitem, second).distinct())


def surplus_sales(lineitem: DataFrame, first: int, second: int, block: int = 1_000_000) -> DataFrame:
    """Bag difference: a product sold m times in the first year and n in the
    second appears m - n times.

    ``exceptAll`` would write out all copies of a product in one task. Here a
    product's copies are cut into blocks, which are spread before they unfold.
    """
    sales = in_year(lineitem, first, second)
    year = F.year("l_shipdate")
    left = sales.groupBy("l_partkey").agg((F.count_if(year == first) - F.count_if(year == second)).alias("copies"))
    last = F.ceil(F.col("copies") / block) - 1
    blocks = left.filter("copies > 0").select("l_partkey", "copies", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("at"))
    size = F.least(F.lit(block).cast("bigint"), F.col("copies") - F.col("at") * block)
    spread = blocks.repartition("l_partkey", "at").select("l_partkey", size.cast("int").alias("size"))
    return spread.select("l_partkey", F.explode(F.array_repeat(F.lit(1), F.col("size")))).select("l_partkey")


def stacked_series(lineitem: DataFrame, events: DataFrame) -> DataFrame:
    """Monthly sums of two facts as one series."""
    revenue = lineitem.groupBy(C.month_start("l_shipdate").alias("month")).agg(
        F.sum(C.net_price()).cast("decimal(38,2)").alias("amount"), F.count(F.lit(1)).alias("rows")
    )
    value = events.groupBy(C.month_start("ts").alias("month")).agg(
        F.sum(C.money("value")).cast("decimal(38,2)").alias("amount"), F.count(F.lit(1)).alias("rows")
    )
    return revenue.withColumn("series", F.lit("revenue")).unionByName(value.withColumn("series", F.lit("event value")))
