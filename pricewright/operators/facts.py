"""The price observation and its rollups.

Joins carry no broadcast hints: Catalyst broadcasts a dimension while its file
is below the threshold and sort-merges beyond, where adaptive execution splits
the partitions of heavy keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pricewright.functions import columns as C
from pricewright.sources.tables import load


def price_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line with its product, seller, order and prices."""
    seller = (
        load(spark, sf_dir, "supplier")
        .join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", "n_name", "r_name")
    )
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    part = load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    return (
        load(spark, sf_dir, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(seller, F.col("l_suppkey") == F.col("s_suppkey"))
        .drop("o_orderkey", "p_partkey", "s_suppkey")
        .withColumns(
            {
                "unit_price": C.unit_price(),
                "net_price": C.net_price(),
                "discount_amount": C.discount_amount(),
                "year": F.year("l_shipdate"),
                "month": F.month("l_shipdate"),
            }
        )
    )


def priced_lines(lineitem: DataFrame) -> DataFrame:
    return lineitem.withColumn("unit_price", C.unit_price())


def branded_lines(lineitem: DataFrame, part: DataFrame, columns: tuple[str, ...] = ("p_brand",)) -> DataFrame:
    """Lines with their unit price and product attributes."""
    attributes = part.select("p_partkey", *columns)
    return priced_lines(lineitem).join(attributes, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")


def daily_prices(lineitem: DataFrame) -> DataFrame:
    """Sales and price per product and ship day.

    A product has at most one row per calendar day here however many lines it
    sold, so windows per product over this table stay small.
    """
    return (
        lineitem.groupBy("l_partkey", F.to_date("l_shipdate").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.sum("l_quantity").alias("quantity"),
            C.summed_money("l_extendedprice").alias("amount"),
            F.sum(C.unit_price()).alias("price_sum"),
        )
        .withColumn("price", F.col("amount") / F.nullif(F.col("quantity"), F.lit(0.0)))
    )


def period_sales(lines: DataFrame, unit: str | list[str], period: Column, name: str = "period") -> DataFrame:
    """Quantity, amount and average price per unit and period."""
    units = [unit] if isinstance(unit, str) else unit
    return (
        lines.groupBy(*units, period.alias(name))
        .agg(
            F.sum("l_quantity").alias("quantity"),
            C.summed_money("l_extendedprice").alias("amount"),
        )
        .withColumn("price", F.col("amount") / F.nullif(F.col("quantity"), F.lit(0.0)))
    )


def in_year(df: DataFrame, *years: int, date: str = "l_shipdate") -> DataFrame:
    """Rows of the given years, as date ranges that parquet can skip by."""
    wanted = F.lit(False)
    for year in years:
        low, high = (F.lit(f"{y}-01-01").cast("timestamp_ntz") for y in (year, year + 1))
        wanted = wanted | ((F.col(date) >= low) & (F.col(date) < high))
    return df.filter(wanted)
