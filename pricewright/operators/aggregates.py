"""Grouped price statistics. All combine on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pricewright.functions import columns as C


def price_summary(lines: DataFrame, by: str = "p_brand") -> DataFrame:
    p = F.col("unit_price")
    return lines.groupBy(by).agg(
        F.count(p).alias("lines"),
        F.avg(p).alias("mean_price"),
        F.stddev_samp(p).alias("sd_price"),
        F.min(p).alias("min_price"),
        F.max(p).alias("max_price"),
        (F.sum("l_extendedprice") / F.nullif(F.sum("l_quantity"), F.lit(0.0))).alias("weighted_price"),
    )


def approx_quantiles(lines: DataFrame, by: str, probs: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """Observed prices whose rank is off by at most 1 / ``accuracy`` of a group."""
    sketch = F.percentile_approx("unit_price", list(probs.values()), accuracy)
    picked = lines.groupBy(by).agg(sketch.alias("_q"))
    return picked.select(by, *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)])


def approx_products(lines: DataFrame, by: str, rsd: float = 0.05) -> DataFrame:
    return lines.groupBy(by).agg(F.approx_count_distinct("l_partkey", rsd).alias("products"))


def price_shape(lines: DataFrame, by: str = "p_brand") -> DataFrame:
    """Population skewness and excess kurtosis of the unit price."""
    return lines.groupBy(by).agg(F.skewness("unit_price").alias("skewness"), F.kurtosis("unit_price").alias("kurtosis"))


def _revenue_base(lineitem: DataFrame) -> DataFrame:
    """Sums at the finest level, so that the levels above expand a few rows
    and not the table."""
    return lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(C.money("l_extendedprice")).alias("amount"),
        F.sum(C.net_price()).alias("net"),
        F.count(F.lit(1)).alias("lines"),
    )


def _revenue_totals(*extra: Column) -> list[Column]:
    return [F.sum("amount").alias("amount"), F.sum("net").alias("net"), F.sum("lines").alias("lines"), *extra]


def revenue_cube(lineitem: DataFrame) -> DataFrame:
    return (
        _revenue_base(lineitem)
        .cube("l_returnflag", "l_linestatus")
        .agg(
            *_revenue_totals(
                F.grouping("l_returnflag").alias("all_flags"),
                F.grouping("l_linestatus").alias("all_statuses"),
            )
        )
    )


def revenue_rollup(lineitem: DataFrame) -> DataFrame:
    return (
        _revenue_base(lineitem)
        .rollup("l_returnflag", "l_linestatus")
        .agg(*_revenue_totals(F.grouping_id("l_returnflag", "l_linestatus").alias("level")))
    )


def revenue_grouping_sets(lineitem: DataFrame) -> DataFrame:
    """By flag, by status and in all, without the finest level."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return (
        _revenue_base(lineitem)
        .groupingSets([(flag,), (status,), ()], flag, status)
        .agg(*_revenue_totals(F.grouping_id(flag, status).alias("level")))
    )


def net_revenue(lines: DataFrame, *by: str | Column) -> DataFrame:
    """Exact revenue after discount, and the discount given."""
    return lines.groupBy(*by).agg(
        F.sum(C.money("l_extendedprice")).alias("gross"),
        F.sum(C.discount_amount()).alias("discount"),
        F.sum(C.net_price()).alias("net"),
    )


def discount_bands(lineitem: DataFrame) -> DataFrame:
    """Lines, share of lines and mean unit price per discount band."""
    bands = lineitem.groupBy(C.discount_band().alias("band")).agg(
        F.count(F.lit(1)).alias("lines"), F.avg(C.unit_price()).alias("mean_price")
    )
    # A handful of bands by now.
    return bands.withColumn("share", F.col("lines") / F.sum("lines").over(Window.partitionBy()))


def lead_time_curve(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Mean unit price by days from order to shipment.

    Lines shipped before they were ordered have no lead time and are left out.
    """
    lead = F.datediff("l_shipdate", "o_orderdate")
    return (
        lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .filter(F.col("l_shipdate") >= F.col("o_orderdate"))
        .groupBy(C.lead_band(lead).alias("lead"))
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.avg(C.unit_price()).alias("mean_price"),
            F.avg("l_discount").alias("mean_discount"),
        )
    )


def seasonal_index(lineitem: DataFrame) -> DataFrame:
    """Mean price of each calendar month over the mean of the twelve."""
    months = lineitem.groupBy(F.month("l_shipdate").alias("month")).agg(F.avg(C.unit_price()).alias("mean_price"))
    return months.withColumn("seasonal", F.col("mean_price") / F.avg("mean_price").over(Window.partitionBy()))


def price_elasticity(lines: DataFrame, by: str = "p_brand") -> DataFrame:
    """Least-squares fit of ln quantity on ln unit price."""
    y, x = F.ln("l_quantity"), F.ln("unit_price")
    return lines.filter((F.col("l_quantity") > 0) & (F.col("unit_price") > 0)).groupBy(by).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_count(y, x).alias("lines"),
    )


def years_of(df: DataFrame, date: str) -> list[int]:
    """All years from the first to the last date; two numbers reach the driver."""
    first, last = df.agg(F.year(F.min(date)), F.year(F.max(date))).first()
    return list(range(first, last + 1)) if first is not None else []


def price_matrix(lines: DataFrame, years: list[int], by: str = "p_brand") -> DataFrame:
    """Mean price with one column per year; see ``years_of``."""
    return (
        lines.groupBy(by)
        .pivot("year", years)
        .agg(F.avg("unit_price"))
        .select(by, *[F.col(str(y)).alias(f"y{y}") for y in years])
    )


def price_list(matrix: DataFrame, years: list[int], by: str = "p_brand") -> DataFrame:
    """The matrix back as one row per year."""
    long = matrix.unpivot(by, [f"y{y}" for y in years], "year", "mean_price")
    return long.withColumn("year", F.substring("year", 2, 4).cast("int"))
