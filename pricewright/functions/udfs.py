"""Price measures around a Python function on Arrow batches.

``price_trend`` is what no built-in has; the others are built-ins. The function is
made inside another so that it travels to the workers by value and no worker has
to import this package.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T


def geometric_prices(daily: DataFrame, by: str) -> DataFrame:
    """Geometric mean of daily prices per ``by`` and year, and the same by logarithms of base two."""
    days = daily.filter(F.col("price") > 0).withColumn("year", F.year("day"))
    return days.groupBy(by, "year").agg(
        F.exp(F.avg(F.ln("price"))).alias("geo_price"), F.pow(F.lit(2.0), F.avg(F.log2("price"))).alias("geo_price_check")
    )


def theil_sen_udf():
    def slope(x, y):
        i, j = np.triu_indices(len(x), 1)
        step = x.to_numpy()[j] - x.to_numpy()[i]
        rise = y.to_numpy()[j] - y.to_numpy()[i]
        return float(np.median(rise[step != 0] / step[step != 0])) if (step != 0).any() else None

    slope.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": float}
    return F.pandas_udf(slope, T.DoubleType())


def price_trend(lines: DataFrame, by: str = "p_brand") -> DataFrame:
    """Robust trend of the mean price per month: the median slope between any two months.

    No built-in has it. A group has one row per month, so its pairs are bounded
    by the calendar.
    """
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    months = lines.filter(F.col("unit_price").isNotNull()).groupBy(by, month.alias("month")).agg(F.avg("unit_price").alias("price"))
    return months.groupBy(by).agg(theil_sen_udf()(F.col("month").cast("double"), F.col("price")).alias("slope"))


def price_steps(ranges: DataFrame, by: str, steps: int) -> DataFrame:
    """Equal steps from ``low`` to ``high`` for each row of ``ranges``; none where one of them is null."""
    width = (F.col("high") - F.col("low")) / steps
    whole = ranges.where("low IS NOT NULL AND high IS NOT NULL").withColumn("_width", width)
    made = whole.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(int(steps)))))
    low = F.col("low") + (F.col("step") - 1) * F.col("_width")
    return made.select(by, "step", low.alias("low"), (F.col("low") + F.col("step") * F.col("_width")).alias("high"))


def median_daily_price(daily: DataFrame) -> DataFrame:
    """Median of a product's daily prices; a group is bounded by the number of calendar days."""
    return daily.groupBy("l_partkey").agg(F.median("price").alias("median_price"))
