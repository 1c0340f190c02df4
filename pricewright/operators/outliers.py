"""Unusual prices and spread that outliers do not move."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pricewright.operators.quantiles import exact_quantiles
from pricewright.operators.skew import join_on
from pricewright.session import written


def quartile_outliers(lines: DataFrame, by: str = "p_brand", reach: float = 1.5) -> DataFrame:
    """Lines outside the quartiles by more than ``reach`` times their distance."""
    lines = written(lines, "lines")  # read three times below
    fences = exact_quantiles(lines, [by], "unit_price", {"q1": 0.25, "q3": 0.75}, is_written=True)
    spread = F.col("q3") - F.col("q1")
    fences = fences.select(by, (F.col("q1") - reach * spread).alias("low"), (F.col("q3") + reach * spread).alias("high"))
    fences = written(fences, "fences")
    judged = join_on(lines, fences, [by])
    return judged.filter((F.col("unit_price") < F.col("low")) | (F.col("unit_price") > F.col("high")))


def median_deviation(lines: DataFrame, by: str = "p_brand") -> DataFrame:
    """Median price and median distance from it per group."""
    # Four passes follow; the two columns are written so that the join that
    # gave them runs once.
    lines = written(lines.select(by, "unit_price"), "prices")
    medians = written(exact_quantiles(lines, [by], "unit_price", {"median_price": 0.5}, is_written=True), "medians")
    around = join_on(lines, medians, [by])
    distance = around.select(by, F.abs(F.col("unit_price") - F.col("median_price")).alias("distance"))
    spread = exact_quantiles(distance, [by], "distance", {"mad": 0.5}).drop("n")
    return join_on(medians, spread, [by])
