"""Price indexes and the split of a revenue change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pricewright.operators.facts import in_year, period_sales


def price_index(sales: DataFrame, unit: str, base: int) -> DataFrame:
    """Matched-model indexes of every period against ``base``.

    ``sales`` has one row per unit and period with ``price`` and ``quantity``
    (``period_sales``). Base values reach a unit's other periods by a window
    over its few rows, which saves the scan a self-join would repeat. Units
    without sales in the base period, or with no positive price, do not match.
    """
    own = Window.partitionBy(unit)
    at_base = F.col("period") == base
    matched = sales.filter((F.col("price") > 0) & F.col(unit).isNotNull()).select(
        "period",
        F.col("price").alias("p1"),
        F.col("quantity").alias("q1"),
        F.max(F.when(at_base, F.col("price"))).over(own).alias("p0"),
        F.max(F.when(at_base, F.col("quantity"))).over(own).alias("q0"),
    ).filter(F.col("p0").isNotNull())
    p0, q0, p1, q1 = (F.col(c) for c in ("p0", "q0", "p1", "q1"))
    return (
        matched.groupBy("period")
        .agg(
            F.count(F.lit(1)).alias("units"),
            (F.sum(p1 * q0) / F.sum(p0 * q0)).alias("laspeyres"),
            (F.sum(p1 * q1) / F.sum(p0 * q1)).alias("paasche"),
            F.exp(F.avg(F.ln(p1 / p0))).alias("jevons"),
        )
        .withColumn("fisher", F.sqrt(F.col("laspeyres") * F.col("paasche")))
    )


def revenue_split(lineitem: DataFrame, first: int, second: int) -> DataFrame:
    """Revenue change between two years as price, volume, mix, new and lost.

    For products sold in both years: the price part is at new quantities, the
    volume part scales the old basket to the new total quantity, and mix is
    what the shift between products adds. One scan gives both years.
    """
    sales = period_sales(in_year(lineitem, first, second), "l_partkey", F.year("l_shipdate"), "year")

    def at(year: int, col: str):
        return F.max(F.when(F.col("year") == year, F.col(col)))

    items = sales.groupBy("l_partkey").agg(
        at(first, "amount").cast("decimal(20,2)").alias("a0"),
        at(second, "amount").cast("decimal(20,2)").alias("a1"),
        at(first, "quantity").alias("q0"),
        at(second, "quantity").alias("q1"),
        at(first, "price").alias("p0"),
        at(second, "price").alias("p1"),
    )
    both = F.col("a0").isNotNull() & F.col("a1").isNotNull()
    sums = items.agg(
        F.sum("a0").alias("revenue_1"),
        F.sum("a1").alias("revenue_2"),
        F.sum(F.when(F.col("a0").isNull(), F.col("a1"))).alias("new_items"),
        F.sum(F.when(F.col("a1").isNull(), -F.col("a0"))).alias("lost_items"),
        F.sum(F.when(both, F.col("a0"))).cast("double").alias("_a0"),
        F.sum(F.when(both, F.col("q0"))).alias("_q0"),
        F.sum(F.when(both, F.col("q1"))).alias("_q1"),
        F.sum(F.when(both, (F.col("p1") - F.col("p0")) * F.col("q1"))).alias("price_effect"),
        F.sum(F.when(both, F.col("p0") * (F.col("q1") - F.col("q0")))).alias("_quantity_effect"),
    )
    volume = F.col("_a0") * (F.col("_q1") / F.nullif(F.col("_q0"), F.lit(0.0)) - 1)
    zero = F.lit(0.0)
    return sums.select(
        *[F.coalesce(F.col(c).cast("double"), zero).alias(c) for c in ("revenue_1", "revenue_2", "new_items", "lost_items")],
        F.coalesce("price_effect", zero).alias("price_effect"),
        F.coalesce(volume, zero).alias("volume_effect"),
        F.coalesce(F.col("_quantity_effect") - volume, zero).alias("mix_effect"),
    )

