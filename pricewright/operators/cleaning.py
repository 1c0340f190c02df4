"""Duplicate removal and a quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def dedupe_lines(lineitem: DataFrame) -> DataFrame:
    """First row per order and line number under an order over all columns.

    The row-number filter is pushed below the shuffle as a group limit, so a
    key with many copies sends one row per map task.
    """
    keys = ["l_orderkey", "l_linenumber"]
    rest = [F.col(c).asc_nulls_first() for c in sorted(lineitem.columns) if c not in keys]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*rest))
    return lineitem.withColumn("_n", first).filter(F.col("_n") == 1).drop("_n")


def quality_report(lineitem: DataFrame) -> DataFrame:
    """One row: null shares, surplus keys and values out of range.

    The checks need no shuffle and the key count needs only the two key
    columns, so they run apart; one aggregate would carry every check through
    the shuffle of the keys.
    """
    rows = F.count(F.lit(1))
    checks = lineitem.agg(
        rows.alias("rows"),
        *[
            (F.count_if(F.col(c).isNull()) / rows).alias(f"null_share_{c[2:]}")
            for c in ("l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
        ],
        F.count_if(~F.col("l_discount").between(0, 0.1)).alias("bad_discount"),
        F.count_if(F.col("l_quantity") <= 0).alias("bad_quantity"),
        F.count_if(F.col("l_extendedprice") <= 0).alias("bad_price"),
    )
    keys = lineitem.select("l_orderkey", "l_linenumber").distinct().agg(F.count(F.lit(1)).alias("keys"))
    both = checks.unionByName(keys, allowMissingColumns=True)
    return (
        both.agg(*[F.max(c).alias(c) for c in both.columns])
        .withColumn("surplus_keys", F.col("rows") - F.col("keys"))
        .drop("keys")
    )
