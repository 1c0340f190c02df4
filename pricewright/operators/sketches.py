"""Stored sketches: written once per day, merged for any period without reading lines again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Registers as a power of two; the relative standard error is 1.04 / sqrt(2 ** LOG_REGISTERS).
LOG_REGISTERS = 12
ERROR = 1.04 / 2 ** (LOG_REGISTERS / 2)


def daily_sketches(rows: DataFrame, by: list[str], item: str, date: str) -> DataFrame:
    """One distinct-count sketch of ``item`` per ``by`` and day (``day``).

    A sketch has a bounded size, however many rows a group has, and is merged on
    the map side. Null items count for nothing; a group of nulls has an empty
    sketch. Rows without a date are a day of their own, null.
    """
    sketch = F.hll_sketch_agg(F.col(item), F.lit(LOG_REGISTERS))
    return rows.groupBy(*by, F.to_date(date).alias("day")).agg(sketch.alias("sketch"))


def merged_counts(sketches: DataFrame, by: list[str], period: Column, name: str = "period") -> DataFrame:
    """Estimated distinct items per ``by`` and ``period`` of the day, from daily sketches only."""
    merged = sketches.groupBy(*by, period.alias(name)).agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select(*by, name, F.hll_sketch_estimate("sketch").alias("items"))
