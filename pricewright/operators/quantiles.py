"""Exact quantiles of groups of any size.

The built-in ``percentile`` keeps every distinct value of a group in one
buffer. Here a first pass counts values per cell of a logarithmic grid, which
tells in which cells the wanted ranks lie; a second pass sorts only the rows of
those cells. Nothing is estimated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pricewright.functions import columns as C
from pricewright.operators.skew import join_on
from pricewright.session import written


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str | Column, probs: dict[str, float], is_written: bool = False
) -> DataFrame:
    """Interpolated quantiles per group, with the count of values ``n``.

    ``probs`` maps an output column to a probability. Nulls are not counted; a
    group of nulls has ``n`` 0 and null quantiles. The keys and values are read
    twice, so they are written first, unless ``df`` is a written table already.
    """
    v = F.col(value) if isinstance(value, str) else value
    values = df.select(*keys, v.cast("double").alias("_v"))
    values = (values if is_written else written(values, "values")).withColumn("_cell", C.price_step("_v"))

    # Pass 1: at most a few thousand cells per group, however many rows.
    cells = values.groupBy(*keys, "_cell").agg(F.count("_v").alias("_n"))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("bigint")))
    cells = cells.withColumn("n", F.sum("_n").over(group))
    wanted = cells.filter((F.col("n") == 0) | _any_rank_in(probs, F.col("_first"), F.col("_first") + F.col("_n")))
    # At most two cells per group and quantile; written, so that their true
    # size decides how they are joined.
    wanted = written(wanted.select(*keys, "_cell", "_first", "n"), "cells")
    empty = wanted.filter("n = 0").select(*keys, "n", *[F.lit(None).cast("double").alias(name) for name in probs])
    wanted = wanted.filter("n > 0")

    # Pass 2: the rows of the wanted cells, as counts per distinct value.
    cell = [*keys, "_cell"]
    inside = join_on(values, wanted.select(*cell), cell, "left_semi").groupBy(*cell, "_v").agg(F.count(F.lit(1)).alias("_m"))
    upto = Window.partitionBy(*cell).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_upto", F.sum("_m").over(upto))
    placed = join_on(inside, wanted, cell)
    start = F.col("_first") + F.col("_upto") - F.col("_m")
    placed = placed.withColumns({"_from": start, "_to": start + F.col("_m")})
    placed = placed.filter(_any_rank_in(probs, F.col("_from"), F.col("_to")))
    found = placed.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.sum(F.col("_v") * _weight(p, F.col("_from"), F.col("_to"))).alias(name) for name, p in probs.items()],
    )
    return found.unionByName(empty)


# A quantile lies between two ranks, counted from 0, and is the mean of the
# values there weighted by how near each is. These give the ranks and weights
# for a group of ``n`` values.


def _low(p: float) -> Column:
    return F.floor(F.lit(float(p)) * (F.col("n") - 1))


def _share(p: float) -> Column:
    return F.lit(float(p)) * (F.col("n") - 1) - _low(p)


def _any_rank_in(probs: dict[str, float], start: Column, end: Column) -> Column:
    """Whether ranks from ``start`` to before ``end`` take in a wanted one."""
    wanted = F.lit(False)
    for p in probs.values():
        wanted = wanted | ((_low(p) < end) & (_low(p) + F.when(_share(p) > 0, 1).otherwise(0) >= start))
    return wanted


def _weight(p: float, start: Column, end: Column) -> Column:
    """Weight of a value that fills the ranks from ``start`` to before ``end``;
    null, so that it is not added at all, when it has none."""
    def has(rank: Column) -> Column:
        return (rank >= start) & (rank < end)

    low, high = has(_low(p)), has(_low(p) + 1) & (_share(p) > 0)
    return F.when(low & high, 1.0).when(low, 1 - _share(p)).when(high, _share(p))


def group_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """The same by the built-in aggregate, for groups known to be small."""
    v = F.col(value)
    both = df.groupBy(*keys).agg(F.count(v).alias("n"), F.percentile(v, list(probs.values())).alias("_q"))
    return both.select(*keys, "n", *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)])
