"""Ways to keep one heavy key out of one task.

A window or a grouped median needs all rows of a key together. That is right
for the many keys with few rows and wrong for a key with a third of the table.
``by_heat`` counts the rows per key and runs the plain form on light keys and
a split form on heavy ones. Split forms cut a key's rows into cells along the
order column, work within a cell, and bring in what lies before it from a
table of cell totals (``with_carry``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from pricewright.session import written

# More rows of one key than a task should sort or hold. A table of N rows has
# fewer than N / HOT_ROWS such keys, which is what bounds the broadcasts below.
HOT_ROWS = 2_000_000


def hot_keys(df: DataFrame, keys: list[str], rows: int = HOT_ROWS, stands_for: str | None = None) -> DataFrame:
    """Keys with more than ``rows`` rows; counted on the map side first.

    ``stands_for`` is a column with the number of rows that each row was made of.
    """
    n = F.sum(stands_for) if stands_for else F.count(F.lit(1))
    return df.groupBy(*keys).agg(n.alias("count")).filter(F.col("count") > rows).select(*keys)


def join_on(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on equal ``names``, with null equal to null; keeps the left keys."""
    renamed = right.withColumnsRenamed({n: f"_r_{n}" for n in names})
    same = [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names]
    joined = left.join(renamed, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{n}" for n in names])


def by_heat(
    df: DataFrame,
    keys: list[str],
    plain: Callable[[DataFrame], DataFrame],
    split: Callable[[DataFrame], DataFrame],
    rows: int = HOT_ROWS,
    stands_for: str | None = None,
) -> DataFrame:
    """``plain`` over the light keys of ``df``, ``split`` over the heavy ones.

    Runs one count over the key columns. With no heavy key the result is just
    ``plain(df)``.
    """
    hot = written(hot_keys(df, keys, rows, stands_for), "hot-keys")  # its true size decides how it is joined
    if hot.isEmpty():
        return plain(df)
    light = join_on(df, hot, keys, "left_anti")
    heavy = join_on(df, hot, keys, "left_semi")
    return plain(light).unionByName(split(heavy))


def in_cells(df: DataFrame, order: list[Column | str], cell: str) -> DataFrame:
    """Cut ``df`` into cells of about equal size that follow each other in ``order``.

    The cells are range partitions, so rows of one key and instant are cut too
    as long as ``order`` tells them apart. Written, so that the cut stays.
    """
    return written(df.repartitionByRange(*order).withColumn(cell, F.spark_partition_id()), "cells")


def with_carry(
    df: DataFrame,
    keys: list[str],
    cell: str,
    carries: dict[str, tuple[Column, Callable[[Column], Column]]],
) -> DataFrame:
    """Add to every row what the earlier cells of its key come to.

    ``carries`` maps a column name to the aggregate that sums up one cell and
    the aggregate that merges cells. Only cell totals meet in one task.
    """
    totals = df.groupBy(*keys, cell).agg(*[agg.alias(name) for name, (agg, _) in carries.items()])
    earlier = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    merged = [merge(F.col(name)).over(earlier).alias(name) for name, (_, merge) in carries.items()]
    carry = totals.select(*keys, cell, *merged)
    return join_on(df, carry, [*keys, cell], "left")


def latest(col: Column) -> Column:
    """Merge for ``with_carry``: the last cell that has a value."""
    return F.last(col, ignorenulls=True)


def joined_back(df: DataFrame, stats: DataFrame, keys: list[str], count: str, rows: int = HOT_ROWS) -> DataFrame:
    """Join one-row-per-key ``stats`` to the rows they came from.

    ``count`` is the stats column with the rows per key. Heavy keys are few,
    so their stats are small enough to be broadcast, and their rows then stay
    where they are; should they not be, adaptive execution splits the join.
    """
    stats = written(stats, "stats")
    hot = written(stats.filter(F.col(count) > rows), "hot-stats")
    light = join_on(df, hot, keys, "left_anti")
    return join_on(light, stats, keys).unionByName(join_on(df, hot, keys))


def running_total(df: DataFrame, order: list[Column], value: str, running: str, total: str) -> DataFrame:
    """Cumulative sum of ``value`` over the whole table in ``order``, and its total.

    Rows are range-partitioned on ``order``, so equal shares of the table
    follow each other and no task sees more than its share. The chunks are
    written once, since both the chunk totals and the rows must use the same
    cut. ``order`` must be total for a repeatable answer.
    """
    chunks = written(df.repartitionByRange(*order).withColumn("_chunk", F.spark_partition_id()), "chunks")
    everything = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shuffle partition.
    sums = (
        chunks.groupBy("_chunk")
        .agg(F.sum(value).alias("_sum"))
        .select(
            "_chunk",
            F.sum("_sum").over(earlier).alias("_earlier"),
            F.sum("_sum").over(everything).alias(total),
        )
    )
    inside = Window.partitionBy("_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum(value).over(inside)
    return (
        chunks.join(F.broadcast(sums), "_chunk")
        .withColumn(running, own + F.coalesce("_earlier", F.lit(0)))
        .drop("_chunk", "_earlier")
    )
