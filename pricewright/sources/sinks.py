"""Table sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def write_by_year(df: DataFrame, path: str, date: str = "l_shipdate", mode: str = "error") -> None:
    """Write ``df`` partitioned by the year of ``date`` (column ``y``).

    The rebalance hint shuffles by year so that a task writes few files, and
    lets adaptive execution split a year that holds most of the rows over
    many tasks and merge the thin ones.
    """
    (
        df.withColumn("y", F.year(date))
        .hint("rebalance", F.col("y"))
        .write.mode(mode)
        .partitionBy("y")
        .parquet(path)
    )


def write_batch(df: DataFrame, batch_id: int, root: str, partition_by: list[str | Column] | None = None) -> None:
    """Write one micro-batch into its own directory.

    A replayed batch has the same id and overwrites what the failed attempt
    left, so the table holds every batch once.
    """
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root}/batch={batch_id}")
