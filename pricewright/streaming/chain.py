"""Values chained from event to event, batch by batch.

A stateful operator keeps a key's rows of a batch in one group. Here a batch is
an ordinary table: Spark's windows chain its values, heavy users in cells, and
what a batch leaves to the next is a table with one row for each user and the
events that the watermark has not passed.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from pricewright.operators import skew
from pricewright.sources.sinks import write_batch

EVENT = ["event_id", "user_id", "ts", "value"]
HELD = "event_id bigint, user_id bigint, ts timestamp, value double, fresh boolean, mark timestamp"
# Kept values come before events; the value settles ties, as null before numbers.
ORDER = ["fresh", "ts", "event_id", "value"]


def chained(rows: DataFrame, hot_rows: int) -> DataFrame:
    """``rows`` with ``previous``, the value of the user's row before it in ``ORDER``."""

    def plain(df: DataFrame) -> DataFrame:
        before = F.lag("value").over(Window.partitionBy("user_id").orderBy(*ORDER))
        return df.withColumn("previous", before)

    def split(df: DataFrame) -> DataFrame:
        cells = skew.in_cells(df, ["user_id", *ORDER], "cell")
        # As a struct, so that a last value that is null counts as one.
        carried = skew.with_carry(cells, ["user_id"], "cell", {"carried": (F.max(F.struct(*ORDER)), skew.latest)})
        inside = Window.partitionBy("user_id", "cell").orderBy(*ORDER)
        before = F.when(F.row_number().over(inside) == 1, F.col("carried.value")).otherwise(F.lag("value").over(inside))
        return carried.withColumn("previous", before).drop("cell", "carried")

    return skew.by_heat(rows, ["user_id"], plain, split, hot_rows)


@dataclass
class PreviousValues:
    """A stream of events with previous values, for ``StreamTable.append``."""

    events: DataFrame
    delay: str
    forget_days: int | None
    hot_rows: int

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL("event_id bigint, user_id bigint, ts timestamp, value double, previous double")

    def batch(self, spark: SparkSession, df: DataFrame, number: int, root: str) -> tuple[int, str]:
        """Write what batch ``number`` emits and what it leaves; returns how many
        rows were late and the watermark now.

        Both overwrite what a failed attempt left, and the state before stays
        until the next batch, so a batch may run again.
        """
        # The stream's rows are read once.
        write_batch(df, number, f"{root}/came")
        came = spark.read.schema(df.schema).parquet(f"{root}/came/batch={number}").where("ts IS NOT NULL")
        state = spark.read.schema(HELD).parquet(f"{root}/state/batch={number - 1}") if number else spark.createDataFrame([], HELD)
        old = state.agg(F.max("mark").alias("old"))
        newest = came.agg((F.max("ts") - F.expr(f"interval {self.delay}")).alias("new"))
        marks = old.crossJoin(newest).select(F.unix_micros("old").alias("old"), F.unix_micros(F.greatest("old", "new")).alias("new")).first()
        mark = F.timestamp_micros(F.lit(marks["new"]).cast("long"))
        late = 0
        if marks["old"] is not None:
            passed = F.unix_micros("ts") <= marks["old"]
            late = came.where(passed).count()
            came = came.where(~passed)
        held = came.select(*EVENT, F.lit(True).alias("fresh")).unionByName(state.drop("mark"))
        waiting = F.col("fresh") & (F.col("ts") > mark)
        ready = held.where(~waiting)
        out = chained(ready, self.hot_rows).where("fresh").select(*EVENT, "previous")
        write_batch(out, number, f"{root}/table")
        last = ready.groupBy("user_id").agg(F.max(F.struct(*ORDER)).alias("last"))
        last = last.select("last.event_id", "user_id", "last.ts", "last.value", F.lit(False).alias("fresh"))
        if self.forget_days is not None:
            last = last.where(F.col("ts") > mark - F.expr(f"interval {self.forget_days} days"))
        write_batch(last.unionByName(held.where(waiting)).withColumn("mark", mark), number, f"{root}/state")
        _remove(spark, f"{root}/came/batch={number}", f"{root}/state/batch={number - 2}")
        now = "" if marks["new"] is None else (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=marks["new"])).isoformat() + "Z"
        return late, now


def _remove(spark: SparkSession, *paths: str) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in map(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(conf).delete(path, True)
