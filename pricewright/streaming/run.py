"""Run a stream over what has arrived, into a table in the shared folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pricewright.session import fresh_path
from pricewright.sources.sinks import write_batch
from pricewright.streaming.chain import PreviousValues

# Rows of a stored table that one run takes.
SLICE_ROWS = 2_000_000_000


class LateRowsError(RuntimeError):
    """A stream dropped rows that its caller did not expect to be late."""


@dataclass
class StreamTable:
    """Where a stream writes and keeps its position, and what its runs saw.

    ``dropped_groups`` is Spark's own count of what stateful operators dropped
    as late, taken after partial aggregation. Unless ``expect_late``, a run
    that drops anything raises. ``late_rows`` counts rows; see ``arrive``.
    """

    spark: SparkSession
    label: str
    root: str = ""
    expect_late: bool = False
    input_rows: int = 0
    dropped_groups: int = 0
    late_rows: int = 0
    watermark: str = ""

    def __post_init__(self):
        self.root = self.root or fresh_path(self.spark, self.label)

    @property
    def path(self) -> str:
        return f"{self.root}/table"

    @property
    def arrivals(self) -> str:
        return f"{self.root}/arrivals"

    @property
    def late_path(self) -> str:
        return f"{self.root}/late"

    def append(self, stream: DataFrame | PreviousValues) -> StreamTable:
        """Process what is there and stop. The file sink's log makes a batch
        count once even when it is written again after a failure; chained
        values have one directory per batch, which a replay overwrites."""
        if isinstance(stream, PreviousValues):
            late: dict[int, int] = {}

            def chain(df: DataFrame, batch: int) -> None:
                late[batch], self.watermark = stream.batch(self.spark, df, batch, self.root)

            return self._run(stream.events.writeStream.foreachBatch(chain), late)
        return self._run(stream.writeStream.format("parquet").option("path", self.path).outputMode("append"))

    def append_batches(self, stream: DataFrame) -> StreamTable:
        """The same with one directory per batch, which a replay overwrites."""
        return self._run(stream.writeStream.foreachBatch(lambda df, batch: write_batch(df, batch, self.path)))

    def arrive(self, rows: DataFrame, build: Callable[[], DataFrame | PreviousValues], closes: Column | None = None) -> StreamTable:
        """Add ``rows`` to the arrivals folder and run ``build()`` over it.

        ``closes`` tells up to which time a row counts (its own time, or the end
        of its window). Rows whose time the watermark had passed when they came
        are what the stream drops; they are counted one by one and kept in
        ``late_path``.
        """
        folder = fresh_path(self.spark, f"{self.label}-rows")
        rows.write.parquet(folder)
        rows = self.spark.read.schema(rows.schema).parquet(folder)
        if closes is not None and self.watermark:
            late = rows.where(closes.cast("timestamp") <= F.lit(self.watermark).cast("timestamp"))
            late.write.mode("append").parquet(self.late_path)
            self.late_rows += late.count()
        rows.write.mode("append").parquet(self.arrivals)
        return self.append(build())

    def append_in_time_order(self, events: DataFrame, build: Callable[[str], DataFrame | PreviousValues], rows: int = SLICE_ROWS, time: str = "ts") -> StreamTable:
        """Feed a stored table to ``build(folder)``, oldest rows first.

        A table's files hold rows of any time, and a stream that takes some files
        before others sees the rest as late. Here the table is cut into slices of
        about ``rows`` rows by time, which arrive one after another. Rows
        without a time come first.
        """
        slices = max(1, -(-events.count() // rows))
        seconds = F.col(time).cast("timestamp").cast("double")
        cuts = events.agg(F.percentile_approx(seconds, [i / slices for i in range(1, slices)], 10_000)).first()[0] if slices > 1 else []
        number = F.lit(0)
        for cut in sorted(set(cuts or [])):
            number = number + F.coalesce((seconds > cut).cast("int"), F.lit(0))
        staged = fresh_path(self.spark, f"{self.label}-slices")
        events.withColumn("_slice", number).write.partitionBy("_slice").parquet(staged)
        for i in range(len(set(cuts or [])) + 1):
            part = self.spark.read.parquet(staged).where(F.col("_slice") == i).drop("_slice")
            part.write.mode("append").parquet(self.arrivals)
            self.append(build(self.arrivals))
        return self

    def _run(self, writer, late: dict[int, int] | None = None) -> StreamTable:
        """``late`` has the rows that a batch function found late, by batch."""
        query = writer.option("checkpointLocation", f"{self.root}/position").trigger(availableNow=True).start()
        last, dropped = -1, 0

        def drain() -> None:
            """Add the reports that came since; Spark keeps the latest hundred."""
            nonlocal last, dropped
            for report in query.recentProgress:
                if report.batchId > last:
                    last = report.batchId
                    self.input_rows += report.numInputRows
                    dropped += sum(s.numRowsDroppedByWatermark for s in report.stateOperators)
                    self.watermark = report.eventTime.get("watermark", self.watermark)

        try:
            while not query.awaitTermination(1):
                drain()
            drain()
        finally:
            query.stop()
        dropped += sum((late or {}).values())
        self.dropped_groups += dropped
        if dropped and not self.expect_late:
            raise LateRowsError(f"{self.label}: {dropped} rows or groups came after the watermark had passed them")
        return self

    def read(self, stream: DataFrame | PreviousValues) -> DataFrame:
        return self.spark.read.schema(stream.schema).parquet(self.path).select(*stream.schema.names)


def stream_table(spark: SparkSession, path: str, events: DataFrame, build: Callable[[str], DataFrame | PreviousValues], label: str, rows: int = SLICE_ROWS) -> DataFrame:
    """Run ``build`` over the stored table at ``path`` and return what it emits.

    Up to ``rows`` rows are one batch, in which nothing is late, read where the
    table lies; more are fed in time order.
    """
    table = StreamTable(spark, label)
    if events.count() <= rows:
        stream = build(path)
        return table.append(stream).read(stream)
    return table.append_in_time_order(events, build, rows).read(build(table.arrivals))

