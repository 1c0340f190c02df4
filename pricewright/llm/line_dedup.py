"""Line dedup against levelled sorted runs of line hashes.

A run is a bucketed table of distinct 128-bit line hashes, sorted within its
buckets. A batch of documents is reduced to its own distinct hashes with their
smallest document, merge-anti-joined with the runs, and what is new becomes a
run of its own. When a level holds ``fanout`` runs they are merged into one run
of the next level, so a hash is rewritten a logarithmic number of times.

Batches are taken in the order of the documents' ids, so the first batch that
holds a key also holds its smallest document.

Scale: hashes are grouped on the map side first, so one line in a third of all
documents is one row per task; a run is read as buckets, without a shuffle.
Everything is DataFrame code; the driver only knows the paths of the runs.

Defined cases: a null text is one empty line; a null id counts as larger than
every other id, and all null ids as one document; rows that repeat an id count
as one document; columns other than id and text pass through; an empty table
gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import fresh_path, written

BLANK_CHARS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LAST_ID = (1 << 63) - 1
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(BLANK_CHARS)), UPPER, UPPER.lower())


class LineRuns:
    """The hashes of all lines seen so far, as runs on levels."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark = spark
        self.fanout = fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, hashes: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            hashes.repartition(self.buckets, *HASH)
            .write.format("parquet")
            .bucketBy(self.buckets, *HASH)
            .sortBy(*HASH)
            .option("path", fresh_path(self.spark, name))
            .saveAsTable(name)
        )
        return name

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def new(self, hashes: DataFrame) -> DataFrame:
        """Rows of ``hashes`` that no run holds."""
        for name in self.runs():
            hashes = hashes.join(self.spark.table(name).hint("merge"), HASH, "left_anti")
        return hashes

    def add(self, hashes: DataFrame) -> None:
        """Add distinct hashes that no run holds, then compact full levels."""
        name, level = self._write(hashes.select(*HASH)), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(name)
            if len(self.levels[level]) < self.fanout:
                return
            merged = self.spark.table(self.levels[level][0])
            for other in self.levels[level][1:]:
                merged = merged.unionByName(self.spark.table(other))
            name = self._write(merged)
            for old in self.levels[level]:
                self.spark.sql(f"DROP TABLE {old}")
            self.levels[level] = []
            level += 1

    def close(self) -> None:
        for name in self.runs():
            self.spark.sql(f"DROP TABLE {name}")
        self.levels = []


def _batch_bounds(docs: DataFrame, batches: int) -> list[int]:
    """Ids that cut the documents into batches of about equal counts."""
    cuts = docs.agg(F.percentile_approx("__id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    return sorted(set(cuts or []))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    min_chars: int = 10,
    batches: int = 4,
    fanout: int = 2,
) -> DataFrame:
    """Drop lines whose key stands in a document with a smaller id.

    Returns the input columns with ``text`` replaced by the lines that stay,
    joined by line feeds, plus ``n_lines`` and ``n_dropped``.
    """
    spark = docs.sparkSession
    extra = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    whole = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(
        *extra,
        F.coalesce(F.col(id_col), F.lit(LAST_ID)).cast("long").alias("__id"),
        F.xxhash64(whole).alias("__text_hash"),
    )
    cuts = _batch_bounds(named.select("__id"), batches)
    batch = F.lit(0)
    for cut in cuts:
        batch = batch + (F.col("__id") > cut).cast("int")
    lines = (
        named.select("__id", "__text_hash", batch.alias("batch"), F.posexplode(F.split(whole, "\n")).alias("pos", "line"))
        .withColumn("line", line_key(F.col("line")))
        .where(F.char_length("line") >= min_chars)
        .select("batch", "__id", "__text_hash", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))
    )
    path = fresh_path(spark, "lines")
    lines.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(lines.schema).parquet(path)

    runs = LineRuns(spark, fanout)
    dropped = None
    for number in range(len(cuts) + 1):
        of_batch = lines.where(F.col("batch") == number).drop("batch")
        firsts = of_batch.groupBy(*HASH).agg(F.min("__id").alias("owner"))
        new = written(runs.new(firsts), "new_lines") if number else written(firsts, "new_lines")
        if number < len(cuts):
            runs.add(new)
        gone = of_batch.join(new, HASH, "left").where("owner IS NULL OR owner < __id").select("__id", "__text_hash", "pos")
        dropped = gone if dropped is None else dropped.unionByName(gone)
    gone = written(dropped.groupBy("__id", "__text_hash").agg(F.collect_set("pos").alias("__gone")), "dropped_lines")
    runs.close()
    joined = named.join(gone, ["__id", "__text_hash"], "left").withColumn("__lines", F.split(whole, "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    kept = F.when(F.col("__gone").isNull(), whole).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(F.col("__lines"), i)), "\n")
    )
    return joined.select(
        *[kept.alias(c) if c == text else F.col(c) for c in extra],
        F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
