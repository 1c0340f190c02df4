"""Session defaults, and the shared folder that intermediate tables go to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Stream state on local disk with changelogs in the checkpoint, not in the heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Merge sessions of one user on the map side, before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}

PARTITION_BYTES = 128 << 20

_local_dirs: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def build_session(app: str = "pricewright", master: str | None = None, input_bytes: int = 0, **conf) -> SparkSession:
    """A session with the defaults above; ``conf`` keys use ``__`` for dots.

    ``input_bytes`` is about what the largest query reads: shuffles get a
    partition for each 128 MB of it (200 at least), which adaptive execution
    merges where less is shuffled. On a cluster, give it or set the number
    of shuffle partitions.
    """
    if input_bytes:
        conf = {"spark__sql__shuffle__partitions": max(200, -(-input_bytes // PARTITION_BYTES))} | conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it.

    Only a local session may fall back to a temporary folder: on a cluster an
    executor's own disk is lost with the executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="pricewright-")
    return _local_dirs[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_intermediates(spark: SparkSession) -> int:
    """Delete what this session wrote under ``fresh_path``; returns how many paths were there.

    DataFrames that read those paths must be done with.
    """
    paths = _made.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return sum(bool(p.getFileSystem(conf).delete(p, True)) for p in map(hadoop.Path, paths))


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, fixes the rows for every later branch, and gives
    Catalyst the true size, so that it broadcasts the table only when that is
    below ``spark.sql.autoBroadcastJoinThreshold`` and sort-merges otherwise.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
