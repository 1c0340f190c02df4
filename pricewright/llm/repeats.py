"""Which keys of a chunk of documents occur in other chunks too.

A chunk is one row that packs many documents. Its distinct keys are sent to
buckets by value, 4 bytes each: together with the bucket that is a shortened
key, so now and then a key is flagged that does not repeat, which callers must
allow, and a key that repeats is always flagged. A key that a third of all documents
share is one entry per chunk, and buckets are even because keys are hashes. What
goes back to a chunk is a small number per key, compressed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import fresh_path
from .textbytes import byte_values, give_back, mix, prefix_sums, span_hashes, texts_of

BUCKET_KEYS = 2_000_000
CHUNK_BYTES = 1_000_000
KeysOf = Callable[[dict], np.ndarray]


def written_bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """Write ``df`` in buckets of ``key``, so that joins on it leave it where it is."""
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).option("path", fresh_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def chunk_ids() -> Iterator[int]:
    """Numbers that no other task gives out."""
    start = TaskContext.get().partitionId() << 32
    while True:
        yield start
        start += 1


def slices(batch: pa.RecordBatch, sizes: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``limit`` in total ``sizes``."""
    which = (np.cumsum(sizes) - sizes) // limit
    for part in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(which)) + 1):
        yield batch.slice(int(part[0]), len(part))


def packed_texts(docs: DataFrame, id_col: str, text: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Documents in chunks: ``chunk``, ``ids``, ``known`` (id isn't null), ``bounds``, ``texts`` (zstd), ``n_bytes``,
    and two hashes of each text, ``h1`` and ``h2``.

    The chunks are written, so every later pass sees the same ones.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, zstd = chunk_ids(), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.diff(texts_of(batch.column(1))[1])
            for part in slices(batch, sizes, chunk_bytes):
                raw, bounds = texts_of(part.column(1))
                ids = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                known = part.column(0).is_valid().to_numpy(zero_copy_only=False)
                values = byte_values(raw)
                h1 = span_hashes(prefix_sums(values), bounds[:-1], bounds[1:])
                h2 = span_hashes(prefix_sums(mix(values)), bounds[:-1], bounds[1:]) ^ np.diff(bounds).astype(np.uint64)
                blobs = (ids.tobytes(), known.tobytes(), bounds.tobytes(), zstd.compress(raw.tobytes()), h1.tobytes(), h2.tobytes())
                columns = [pa.array([next(numbers)], pa.int64()), *[pa.array([x], pa.binary()) for x in blobs], pa.array([len(raw)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "known", "bounds", "texts", "h1", "h2", "n_bytes"])

    packed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    schema = "chunk long, ids binary, known binary, bounds binary, texts binary, h1 binary, h2 binary, n_bytes long"
    return written_bucketed(packed.mapInArrow(work, schema), "chunk", "packed_texts")


def known_ids(chunk: dict) -> np.ndarray:
    """A chunk's ids, the largest number for null."""
    return np.where(np.frombuffer(chunk["known"], bool), np.frombuffer(chunk["ids"], np.int64), np.iinfo(np.int64).max)


def unpacked(chunk: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids (the largest number for null), known, bytes and bounds of a chunk."""
    ids, known = known_ids(chunk), np.frombuffer(chunk["known"], bool)
    raw = np.frombuffer(zstandard.decompress(chunk["texts"]) if chunk["n_bytes"] else b"", np.uint8)
    return ids, known, raw, np.frombuffer(chunk["bounds"], np.int64)


def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The chunks of a task one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
    give_back()


def _spread(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, their buckets (ranges of keys), and where buckets start."""
    keys = np.unique(keys)
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    return keys, bucket, np.flatnonzero(np.diff(bucket, prepend=-1))


def with_flags(chunks: DataFrame, columns: list[str], keys_of: KeysOf, n_keys: int) -> tuple[DataFrame, int]:
    """``chunks`` with the answers of the buckets as column ``flags``, for ``heats``.

    ``keys_of`` makes a chunk's keys, which must be evenly spread over 64 bits, from
    its ``columns``, the same ones every time. ``n_keys`` is a rough count of all keys.
    """
    spark = chunks.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_keys // BUCKET_KEYS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunk_rows(batches):
            keys, bucket, starts = _spread(keys_of(chunk), buckets)
            short = (keys * np.uint64(buckets) >> np.uint64(32)).astype(np.uint32)
            blobs = [part.tobytes() for part in np.split(short, starts[1:])] if len(keys) else []
            columns = [pa.array(bucket[starts], pa.int64()), pa.array([chunk["chunk"]] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "chunk", "keys"])

    def answer(table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()]
        every = np.concatenate(blobs)
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        same = ordered[1:] == ordered[:-1]
        starts = np.flatnonzero(np.concatenate(([True], ~same)))
        counts = np.diff(np.append(starts, len(every)))
        # 0: in one chunk only; else how often it was halved to come down to one chunk.
        heat = np.zeros(len(every), np.uint8)
        heat[order] = np.repeat(np.log2(counts).astype(np.uint8) + (counts > 1), counts)
        cuts = np.cumsum([len(x) for x in blobs])[:-1]
        packed = [zstandard.compress(x.tobytes(), 1) for x in np.split(heat, cuts)]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "heat": pa.array(packed, pa.binary())})

    sent = chunks.select("chunk", *columns).mapInArrow(send, "bucket long, chunk long, keys binary")
    heat = sent.groupBy("bucket").applyInArrow(answer, "chunk long, bucket long, heat binary")
    flags = heat.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "heat"))).alias("flags"))
    return chunks.join(flags, "chunk", "left"), buckets


def heats(chunk: dict, keys: np.ndarray, buckets: int) -> np.ndarray:
    """For each of a chunk's keys: 0 if no other chunk has it, else about log2 of the number of chunks, plus 1."""
    if not len(keys):
        return np.zeros(0, np.uint8)
    distinct = np.unique(keys)
    heat = np.concatenate([np.frombuffer(zstandard.decompress(x["heat"]), np.uint8) for x in chunk["flags"]])
    return heat[np.searchsorted(distinct, keys)]
