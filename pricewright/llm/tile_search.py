"""Nearest neighbours by largest cosine, as a block matrix join.

Queries and candidates are packed into blocks within their partitions. The
tiles of the block matrix are dealt to groups: a group holds one block of queries
and a bounded number of candidate blocks, so its memory is fixed while the
number of groups grows with both sides. In a tile, unit vectors quantised to int8
give every cosine with a bound on its error; pairs whose upper bound reaches the
query's current k-th best lower bound are computed again in double precision
and go into the query's heap of k. The heaps of a query's groups meet in a
ranked union with a map-side limit. The result is exact.

Defined cases: vectors that are null, zero or hold null or non-finite
components take no part, nor do rows with a null id; vectors of different
lengths are never compared; rows with the query's own id are not its candidates;
other rows that repeat an id each count; of query rows that repeat an id the one with
the smallest vector (compared by components) is asked; ties go to the smaller id; extra
columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import written

BLOCK = 1024
BLOCKS_PER_GROUP = 16
# Dimensions whose products of int8 values add up to less than 2^24, exact in float32.
EXACT = (1 << 24) // 127**2


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Rows with an id and a finite vector other than zero, as doubles."""
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(sound)


def packed(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of up to ``block`` rows with vectors of one length."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, vectors = map(np.concatenate, zip(*waiting.pop(dim), strict=True))
            columns = [pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["dim", "ids", "vectors"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            column = batch.column(1)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            lengths = np.diff(column.offsets.to_numpy())
            starts = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                for part in np.array_split(at, -(-len(at) // block)):
                    vectors = flat[starts[part][:, None] + np.arange(dim)]
                    waiting.setdefault(int(dim), []).append((ids[part], vectors))
                    if sum(len(i) for i, _ in waiting[dim]) >= block:
                        yield out(int(dim))
        for dim in list(waiting):
            yield out(dim)

    return rows.select("id", "v").mapInArrow(work, "dim int, ids binary, vectors binary")


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values (held as float32, see ``products``), scales and error lengths."""
    scale = np.abs(unit).max(axis=1) / 127
    values = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - values * scale[:, None]) ** 2).sum(axis=1))
    return values.astype(np.float32), scale, error


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact sums of products of int8 values: float32 holds those of ``EXACT`` dimensions, float64 their total."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT):
        out += a[:, at : at + EXACT] @ b[:, at : at + EXACT].T
    return out


def _block(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, dim)


def search_group(queries: tuple[np.ndarray, np.ndarray], candidates: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
    """The k best (score, -id) of each query among the candidate blocks."""
    q_ids, q = queries
    q_norm = np.sqrt((q * q).sum(axis=1))
    q_values, q_scale, q_error = quantised(q / q_norm[:, None])
    heaps: list[list[tuple[float, int]]] = [[] for _ in q_ids]
    for c_ids, c in candidates:
        c_norm = np.sqrt((c * c).sum(axis=1))
        c_values, c_scale, c_error = quantised(c / c_norm[:, None])
        near = products(q_values, c_values) * q_scale[:, None] * c_scale
        # |xy - x'y'| <= |x - x'| + |y - y'| + |x - x'||y - y'| for unit x, y; a little more for rounding.
        bound = q_error[:, None] + c_error + q_error[:, None] * c_error + 1e-9
        other = q_ids[:, None] != c_ids
        lower = np.where(other, near - bound, -np.inf)
        floor = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
        if len(c_ids) >= k:
            floor = np.maximum(floor, np.partition(lower, len(c_ids) - k, axis=1)[:, len(c_ids) - k])
        row, column = np.nonzero(other & (near + bound >= floor[:, None]))
        for at in range(0, len(row), 1 << 16):
            i, j = row[at : at + (1 << 16)], column[at : at + (1 << 16)]
            scores = (q[i] * c[j]).sum(axis=1) / (q_norm[i] * c_norm[j])
            for query, score, cid in zip(i.tolist(), scores.tolist(), c_ids[j].tolist(), strict=True):
                heap, entry = heaps[query], (score, -cid)
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
    return heaps


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", block: int = BLOCK, blocks_per_group: int = BLOCKS_PER_GROUP) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id`` and ``score`` of each query's k nearest rows.

    ``queries`` has the same columns as ``vectors``. The candidate blocks are
    counted first; both sides are then dealt to the cells (query block, range of
    candidate blocks).
    """
    candidate_blocks = written(packed(usable(vectors, id_col, vector), block).withColumn("block", F.monotonically_increasing_id()), "candidate_blocks")
    asked = usable(queries, id_col, vector).groupBy("id").agg(F.min("v").alias("v"))
    query_blocks = written(packed(asked, block).withColumn("block", F.monotonically_increasing_id()), "query_blocks")
    n_ranges = max(1, -(-candidate_blocks.count() // blocks_per_group))
    # A query block meets every range once; a candidate block meets every query block once.
    q = query_blocks.select("dim", F.col("block").alias("q_block"), "ids", "vectors").withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(n_ranges - 1))))
    c = candidate_blocks.withColumn("range", F.pmod(F.xxhash64("block"), F.lit(n_ranges)).cast("int")).join(q.select("dim", "q_block", "range"), ["dim", "range"]).select("q_block", "range", "dim", "ids", "vectors")

    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        blocks = [_block(x["ids"], x["vectors"], x["dim"]) for x in right.select(["dim", "ids", "vectors"]).to_pylist()]
        for x in left.select(["dim", "ids", "vectors"]).to_pylist():
            mine = _block(x["ids"], x["vectors"], x["dim"])
            heaps = search_group(mine, blocks, k)
            found += [(query, -cid, score) for query, heap in zip(mine[0].tolist(), heaps, strict=True) for score, cid in heap]
        columns = zip(*found, strict=True) if found else ([], [], [])
        return pa.table([pa.array(list(x), kind) for x, kind in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "id", "score"])

    left = q.select(F.col("q_block").alias("of_block"), F.col("range").alias("of_range"), "dim", "ids", "vectors")
    tiles = left.groupBy("of_block", "of_range").cogroup(c.groupBy("q_block", "range")).applyInArrow(work, "query_id long, id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return tiles.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
