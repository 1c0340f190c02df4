"""Suffix-array dedup: bytes of strings that also start in a smaller document.

``passages`` deals segments that may repeat to shards. A shard builds the suffix
array of its distinct segments (Larsson-Sadakane refinement in numpy) and their
common prefixes (Kasai); suffixes in a row that share a window form a class,
and a class knows its smallest document. Where an anchor is so frequent that
several shards hold it, their windows are merged by binary search.

Costs follow the input: anchors are sent as 4 bytes, about one per 11 bytes of
text; segments are sent only where an anchor repeats. Long grams keep anchors
rare that repeat by chance, whose number grows faster than the text.

Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing
names are as ``passages`` defines them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .passages import byte_units, remove_repeats
from .suffix_arrays import common_prefixes, suffix_array

WINDOW = 50
GRAM = 30


def solver(window: int):
    def solve(values: np.ndarray, bounds: np.ndarray, n_windows: np.ndarray, owners: np.ndarray, groups: np.ndarray | None = None) -> np.ndarray:
        order, rank = suffix_array(values, bounds)
        shared = common_prefixes(values, bounds, order, rank, window)
        segment = np.repeat(np.arange(len(owners)), np.diff(bounds))
        place = np.arange(len(values)) - bounds[segment]
        is_window = place < n_windows[segment]
        owner = np.where(is_window, owners[segment], np.iinfo(np.int64).max)[order]
        starts = np.flatnonzero(np.concatenate(([True], shared[1:] < window)))
        least = np.repeat(np.minimum.reduceat(owner, starts), np.diff(np.append(starts, len(order))))
        return least[rank[is_window]]

    return solve


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, **sizes) -> DataFrame:
    """Per row: the id, ``n_bytes``, ``n_removed``, ``n_spans`` and the bytes ``kept``."""
    out = remove_repeats(docs, byte_units, window, gram, solver(window), False, id_col, text, **sizes)
    return out.withColumnRenamed("n_units", "n_bytes")
