"""Exact counts of the distinct terms of a batch of texts, by length-bucketed packing.

A term is a span of bytes without a zero byte. Terms of up to 8 bytes become one
big-endian uint64 word, those of up to 16 bytes two, and are sorted by radix
passes over 16-bit digits; equal neighbours are a run, and runs are counted.
Longer terms go to a bucket for each power of two of their length, as rows of
fixed width that are sorted by their bytes, so a bucket takes at most twice the
bytes of its terms. Nothing is hashed: equal runs are equal terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

SHORT = 16


@dataclass
class Counts:
    """Distinct (group, term) with occurrences ``n`` and texts ``n_texts``; a long
    term has its bytes in ``long``, else ``long`` is None and the words hold it."""

    group: np.ndarray
    high: np.ndarray
    low: np.ndarray
    long: list[bytes] | None
    n: np.ndarray
    n_texts: np.ndarray

    def columns(self) -> list[pa.Array]:
        """``high``, ``low``, ``long``, ``n``, ``n_texts`` as Arrow arrays."""
        longs = pa.nulls(len(self.n), pa.binary()) if self.long is None else pa.array(self.long, pa.binary())
        words = [pa.array(x.view(np.int64), pa.int64()) for x in (self.high, self.low)]
        return [*words, longs, pa.array(self.n, pa.int64()), pa.array(self.n_texts, pa.int64())]


COLUMNS = "high long, low long, long binary, n long, n_texts long"
TERM = ["high", "low", "long"]


def term_text() -> Column:
    """The term of a row with the columns above, as text; packed words end in zero bytes."""
    def word(name: str) -> Column:
        return F.lpad(F.hex(F.col(name)), 16, "0")

    packed = F.rtrim(F.unhex(F.concat(word("high"), word("low"))).cast("string"), F.lit("\0"))
    return F.coalesce(F.col("long").cast("string"), packed)


def runs_of(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the maximal runs of ``inside`` that stay in one text."""
    if not len(inside):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    edge = np.zeros(len(inside) + 1, bool)
    edge[bounds] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def _radix_order(order: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """``order`` sorted by ``words`` (most significant first), equal ones as they were."""
    for word in reversed(words):
        for shift in range(0, 64, 16):
            digit = ((word >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _packed(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The up to 8 bytes of each span as a big-endian word."""
    word = raw[starts[:, None] + np.arange(8)].view(">u8").astype(np.uint64).ravel()
    cut = (8 * (8 - np.clip(lengths, 0, 8))).astype(np.uint64)
    kept = np.where(cut < 64, ~np.uint64(0) << np.minimum(cut, np.uint64(63)), np.uint64(0))
    return word & kept


def _runs(order: np.ndarray, keys: list[np.ndarray], text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First members, sizes and numbers of different texts of the runs of equal keys."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        ordered = key[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    other = text[order]
    fresh = new.copy()
    fresh[1:] |= other[1:] != other[:-1]
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order))), np.add.reduceat(fresh.astype(np.int64), first)


def counted(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, group: np.ndarray) -> Iterator[Counts]:
    """Counts of the spans, a piece for each bucket. ``text`` (rising) and ``group`` are each span's."""
    raw = np.concatenate((raw, np.zeros(SHORT, np.uint8)))
    lengths = ends - starts
    groups = group.astype(np.uint64)
    for of in (np.flatnonzero(lengths <= 8), np.flatnonzero((lengths > 8) & (lengths <= SHORT))):
        if not len(of):
            continue
        high = _packed(raw, starts[of], lengths[of])
        two = lengths[of[0]] > 8
        low = _packed(raw, starts[of] + 8, lengths[of] - 8) if two else np.zeros(len(of), np.uint64)
        keys = [groups[of], high, low] if two else [groups[of], high]
        first, n, n_texts = _runs(_radix_order(np.arange(len(of)), keys), keys, text[of])
        yield Counts(group[of[first]], high[first], low[first], None, n, n_texts)
    widths = 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64)
    for width in np.unique(widths[lengths > SHORT]):
        of = np.flatnonzero((widths == width) & (lengths > SHORT))
        table = np.zeros((len(of), width), np.uint8)
        row = np.repeat(np.arange(len(of)), lengths[of])
        column = np.arange(len(row)) - np.repeat(np.cumsum(lengths[of]) - lengths[of], lengths[of])
        table[row, column] = raw[np.repeat(starts[of], lengths[of]) + column]
        terms = table.view(f"S{width}").ravel()
        order = np.argsort(terms, kind="stable")
        order = _radix_order(order, [groups[of]])
        first, n, n_texts = _runs(order, [groups[of], terms], text[of])
        none = np.zeros(len(first), np.uint64)
        yield Counts(group[of[first]], none, none, terms[first].tolist(), n, n_texts)
