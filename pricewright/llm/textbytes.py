"""Vectorised work on the bytes of a batch of texts, for use inside tasks.

A batch is one uint8 array with the texts one after another and an int64 array
of bounds. Hashes are polynomials, taken from prefix sums, so that every gram of
a batch costs a few array operations. Modulo 2^64 alone, strings such as the two
Thue-Morse sequences collide for any base; a second polynomial modulo the prime
2^31 - 1 tells them apart, and both are mixed into 64 bits.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Text that is worked on at once where arrays of eight bytes for each of its bytes would add up.
PIECE_BYTES = 1 << 17

# Bytes that separate words.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
# The prime field, with a base of its own.
_P = (1 << 31) - 1
_Q = 1_532_864_291
_Q_INV = pow(_Q, -1, _P)
_BYTES = np.random.default_rng(20_24).integers(1, 1 << 64, 256, dtype=np.uint64)


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def text_pieces(raw: np.ndarray, bounds: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A batch as several of about ``limit`` bytes, of whole texts; an empty batch is one piece."""
    cuts = np.flatnonzero(np.diff(bounds[:-1] // limit)) + 1
    for first, stop in zip([0, *cuts], [*cuts, len(bounds) - 1], strict=True):
        yield raw[bounds[first] : bounds[stop]], bounds[first : stop + 1] - bounds[first]


def give_back() -> None:
    """Return the free memory of a task that is done to the system: its worker lives on, beside the JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_kept: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers, kept for the next call."""
    have = _kept.get(int(base))
    if have is None or len(have) < n:
        have = np.full(n, base, np.uint64)
        have[:1] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        _kept[int(base)] = have
    return have[:n]


def _fold(x: np.ndarray) -> np.ndarray:
    """A smaller number that is equal modulo ``_P``."""
    return (x & np.uint64(_P)) + (x >> np.uint64(31))


def _field_powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers modulo ``_P``, by doubling, kept for the next call."""
    have = _kept.get(-base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < n:
            have = np.concatenate((have, have * np.uint64(pow(base, len(have), _P)) % np.uint64(_P)))
        _kept[-base] = have
    return have[:n]


@dataclass
class Sums:
    """Prefix sums of values times rising powers, modulo 2^64 and in the prime field (unreduced)."""

    ring: np.ndarray
    field: np.ndarray

    def __len__(self) -> int:
        return len(self.ring)


def prefix_sums(values: np.ndarray) -> Sums:
    """Of up to 2^32 values."""
    out = Sums(np.zeros(len(values) + 1, np.uint64), np.zeros(len(values) + 1, np.uint64))
    with np.errstate(over="ignore"):
        np.cumsum(values * _powers(_R, len(values)), out=out.ring[1:])
    np.cumsum(_fold((values >> np.uint64(33)) * _field_powers(_Q, len(values))), out=out.field[1:])
    return out


def byte_values(raw: np.ndarray) -> np.ndarray:
    return _BYTES[raw]


def _hashes(ring: np.ndarray, field: np.ndarray, ring_scale: np.ndarray, field_scale: np.ndarray) -> np.ndarray:
    """Both differences moved to the start of the powers, as one hash."""
    reduced = _fold(_fold(_fold(_fold(field)) * field_scale))
    reduced[reduced >= _P] -= np.uint64(_P)
    with np.errstate(over="ignore"):
        return mix(ring * ring_scale ^ reduced * _R)


def span_hashes(sums: Sums, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the values of each span; equal spans have equal hashes."""
    with np.errstate(over="ignore"):
        ring = sums.ring[ends] - sums.ring[starts]
    field = sums.field[ends] - sums.field[starts]
    return _hashes(ring, field, _powers(_R_INV, len(sums))[starts], _field_powers(_Q_INV, len(sums))[starts])


def gram_hashes(sums: Sums, m: int) -> np.ndarray:
    """Hash of every run of ``m`` values."""
    n = len(sums) - m
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        ring = sums.ring[m:] - sums.ring[:n]
    return _hashes(ring, sums.field[m:] - sums.field[:n], _powers(_R_INV, n), _field_powers(_Q_INV, n))


def words_of(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the bounds of each text's words."""
    inside = ~BLANKS[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    before = np.concatenate(([False], inside[:-1])) if len(raw) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(raw) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every ``width`` neighbours, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    return np.minimum(out[:n], out[width - have : width - have + n])
