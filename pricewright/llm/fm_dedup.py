"""Substring dedup over words with FM-indexes per shard.

``passages`` deals segments that may repeat to shards. Equal windows share an
anchor, so only segments of one anchor are compared, and of those only a later
document's with an earlier one's. The documents of an anchor are numbered in
order; at level l the segments whose number has bit l clear are indexed and those
that have it set are streamed, both within the node of equal higher bits. Every
two documents of an anchor meet at one level, in one node. A level has one index
for all its nodes, as the nodes' words are different symbols.

An index is the Burrows-Wheeler transform in a wavelet tree of packed bits with
counts per 64-bit word, and what neighbouring rows share, up to a window, in one
byte with block minima. Backward search extends each streamed segment from its
last word to the left, all of them in step. Where a row can't be extended, the
nearest rows above and below that can be take over, with what they share. This
gives matching statistics: how many words from here on occur in an earlier
document. Windows whose statistic reaches the window length are reported. The
suffixes of a shard are sorted once; a level's rows are a part of them.

Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing
names are as ``passages`` defines them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .passages import remove_repeats, word_units
from .suffix_arrays import common_prefixes, suffix_array

WINDOW = 50
GRAM = 12
SHARD_BYTES = 10_000_000
_LOW = (np.uint64(1) << np.arange(64, dtype=np.uint64)) - np.uint64(1)


class WaveletTree:
    """Rank over a sequence of integers, level by level from the highest bit."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        # Where the places of the sequence are after the last level, symbol by symbol.
        self.origin = np.arange(len(sequence), dtype=np.int32)
        sequence = sequence.astype(np.int32)
        for level in range(self.levels - 1, -1, -1):
            bit = (sequence >> level) & 1
            padded = np.zeros((len(bit) + 64) // 64 * 64, np.uint8)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.bits.append(words)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64))))
            one, zero = np.flatnonzero(bit), np.flatnonzero(bit == 0)
            self.zeros.append(len(zero))
            sequence, self.origin = (np.concatenate((x[zero], x[one])) for x in (sequence, self.origin))
        every = np.arange(symbols)
        self.first = self._down(every, np.zeros(symbols, np.int64))

    def rank(self, symbol: np.ndarray, places: list[np.ndarray]) -> list[np.ndarray]:
        """How often each symbol stands before each place, for several places."""
        first = self.first[symbol]
        return [self._down(symbol, p) - first for p in places]

    def access(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before."""
        symbol = np.zeros(len(place), np.int64)
        for bits, counts, zeros in zip(self.bits, self.counts, self.zeros, strict=True):
            word, inside = place >> 6, _LOW[place & 63]
            held = bits[word]
            one = held & (inside + np.uint64(1)) != 0
            ones = counts[word] + np.bitwise_count(held & inside)
            symbol = symbol << 1 | one
            place = np.where(one, zeros + ones, place - ones)
        return symbol, place - self.first[symbol]

    def select(self, symbol: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Where each symbol stands for the k-th time, from 0; it must."""
        return self.origin[self.first[symbol] + k].astype(np.int64)

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where each place is after the last level, for the given symbols."""
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k)) & 1 == 1
            word = place >> 6
            ones = self.counts[k][word] + np.bitwise_count(self.bits[k][word] & _LOW[place & 63])
            place = np.where(one, self.zeros[k] + ones, place - ones)
        return place


class Least:
    """Smallest value of ranges of a sequence: within blocks, and doubling runs of whole blocks."""

    BLOCK = 16

    def __init__(self, values: np.ndarray):
        n_blocks = len(values) // self.BLOCK + 1
        self.values = np.full(n_blocks * self.BLOCK, np.iinfo(values.dtype).max, values.dtype)
        self.values[: len(values)] = values
        blocks = self.values.reshape(n_blocks, self.BLOCK)
        self.upto = np.minimum.accumulate(blocks, axis=1).ravel()
        self.since = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
        runs, step = [blocks.min(axis=1)], 1
        while 2 * step <= n_blocks:
            runs.append(np.minimum(runs[-1][:-step], runs[-1][step:]))
            step *= 2
        self.offsets = np.concatenate(([0], np.cumsum([len(r) for r in runs])))
        self.runs = np.concatenate(runs)

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Over ``low`` to ``high`` (exclusive), which must not be empty."""
        last = high - 1
        first_block, last_block = low // self.BLOCK, last // self.BLOCK
        out = np.minimum(self.since[low], self.upto[last])
        within = np.flatnonzero(first_block == last_block)
        cells = low[within, None] + np.arange(self.BLOCK)
        out[within] = self.values[np.minimum(cells, last[within, None])].min(axis=1)
        far = np.flatnonzero(last_block - first_block > 1)
        begin, end = first_block[far] + 1, last_block[far]
        k = np.frexp(end - begin)[1] - 1
        whole = np.minimum(self.runs[self.offsets[k] + begin], self.runs[self.offsets[k] + end - (1 << k)])
        out[far] = np.minimum(out[far], whole)
        return out


class FMIndex:
    """Rows in the order of their nodes and suffixes, for matching statistics up to ``window``.

    ``first`` and ``before`` are the symbols at and before each suffix, ``shared``
    is what a row has in common with the row above it, ``nodes`` are the symbols' nodes
    in order. The tree holds a symbol's number within its node, so that it has as many
    levels as the largest node needs.
    """

    def __init__(self, first: np.ndarray, before: np.ndarray, shared: np.ndarray, nodes: np.ndarray, window: int):
        self.window = window
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(first, minlength=len(nodes)))))
        opening = np.searchsorted(nodes, nodes)
        self.number = np.arange(len(nodes)) - opening
        self.home = self.starts[opening]
        self.tree = WaveletTree(self.number[before], int(self.number.max()) + 1)
        # How often a symbol's number stands in the rows of earlier nodes.
        self.earlier = self.tree.rank(self.number, [self.home])[0]
        self.shared = Least(shared)

    def match(self, symbols: np.ndarray, first: np.ndarray, stop: np.ndarray, base: np.ndarray | None = None) -> np.ndarray:
        """For each place from ``first`` to ``stop``: how many symbols from there on occur in the index.

        A symbol below 0 is one that the index doesn't have. With ``base``, where
        segments start, a search ends where no window that starts at or before
        its place can be matched: such a window needs the symbols up to its own end.
        """
        lengths = np.zeros(len(symbols), np.int64)
        at = stop - 1
        going = at >= first
        at, first, base = at[going], first[going], None if base is None else base[going]
        row, length = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        while len(at):
            symbol = symbols[at]
            known = symbol >= 0
            row = np.where(length == 0, self.home[symbol], row)
            before, rank = self.tree.access(row)
            same = known & (before == self.number[symbol])
            turn = np.flatnonzero(known & ~same)
            turned = self._turned(symbol[turn], row[turn], length[turn])
            row, length = np.where(same, self.starts[symbol] + rank - self.earlier[symbol], 0), np.where(same, length + 1, 0)
            row[turn], length[turn] = turned
            length = np.minimum(length, self.window)
            lengths[at] = length
            live = at > first
            if base is not None:
                live &= length >= self.window - (at - base)
            at = at - 1
            if not live.all():
                at, first, row, length = at[live], first[live], row[live], length[live]
                base = None if base is None else base[live]
        return lengths

    def _turned(self, symbol: np.ndarray, row: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and lengths after a symbol that doesn't stand before ``row``: by the nearest rows that it stands before."""
        number, earlier = self.number[symbol], self.earlier[symbol]
        rank = self.tree.rank(number, [row])[0] - earlier
        total = self.starts[symbol + 1] - self.starts[symbol]
        above, below = np.flatnonzero(rank > 0), np.flatnonzero(rank < total)
        up, down = np.full(len(row), -1), np.full(len(row), -1)
        both = np.concatenate((above, below))
        nearest = self.tree.select(number[both], earlier[both] + np.concatenate((rank[above] - 1, rank[below])))
        here = row[both]
        common = self.shared.of(np.minimum(nearest, here) + 1, np.maximum(nearest, here) + 1)
        up[above], down[below] = common[: len(above)], common[len(above) :]
        chosen = np.where(up >= down, rank - 1, rank)
        return self.starts[symbol] + chosen, np.minimum(length, np.maximum(up, down)) + 1


class Segments:
    """Segments of a shard with their suffixes in order; an index of any of them, by node."""

    def __init__(self, values: np.ndarray, bounds: np.ndarray, window: int):
        """``values`` are integers above 0; number 0 ends every segment."""
        n = len(bounds) - 1
        self.values, self.bounds, self.window = values, bounds, window
        spread = bounds + np.arange(n + 1)
        self.text = np.zeros(len(values) + n, np.int64)
        held = np.ones(len(self.text), bool)
        held[spread[1:] - 1] = False
        self.text[held] = values
        self.of = np.repeat(np.arange(n), np.diff(bounds))
        order, rank = suffix_array(self.text, spread)
        kind = np.uint8 if window < 256 else np.int32
        self.order = order
        self.shared = Least(common_prefixes(self.text, spread, order, rank, window).astype(kind))
        self.before = np.zeros(len(self.text), np.int64)
        self.before[1:] = self.text[:-1]
        self.before[spread[:-1]] = 0
        self.segment = np.repeat(np.arange(n), np.diff(spread))

    def match(self, older: np.ndarray, later: np.ndarray, node: np.ndarray, n_windows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places of the ``later`` segments, and their matching statistics against ``older`` ones of the same node.

        With ``n_windows`` the statistics may be less where they don't reach the
        window. The words that all windows of a segment share are searched first; the
        whole segment follows where they are found.
        """
        rows = np.flatnonzero(older[self.segment[self.order]])
        nodes = node[self.segment[self.order[rows]]]
        by_node = np.argsort(nodes, kind="stable")
        rows, nodes = rows[by_node], nodes[by_node]
        at = self.order[rows]
        shared = np.zeros(len(rows), self.shared.values.dtype)
        same = np.flatnonzero(np.diff(nodes) == 0) + 1
        shared[same] = self.shared.of(rows[same - 1] + 1, rows[same] + 1)
        # A node's words are symbols of its own; rows are in the order of their first symbols.
        most = int(self.text.max()) + 1
        key = nodes * most + self.text[at]
        new = np.concatenate(([True], np.diff(key) != 0))
        symbols = key[new]
        index = FMIndex(np.cumsum(new) - 1, np.searchsorted(symbols, nodes * most + self.before[at]), shared, symbols // most, self.window)
        places = np.flatnonzero(later[self.of])
        wanted = node[self.of[places]] * most + self.values[places]
        found = np.minimum(np.searchsorted(symbols, wanted), len(symbols) - 1)
        stop = np.cumsum(np.diff(self.bounds)[later])
        base = stop - np.diff(self.bounds)[later]
        streamed = np.where(symbols[found] == wanted, found, -1)
        if n_windows is None:
            return places, index.match(streamed, base, stop)
        # From the start of the last window to the end of the first one.
        core = base + n_windows[later] - 1
        has_core = n_windows[later] <= self.window
        lengths = index.match(streamed, core[has_core], (base + self.window)[has_core], base[has_core])
        chosen = ~has_core
        chosen[has_core] = lengths[core[has_core]] >= (base + self.window - core)[has_core]
        return places, index.match(streamed, base[chosen], stop[chosen], base[chosen])


def solver(window: int):
    def solve(raw: np.ndarray, bounds: np.ndarray, n_windows: np.ndarray, owners: np.ndarray, groups: np.ndarray | None = None) -> np.ndarray:
        units = word_units(raw, bounds)
        values = np.unique(units.values, return_inverse=True)[1].reshape(-1) + 1
        segments = Segments(values, units.bounds, window)
        # Numbers of a group's owners, in order.
        group = np.zeros(len(owners), np.int64) if groups is None else np.unique(groups, return_inverse=True)[1].reshape(-1)
        order = np.lexsort((owners, group))
        new_group = np.diff(group[order], prepend=-1) != 0
        new_owner = np.cumsum(new_group | (np.diff(owners[order], prepend=0) != 0))
        number = np.empty(len(owners), np.int64)
        number[order] = new_owner - new_owner[new_group][np.cumsum(new_group) - 1]
        place = np.arange(len(values)) - units.bounds[segments.of]
        is_window = place < n_windows[segments.of]
        gone = np.zeros(len(values), bool)
        for level in range(int(number.max()).bit_length()):
            # Segments that have lost all their windows needn't be streamed again.
            open_windows = np.bincount(segments.of[is_window & ~gone], minlength=len(owners))
            later = (number >> level & 1 == 1) & (open_windows > 0)
            if not later.any():
                continue
            node = np.unique(np.stack((group, number >> level + 1)), axis=1, return_inverse=True)[1].reshape(-1)
            older = (number >> level & 1 == 0) & np.isin(node, node[later])
            places, lengths = segments.match(older, later, node, n_windows)
            gone[places[lengths >= window]] = True
        return np.where(gone, np.iinfo(np.int64).min, owners[segments.of])[is_window]

    return solve


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, **sizes) -> DataFrame:
    """Per row: the id, ``n_words``, ``n_removed`` and ``kept``, the words that stay with one space between."""
    out = remove_repeats(docs, word_units, window, gram, solver(window), True, id_col, text, shard_bytes=shard_bytes, **sizes)
    return out.select(id_col, F.col("n_units").alias("n_words"), "n_removed", F.col("kept").cast("string").alias("kept"))
