"""Suffix arrays of many short texts in numpy.

The texts (segments) lie one after another. Every segment ends with a
terminator of its own, smaller than all values and ordered by segment, so no
comparison crosses an end and all suffixes differ.
"""

from __future__ import annotations

import numpy as np


def suffix_array(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and ranks of all suffixes, by Larsson-Sadakane refinement.

    ``values`` are integers from 0; ``bounds`` are the segments' bounds. Suffixes
    are grouped by a first stretch packed into one number; then each round sorts
    only the members of groups that aren't settled by the group of the suffix
    that many places on, which doubles the compared length.
    """
    n = len(values)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    segment = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = bounds[1:][segment]
    width = int(values.max() + 1).bit_length()
    reach = max(1, 63 // width)
    first = np.zeros(n, np.int64)
    place = np.arange(n)
    for step in range(reach):
        at = place + step
        inside = at < end
        first <<= width
        first[inside] |= values[at[inside]].astype(np.int64) + 1
    order = np.argsort(first, kind="stable")
    new = np.concatenate(([True], np.diff(first[order]) != 0))
    # A group's number is the place of its last member; terminators come first.
    n_segments = len(bounds) - 1
    number = np.empty(n, np.int64)

    def numbered(at: np.ndarray, new: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(new)
        stops = np.append(starts[1:], len(new))
        return np.repeat(at[stops - 1], stops - starts)

    number[order] = numbered(place, new)
    alone = new & np.append(new[1:], True)
    open_at = np.flatnonzero(~alone)
    while len(open_at):
        members = order[open_at]
        ahead = members + reach
        inside = ahead < end[members]
        second = segment[members].copy()
        second[inside] = number[ahead[inside]] + n_segments
        ranked = np.lexsort((second, number[members]))
        members, second = members[ranked], second[ranked]
        new = np.concatenate(([True], (np.diff(number[members]) != 0) | (np.diff(second) != 0)))
        order[open_at] = members
        number[members] = numbered(open_at, new)
        open_at = open_at[~(new & np.append(new[1:], True))]
        reach *= 2
    return order, number


def common_prefixes(values: np.ndarray, bounds: np.ndarray, order: np.ndarray, rank: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, up to ``most``.

    Kasai's walk along each text, where a suffix shares at least one value less
    than its longer neighbour did; all segments walk in step.
    """
    n = len(values)
    out = np.zeros(n, np.int64)
    segment = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = bounds[1:][segment]
    at = bounds[:-1][np.diff(bounds) > 0]
    stop = bounds[1:][np.diff(bounds) > 0]
    have = np.zeros(len(at), np.int64)
    while len(at):
        r = rank[at]
        before = np.where(r > 0, order[np.maximum(r, 1) - 1], 0)
        limit = np.where(r > 0, np.minimum(np.minimum(end[at] - at, end[before] - before), most), 0)
        have = np.minimum(have, limit)
        going = np.flatnonzero(have < limit)
        while len(going):
            same = values[at[going] + have[going]] == values[before[going] + have[going]]
            going = going[same]
            have[going] += 1
            going = going[have[going] < limit[going]]
        out[r] = have
        at, have = at + 1, np.maximum(have - 1, 0)
        left = at < stop
        if not left.all():
            at, stop, have = at[left], stop[left], have[left]
    return out
