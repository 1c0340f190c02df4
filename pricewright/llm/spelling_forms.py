"""Spelling variants: words one edit apart, grouped under their most frequent form.

The pairs of words that differ by exactly one inserted, deleted or replaced code
point are the paths of a composition: the minimised acceptor of the vocabulary,
a transducer that copies and edits once, and the acceptor again. ``Acceptor`` holds the
first and third, which are the same; a state of the composition is a pair of its
states and whether the edit is behind. Before the edit both are one state, so a path
is a prefix; after it (``common``) both read the same letters.

The composition is enumerated per part of its initial state: an edit at a place
from ``low`` to ``high`` leaves the letters before and after alone, so words that
may be joined by it share a prefix of ``low`` letters and the suffix behind
``high``. These, the length of the shorter word and the places make a key; a
task gets the words of some keys, and looks for edits at those places only.
So every pair is found under exactly one key. Keys begin with one half of the places;
a key of more than ``hot`` words is split into the halves of its places, down to a
single place, where a key has at most a few thousand words (one for each letter or
two letters). Nothing is capped.

Defined cases: a null text counts as empty, a null id as an empty string before
the colon; repeated rows are documents of their own; words may be of any
length; ties between forms go to the smaller word in code-point order; other
columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import written
from .packed_terms import COLUMNS, TERM, counted, runs_of, term_text
from .repeats import slices
from .textbytes import lower_ascii, texts_of

MIN_LETTERS = 5
MIN_COUNT = 3
# One in so many runs loses a letter.
DELETED = 97
# The form of a word is at least so many times as frequent.
TIMES = 2
HOT_WORDS = 50_000
BUCKET_ROWS = 50_000
SLICE_BYTES = 4_000_000
CRC_POLYNOMIAL = 0xEDB88320
# Runs of more bytes are hashed one by one.
CRC_BYTES = 64

_ASCII_LETTERS = np.zeros(256, bool)
_ASCII_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
# The first byte of U+00C0 to U+00FF in UTF-8; any second byte is one of theirs.
_LATIN = 0xC3


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(CRC_POLYNOMIAL), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def crc32_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each span, continued from the value ``before`` it."""
    lengths = ends - starts
    state = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-np.minimum(lengths, CRC_BYTES + 1), kind="stable")
    longest_first = lengths[order]
    for at in range(min(CRC_BYTES, int(lengths.max(initial=0)))):
        of = order[: np.searchsorted(-longest_first, -at, side="left")] if at else order
        of = of[lengths[of] <= CRC_BYTES]
        state[of] = _CRC[(state[of] ^ raw[starts[of] + at]) & np.uint32(0xFF)] ^ (state[of] >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths > CRC_BYTES):
        state[i] = zlib.crc32(raw[starts[i] : ends[i]].tobytes(), int(before[i]))
    return state


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n``: the words of at least five letters that occur three times or more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for part in slices(batch, np.diff(texts_of(batch.column(1))[1]), SLICE_BYTES):
                raw, bounds = texts_of(part.column(1))
                raw = lower_ascii(raw)
                lead = raw == _LATIN
                starts, ends, of = runs_of(_ASCII_LETTERS[raw] | lead | np.concatenate(([False], lead[:-1])), bounds)
                letters = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                long = letters[ends] - letters[starts] >= MIN_LETTERS  # a shorter run can't become a word
                starts, ends, of = starts[long], ends[long], of[long]
                names = part.column(0).to_pylist()
                before = np.array([zlib.crc32(f"{'' if x is None else x}:".encode()) for x in names], np.uint32)
                hashes = crc32_of(raw, starts, ends, before[of]).astype(np.int64)
                cut = hashes % DELETED == 0
                shorter = []
                for start, end, h in zip(starts[cut], ends[cut], hashes[cut], strict=True):
                    run = raw[start:end].tobytes().decode()
                    at = int(h) % len(run)
                    shorter.append((run[:at] + run[at + 1 :]).encode() if len(run) > MIN_LETTERS else b"")
                shorter = [x for x in shorter if x]
                raw = np.concatenate((raw, np.frombuffer(b"".join(shorter), np.uint8)))
                more = len(raw) - np.cumsum([0, *[len(x) for x in shorter[::-1]]])[::-1]
                starts, ends = np.concatenate((starts[~cut], more[:-1])), np.concatenate((ends[~cut], more[1:]))
                none = np.zeros(len(starts), np.int64)
                for found in counted(raw, starts, ends, none, none):
                    yield pa.RecordBatch.from_arrays(found.columns(), names=names_out)

    names_out = [x.split()[0] for x in COLUMNS.split(", ")]
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(work, COLUMNS)
    added = rows.groupBy(*TERM).agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)
    return added.select(term_text().alias("word"), "n")


class Acceptor:
    """Minimised acceptors of sorted lists of words; equal states of all lists are one.

    A state knows how many words it accepts, and an arc how many come before
    it, so a path is also the word's place in its list.
    """

    def __init__(self):
        self.register: dict[tuple, int] = {}
        self.final: list[bool] = []
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.count: list[int] = []
        self.met: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.edited: dict[int, tuple[list[tuple[int, int]], list[tuple[int, int]]]] = {}

    def _state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, *arcs)
        found = self.register.get(key)
        if found is None:
            found = self.register[key] = len(self.final)
            total, placed = int(final), {}
            for letter, to in arcs:
                placed[letter] = (to, total)
                total += self.count[to]
            self.final.append(final)
            self.arcs.append(placed)
            self.count.append(total)
        return found

    def add(self, words: list[str]) -> int:
        """The initial state of an acceptor of ``words``, which are sorted and distinct."""
        path: list[list] = [[False, []]]
        last = ""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                path[-1][1].append((last[len(path) - 1], self._state(final, arcs)))

        for word in words:
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            close(shared)
            path.extend([False, []] for _ in range(len(word) - shared))
            path[-1][0] = True
            last = word
        close(0)
        return self._state(*path[0])

    def common(self, s: int, t: int) -> list[tuple[int, int]]:
        """Behind the edit: the places, from ``s`` and from ``t``, of what both accept."""
        places: list[tuple[int, int]] = []
        todo = [(s, t, 0, 0)]
        while todo:
            s, t, at, to = todo.pop()
            if s == t:
                places.extend((at + k, to + k) for k in range(self.count[s]))
                continue
            known = self.met.get((s, t))
            if known is not None:
                places.extend((at + x, to + y) for x, y in known)
                continue
            if self.final[s] and self.final[t]:
                places.append((at, to))
            theirs = self.arcs[t]
            for letter, (state, skip) in self.arcs[s].items():
                other = theirs.get(letter)
                if other is not None:
                    todo.append((state, other[0], at + skip, to + other[1]))
        return places

    def edits(self, q: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """The edit at ``q``: places of words with another letter, and of (longer, shorter) words.

        A letter that is repeated may be taken as inserted at any of its places; the last counts.
        """
        found = self.edited.get(q)
        if found is not None:
            return found
        replaced, inserted = [], []
        arcs = list(self.arcs[q].items())
        for i, (letter, (state, skip)) in enumerate(arcs):
            for _, (other, further) in arcs[i + 1 :]:
                replaced.extend((skip + x, further + y) for x, y in self._met(state, other))
            if self.final[state] and self.final[q]:
                inserted.append((skip, 0))
            for after, (to, before) in self.arcs[state].items():
                same = self.arcs[q].get(after)
                if after != letter and same is not None:
                    inserted.extend((skip + before + x, same[1] + y) for x, y in self._met(to, same[0]))
        self.edited[q] = replaced, inserted
        return replaced, inserted

    def _met(self, s: int, t: int) -> list[tuple[int, int]]:
        found = self.met.get((s, t))
        if found is None:
            found = self.met[s, t] = self.common(s, t)
        return found

    def pairs(self, initial: int, low: int, high: int) -> Iterator[tuple[int, int, bool]]:
        """Places of words that differ by one edit at a place from ``low`` to ``high``, and whether by a letter more."""
        todo = [(initial, 0, 0)]
        while todo:
            q, depth, at = todo.pop()
            if depth >= low:
                replaced, inserted = self.edits(q)
                yield from ((at + x, at + y, False) for x, y in replaced)
                yield from ((at + x, at + y, True) for x, y in inserted)
            if depth < high:
                todo.extend((to, depth + 1, at + skip) for to, skip in self.arcs[q].values())


def _key() -> Column:
    """What words share that an edit at a place from ``low`` to ``high`` may join."""
    behind = F.greatest(F.col("shorter") - 1 - F.col("high"), F.lit(0))
    suffix = F.when(behind > 0, F.substring(F.col("word"), -behind, behind)).otherwise("")
    return F.xxhash64("shorter", "low", "high", F.substring(F.col("word"), F.lit(1), F.col("low")), suffix)


def _halves(places: DataFrame) -> DataFrame:
    """Each row twice, for the lower and the upper half of its places."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    lower = F.struct(F.col("low").alias("low"), middle.alias("high"))
    upper = F.struct((middle + 1).alias("low"), F.col("high").alias("high"))
    split = places.withColumn("half", F.explode(F.array(lower, upper)))
    return split.select("word", "n", "length", "shorter", "half.low", "half.high").withColumn("key", _key())


def keyed_words(words: DataFrame, hot: int = HOT_WORDS) -> DataFrame:
    """``words`` under the keys of all edits that may join them: ``key``, ``shorter``, ``low``, ``high``, ``word``, ``n``, ``length``."""
    lengths = words.withColumn("length", F.char_length("word"))
    roles = F.array(F.col("length"), F.col("length") - 1)  # as the shorter word or one of equals, and as the longer
    whole = lengths.withColumn("shorter", F.explode(roles)).where(F.col("shorter") >= MIN_LETTERS)
    places = written(_halves(whole.withColumns({"low": F.lit(0), "high": F.col("shorter")})), "spelling-keys")
    done = None
    while True:
        crowded = places.where("low < high").groupBy("key").count().where(F.col("count") > hot).select("key")
        crowded = written(crowded, "spelling-crowded")
        if crowded.isEmpty():
            return places if done is None else done.unionByName(places)
        light = places.join(crowded, "key", "left_anti").select(*places.columns)
        done = light if done is None else done.unionByName(light)
        places = written(_halves(places.join(crowded, "key", "left_semi")), "spelling-keys")


def near_words(words: DataFrame, hot: int = HOT_WORDS) -> DataFrame:
    """``word``, ``near`` and ``near_n``: both directions of each pair of words that are one edit apart."""
    keyed = keyed_words(words, hot)
    buckets = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), keyed.count() // BUCKET_ROWS)

    def work(table: pa.Table) -> pa.Table:
        key, shorter, low, high, length = (table.column(c).to_numpy() for c in ("key", "shorter", "low", "high", "length"))
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        words, counts = table.column("word").to_pylist(), table.column("n").to_numpy()
        acceptor, left, right = Acceptor(), [], []
        for part in np.split(order, cuts):
            if len(part) < 2:
                continue
            at = sorted(part.tolist(), key=words.__getitem__)
            first = at[0]
            initial = acceptor.add([words[i] for i in at])
            for x, y, longer in acceptor.pairs(initial, int(low[first]), int(high[first])):
                if longer or length[at[x]] == shorter[first]:  # longer pairs of equals have a key of their own
                    left.append(at[x])
                    right.append(at[y])
        a, b = np.array(left + right, np.int64), np.array(right + left, np.int64)
        word = table.column("word").combine_chunks()
        return pa.table({"word": word.take(pa.array(a)), "near": word.take(pa.array(b)), "near_n": pa.array(counts[b], pa.int64())})

    dealt = keyed.withColumn("bucket", F.pmod("key", F.lit(buckets))).select("bucket", "key", "shorter", "low", "high", "length", "word", "n")
    return dealt.groupBy("bucket").applyInArrow(work, "word string, near string, near_n long")


def roots_of(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the end of its chain, for words with a ``form``.

    A form is at least twice as frequent, so chains have no rings and at most
    63 steps, and jumping to the root of the root ends within seven rounds.
    """
    roots = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = written(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        roots = after.select("word", "root")


def group_spellings(docs: DataFrame, id_col: str = "doc_id", text: str = "text", hot: int = HOT_WORDS) -> DataFrame:
    """Per word of the vocabulary: ``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n``."""
    words = written(vocabulary(docs, id_col, text), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    near = near_words(words, hot).groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.join(near, "word", "left").withColumn("follows", -F.col("best.less") >= TIMES * F.col("n"))
    rows = joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("follows"), F.col("best.form")).alias("form"),
        F.when(F.col("follows"), -F.col("best.less")).alias("form_n"),
    )
    rows = written(rows, "spellings")
    roots = roots_of(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
