"""Edit-aware token counts: pre-token trees that follow edits.

A document keeps the lengths and token counts of its pre-tokens. Pre-tokens are
grouped into leaves, and a segment tree holds the sums over the leaves. An edit
finds its leaves by descending the tree, re-encodes the touched characters plus
boundary context, and updates the sums on the way up.

Which context is enough: a pre-token is found by matching from its start, and a
match looks at most two characters past its end (blanks give one back before a
word). So pre-tokens that end at least two characters before the edit stay; from
the last such end the text is matched again until a match ends where an old pre-token ended (shifted by the edit) at
or behind the edit. From there on all old pre-tokens stay, since a match depends
only on the text behind its start.

Trees travel as two binary columns, so they can be stored with the documents
and taken up again. A document is one row; there is no shuffle and no state
across rows but a bounded cache of pre-token counts.

Defined cases: a null text is empty and has no tokens; edits may be null or
empty; places beyond the end mean the end; edits are applied in order, each to
the text the one before left; other columns pass through; an empty table gives
an empty table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

# The split of the rank files (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 64
CACHE = 200_000
ROWS = 256
EDITS = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("put", T.StringType())]))


class PreTokens:
    """Cuts texts into pre-tokens and counts each pre-token's tokens."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN, cache: int = CACHE):
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.counts: dict[str, int] = {}
        self.size = cache

    def count(self, token: str) -> int:
        n = self.counts.get(token)
        if n is None:
            if len(self.counts) >= self.size:
                self.counts.clear()
            n = len(self.encoding.encode_ordinary(token))
            if len(token) <= 64:
                self.counts[token] = n
        return n

    def cut(self, text: str) -> tuple[list[int], list[int]]:
        tokens = self.pattern.findall(text)
        return list(map(len, tokens)), list(map(self.count, tokens))


class TokenTree:
    """Segment tree over leaves of pre-tokens, with sums of characters and tokens."""

    def __init__(self, lengths: list[int], counts: list[int]):
        self.leaves = [(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(lengths), LEAF)] or [([], [])]
        self._build()

    def _build(self) -> None:
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (lengths, counts) in enumerate(self.leaves):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(lengths), sum(counts)
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at``, and where the leaf starts."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at >= start + self.chars[node] and start + self.chars[node] < self.chars[1]:
                start += self.chars[node]
                node += 1
        return min(node - self.width, len(self.leaves) - 1), start

    def _update(self, leaf: int) -> None:
        node = self.width + leaf
        self.chars[node], self.tokens[node] = sum(self.leaves[leaf][0]), sum(self.leaves[leaf][1])
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def replace(self, first: int, last: int, lengths: list[int], counts: list[int]) -> None:
        """Put new pre-tokens in place of the leaves from ``first`` to ``last``."""
        if first == last and len(lengths) <= 2 * LEAF:
            self.leaves[first] = (lengths, counts)
            self._update(first)
        else:
            self.leaves[first : last + 1] = [(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(lengths), LEAF)] or [([], [])]
            self._build()

    def edit(self, text: str, at: int, length: int, put: str, cutter: PreTokens) -> tuple[str, int]:
        """Apply one edit; returns the new text and how many characters were matched again."""
        at = max(0, min(at, len(text)))
        stop = min(len(text), at + max(0, length))
        new, shift = text[:at] + put + text[stop:], len(put) - (stop - at)
        leaf, start = self.find(max(0, at - 2))
        while leaf and start >= at - 2:  # the leaf before may end inside the context
            leaf -= 1
            start -= self.chars[self.width + leaf]
        first, kept = leaf, 0
        lengths, counts = self.leaves[first]
        place = start
        while kept < len(lengths) and place + lengths[kept] + 1 < at:
            place += lengths[kept]
            kept += 1
        out_lengths, out_counts = lengths[:kept], counts[:kept]
        again = place
        # Old ends behind the edit, leaf by leaf, as new places.
        old, i, last = place, kept, first
        for match in cutter.pattern.finditer(new, place):
            out_lengths.append(match.end() - match.start())
            out_counts.append(cutter.count(match.group()))
            place = match.end()
            if place < at + len(put):
                continue
            while old + shift < place or old < stop:
                while i == len(self.leaves[last][0]):
                    if last + 1 == len(self.leaves):
                        break
                    last, i = last + 1, 0
                if i == len(self.leaves[last][0]):
                    break
                old += self.leaves[last][0][i]
                i += 1
            if old + shift == place and old >= stop:
                break
        else:
            last, i = len(self.leaves) - 1, len(self.leaves[-1][0])
        out_lengths, out_counts = out_lengths + self.leaves[last][0][i:], out_counts + self.leaves[last][1][i:]
        self.replace(first, last, out_lengths, out_counts)
        return new, place - again

    def stored(self) -> tuple[bytes, bytes]:
        lengths, counts = ([x for leaf in self.leaves for x in leaf[k]] for k in (0, 1))
        return np.array(lengths, "<u4").tobytes(), np.array(counts, "<u4").tobytes()

    @classmethod
    def restored(cls, lengths: bytes, counts: bytes) -> TokenTree:
        return cls(np.frombuffer(lengths, "<u4").tolist(), np.frombuffer(counts, "<u4").tolist())


def _over_rows(df: DataFrame, inputs: list[str], outputs: dict[str, T.DataType], ranks_path: str, row) -> DataFrame:
    """Replace or add ``outputs`` by ``row(cutter, *inputs)`` for every row."""
    with open(ranks_path, "rb") as file:
        ranks = file.read()
    plain = [c for c in df.columns if c not in outputs]
    given = df.select(*plain, *[F.col(c).alias(f"__in{i}") for i, c in enumerate(inputs)])
    schema = T.StructType([*[f for f in given.schema if f.name in plain], *[T.StructField(n, k) for n, k in outputs.items()]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = PreTokens(ranks)
        types = [pa.int64() if isinstance(k, T.LongType) else pa.binary() if isinstance(k, T.BinaryType) else pa.string() for k in outputs.values()]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                columns = [c.to_pylist() for c in part.columns[len(plain) :]]
                rows = [row(cutter, *values) for values in zip(*columns, strict=True)]
                new = [pa.array([r[i] for r in rows], k) for i, k in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(plain)], *new], names=schema.names)

    return given.mapInArrow(work, schema)


def build_trees(docs: DataFrame, ranks_path: str, text: str = "text") -> DataFrame:
    """Adds ``tree_lengths``, ``tree_counts`` and ``n_tokens`` to every row."""

    def row(cutter: PreTokens, value: str | None) -> tuple:
        lengths, counts = cutter.cut(value or "")
        return np.array(lengths, "<u4").tobytes(), np.array(counts, "<u4").tobytes(), sum(counts)

    return _over_rows(docs, [text], {"tree_lengths": T.BinaryType(), "tree_counts": T.BinaryType(), "n_tokens": T.LongType()}, ranks_path, row)


def apply_edits(trees: DataFrame, ranks_path: str, edits: str = "edits", text: str = "text") -> DataFrame:
    """Apply the array of edits (at, length, put) of every row to its text and tree.

    ``n_tokens`` and the tree follow; ``n_matched`` counts the characters that
    were matched again.
    """

    def row(cutter: PreTokens, value: str | None, lengths: bytes, counts: bytes, changes: list | None) -> tuple:
        value, tree, matched = value or "", TokenTree.restored(lengths, counts), 0
        for change in changes or []:
            if change is not None:
                value, n = tree.edit(value, change["at"] or 0, change["length"] or 0, change["put"] or "", cutter)
                matched += n
        return value, *tree.stored(), tree.n_tokens, matched

    outputs = {text: T.StringType(), "tree_lengths": T.BinaryType(), "tree_counts": T.BinaryType(), "n_tokens": T.LongType(), "n_matched": T.LongType()}
    return _over_rows(trees, [text, "tree_lengths", "tree_counts", edits], outputs, ranks_path, row)


def drawn_edits(text: Column, key: Column) -> Column:
    """Three edits that follow from the row itself: a deletion, a copy and a swap of a word's letters."""
    whole = F.coalesce(text, F.lit(""))
    n = F.char_length(whole)
    place = lambda k: F.pmod(F.xxhash64(F.lit(k), key), n + 1).cast("int")
    edit = lambda at, length, put: F.struct(at.alias("at"), F.lit(length).alias("length"), put.alias("put"))
    return F.array(
        edit(place(1), 17, F.lit("")),
        edit(place(2), 0, F.substring(whole, 1, 60)),
        edit(place(3), 5, F.concat(F.lit(" "), F.reverse(F.substring(whole, 3, 9)))),
    )
