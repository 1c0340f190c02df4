"""N-gram Jaccard join over parity sketches.

A document is its set of distinct word shingles. Sets with 100 * intersection
>= 90 * union differ in at most (a + b) / 19 elements (for 90; see ``Limits``). A
parity sketch flips one bit per shingle, so two sketches differ in at most as many
bits as the sets in elements. The sketch (long and sparse) is cut into more parts
than the sets may differ in, so two similar sets agree in whole parts: a part's
parities, hashed, are a join key. A few parts are spare, so that a set can
leave out its empty parts, in which strangers agree: as long as it has no more of
them than spares, some part that isn't empty agrees. Sizes are cut into bands such that similar
sets lie in one band or in neighbours; a set is sketched for its own band and
as the larger set of the band below.

Sets that are equal are one class. Candidates of a key are compared with the
key's smallest class first, and linked classes are merged into components, so a
group of a thousand near copies costs a thousand comparisons and not a million.
Where a key's classes are still in several components, the join compares the
short sketches of classes of different components: only pairs whose sketches
differ in no more bits than similar sets may are let through, and no link between
components is missed. Candidates are then compared by sketches that grow with
their sets, and those left are verified on whole sets.

Defined cases: a null or empty text has an empty set and links with nothing; its
component is its own id; a null id counts as larger than all others; each row is
a document of its own, also where ids repeat; extra columns are not read; an
empty table gives an empty table. Classes are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written
from .repeats import CHUNK_BYTES, chunk_ids, chunk_rows, heats, slices, unpacked, with_flags, written_bucketed
from .textbytes import byte_values, give_back, gram_hashes, lower_ascii, mix, prefix_sums, span_hashes, text_pieces, texts_of, words_of

WORDS = 3
PERCENT = 90
PART_BITS = 1 << 32
# Spare parts, as a share of the parts, and how many deviations above the expected number of empty parts.
SPARE = 0.04
DEVIATIONS = 3
# Words of 64 bits in the short sketch that a class carries into the last comparison.
SHORT = 8
ROUNDS = 2
LAST_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Limits:
    """Size bands for a similarity of ``percent`` per cent, up to sets of 2^40."""

    percent: int = PERCENT

    @cached_property
    def starts(self) -> np.ndarray:
        """Where bands start; a similar set is at most 100 / percent times as large."""
        out = [1]
        while out[-1] < 1 << 40:
            out.append(out[-1] * 100 // self.percent + 1)
        return np.array(out)

    @cached_property
    def needed(self) -> np.ndarray:
        """Per band: one more than sets of the band and their partners may differ in."""
        largest = self.starts[1:] - 1
        both = largest + largest * 100 // self.percent
        return both * (100 - self.percent) // (100 + self.percent) + 1

    @cached_property
    def spare(self) -> np.ndarray:
        """Parts on top of that, except where equality is all that is similar.

        The smallest sets of a band leave the most parts empty. There are more
        spares than such a set has empty parts, but for rare cases: those have to
        offer their empty parts as keys, in which strangers agree.
        """
        smallest = self.starts[:-1]
        spare = np.ceil(self.needed * SPARE)
        for _ in range(8):  # more parts leave more of them empty
            parts = self.needed + spare
            empty = parts * np.exp(-smallest / parts)
            spare = np.minimum(np.maximum(spare, np.ceil(empty + DEVIATIONS * np.sqrt(empty))), self.needed)
        return np.where(self.needed > 1, spare.astype(np.int64), 0)

    def band(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, sizes, side="right") - 1


def shingles(raw: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and their bounds."""
    parts = [_shingles(*piece, words) for piece in text_pieces(raw, bounds)]
    sizes = np.concatenate([np.diff(of) for _, of in parts])
    return np.concatenate([hashes for hashes, _ in parts]), np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))


def _shingles(raw: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    raw = lower_ascii(raw)
    starts, ends, of = words_of(raw, bounds)
    sums = prefix_sums(span_hashes(prefix_sums(byte_values(raw)), starts, ends))
    n = np.diff(of)
    owner = np.repeat(np.arange(len(n)), n)
    hashes = gram_hashes(sums, words)
    whole = owner[: len(hashes)] == owner[words - 1 : words - 1 + len(hashes)]
    short = np.flatnonzero((n > 0) & (n < words))
    salted = mix(span_hashes(sums, of[short], of[short] + n[short]) ^ mix(n[short].astype(np.uint64)))
    owner = np.concatenate((owner[: len(hashes)][whole], short))
    hashes = np.concatenate((hashes[whole], salted))
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(owner) != 0) | (hashes[1:] != hashes[:-1])
    owner, hashes = owner[new], hashes[new]
    return hashes, np.searchsorted(owner, np.arange(len(n) + 1))


def set_hashes(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash per set (0 for an empty one)."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    with np.errstate(over="ignore"):
        out = mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64))
    return np.where(np.diff(bounds) > 0, out, np.uint64(0))


def sketch_keys(hashes: np.ndarray, bounds: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of all sets, set by set, and how many each has."""
    sizes = np.diff(bounds)
    keys, owners = [], []
    for lower in (0, 1):
        sets = np.flatnonzero(sizes > 0)
        band = limits.band(sizes[sets]) - lower
        sets, band = sets[band >= 0], band[band >= 0]
        parts = limits.needed[band] + limits.spare[band]
        first = np.concatenate(([0], np.cumsum(parts)))
        number = np.full(len(sizes), -1)
        number[sets] = np.arange(len(sets))
        mine = np.repeat(number, sizes)
        used = mine >= 0
        mine, tokens = mine[used], hashes[used]
        # The bit that a shingle flips; XOR of its hash is the parities' hash.
        bit = tokens % (parts[mine] * PART_BITS).astype(np.uint64)
        parity = np.zeros(first[-1], np.uint64)
        np.bitwise_xor.at(parity, first[mine] + (bit // np.uint64(PART_BITS)).astype(np.int64), mix(bit ^ np.uint64(0x2545F4914F6CDD1D)))
        owner = np.repeat(np.arange(len(sets)), parts)
        part = np.arange(first[-1]) - first[owner]
        place = mix(((band[owner] << 40) | part).astype(np.uint64))
        empty = parity == 0
        few = np.bincount(owner[empty], minlength=len(sets)) <= limits.spare[band]
        use = ~empty | ~few[owner]
        keys.append(mix(parity ^ place)[use])
        owners.append(sets[owner[use]])
    order = np.argsort(np.concatenate(owners), kind="stable")
    return np.concatenate(keys)[order], np.bincount(np.concatenate(owners), minlength=len(sizes))


def text_mark(text: str) -> Column:
    """Tells apart the texts of rows that repeat an id."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def short_sketches(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Parity sketches of 64 * SHORT bits, one row per set."""
    out = np.zeros((len(bounds) - 1, SHORT), np.uint64)
    bit = mix(hashes ^ np.uint64(0x6A09E667F3BCC909)) % np.uint64(64 * SHORT)
    owner = np.repeat(np.arange(len(out)), np.diff(bounds))
    np.bitwise_xor.at(out, (owner, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out


def long_sketches(hashes: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Parity sketches of one to two bits per shingle, a power of two of words each."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    words = 1 << np.ceil(np.log2(np.maximum(np.diff(bounds), 64) / 64)).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(words)))
    out = np.zeros(first[-1], np.uint64)
    bit = mix(hashes ^ np.uint64(0x3C6EF372FE94F82B)) & (words[owner] * 64 - 1).astype(np.uint64)
    np.bitwise_xor.at(out, first[owner] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return [out[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]


def sketches_differ(a: bytes, b: bytes) -> int:
    """In how many bits two long sketches differ, the longer one folded to the size of the other."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


CHUNK = "chunk long, ids binary, known binary, bounds binary, texts binary, n_bytes long, sizes binary, classes binary, marks binary, n_keys long"


def sketched(docs: DataFrame, id_col: str, text: str, words: int) -> DataFrame:
    """Chunks of documents with their texts, set sizes and classes; written.

    Keys are about as large as the texts, so later passes make them again.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, zstd = chunk_ids(), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.diff(texts_of(batch.column(1))[1])
            for part in slices(batch, sizes, CHUNK_BYTES):
                raw, bounds = texts_of(part.column(1))
                hashes, of = shingles(raw, bounds, words)
                blobs = [
                    part.column(0).fill_null(0).to_numpy(zero_copy_only=False),
                    part.column(0).is_valid().to_numpy(zero_copy_only=False),
                    bounds,
                    zstd.compress(raw.tobytes()),
                ]
                more = [np.diff(of).astype(np.int64), set_hashes(hashes, of), part.column(2).to_numpy()]
                as_bytes = [pa.array([x if isinstance(x, bytes) else x.tobytes()], pa.binary()) for x in (*blobs, *more)]
                columns = [pa.array([next(numbers)], pa.int64()), *as_bytes[:4], pa.array([len(raw)], pa.int64()), *as_bytes[4:], pa.array([len(hashes) // 3], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in CHUNK.split(", ")])
        give_back()

    packed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"), text_mark(text).alias("mark"))
    return written_bucketed(packed.mapInArrow(work, CHUNK), "chunk", "sketches")


def documents_of(chunks: DataFrame) -> DataFrame:
    """``chunk``, ``text`` (number in the chunk), ``id`` (may be null), ``size``, ``class`` and ``mark``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunk_rows(batches):
            known = np.frombuffer(chunk["known"], bool)
            columns = [
                pa.array(np.full(len(known), chunk["chunk"]), pa.int64()),
                pa.array(np.arange(len(known)), pa.int32()),
                pa.array(np.frombuffer(chunk["ids"], np.int64), pa.int64(), mask=~known),
                *[pa.array(np.frombuffer(chunk[k], np.int64), pa.int64()) for k in ("sizes", "classes", "marks")],
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "text", "id", "size", "class", "mark"])

    schema = "chunk long, text int, id long, size long, class long, mark long"
    return chunks.select("chunk", "ids", "known", "sizes", "classes", "marks").mapInArrow(work, schema)


def shared_keys(chunks: DataFrame, words: int, limits: Limits) -> DataFrame:
    """``key`` and ``class`` where a key occurs in more than one class (or seems to).

    Each pair once, however many chunks hold copies of the class.
    """
    total = chunks.agg(F.sum("n_keys")).first()[0] or 0

    def sketch(chunk: dict) -> tuple[np.ndarray, np.ndarray]:
        _, _, raw, bounds = unpacked(chunk)
        keys, counts = zip(*[sketch_keys(*_shingles(*piece, words), limits) for piece in text_pieces(raw, bounds)], strict=True)
        return np.concatenate(keys), np.concatenate(counts)

    columns = ["ids", "known", "bounds", "texts", "n_bytes"]
    flagged, buckets = with_flags(chunks, columns, lambda c: sketch(c)[0], total)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunk_rows(batches):
            keys, counts = sketch(chunk)
            if not len(keys):
                continue
            of = np.repeat(np.frombuffer(chunk["classes"], np.int64), counts)
            heat = heats(chunk, keys, buckets) > 0
            order = np.lexsort((of, keys))
            keys, of, heat = keys[order], of[order], heat[order]
            same_key = np.concatenate(([False], keys[1:] == keys[:-1]))
            new = ~same_key | np.concatenate(([True], of[1:] != of[:-1]))
            keys, of, heat = keys[new], of[new], heat[new]
            same_key = np.concatenate(([False], keys[1:] == keys[:-1]))
            use = heat | same_key | np.append(same_key[1:], False)
            yield pa.RecordBatch.from_arrays([pa.array(keys[use].view(np.int64), pa.int64()), pa.array(of[use], pa.int64())], names=["key", "class"])

    return flagged.select("chunk", *columns, "classes", "flags").mapInArrow(work, "key long, class long").distinct()


def sets_of(chunks: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``class``, its whole ``set``, ``size`` and short sketch for one document of each wanted class.

    ``wanted`` has ``chunk`` and ``text``.
    """
    asked = wanted.groupBy("chunk").agg(F.collect_list("text").alias("asked"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunk_rows(batches):
            _, _, raw, bounds = unpacked(chunk)
            asked = np.array(sorted(chunk["asked"]), np.int64)
            spans = [raw[bounds[i] : bounds[i + 1]] for i in asked]
            hashes, of = shingles(np.concatenate(spans), np.concatenate(([0], np.cumsum([len(x) for x in spans]))), words)
            lists = pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.array(hashes.view(np.int64)))
            classes = np.frombuffer(chunk["classes"], np.int64)[asked]
            short = [pa.array(s.view(np.int64), pa.int64()) for s in np.ascontiguousarray(short_sketches(hashes, of).T)]
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), lists, pa.array(np.diff(of), pa.int64()), pa.array(long_sketches(hashes, of), pa.binary()), *short], names=["class", "set", "size", "sketch", *SKETCH])

    columns = ["chunk", "ids", "known", "bounds", "texts", "n_bytes", "classes", "asked"]
    return chunks.join(asked, "chunk").select(*columns).mapInArrow(work, "class long, set array<long>, size long, sketch binary, " + ", ".join(f"{s} long" for s in SKETCH))


SKETCH = [f"sketch{i}" for i in range(SHORT)]


def may_be_similar(percent: int, other: str) -> Column:
    """Whether two short sketches differ in no more bits than similar sets in elements."""
    differ = F.lit(0)
    for s in SKETCH:
        differ = differ + F.bit_count(F.col(s).bitwiseXOR(F.col(f"{other}{s}")))
    return (100 + percent) * differ <= (100 - percent) * (F.col("size") + F.col(f"{other}size"))


def likely_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that sketches can't tell apart, short ones first; whole sets are moved for these only.

    A short sketch lets strangers with some 1,000 shingles through; a long one grows with its set.
    """
    short = sets.select("class", "size", *SKETCH)
    other = short.select(*[F.col(c).alias(f"other_{c}") for c in short.columns])
    both = pairs.join(short.withColumnRenamed("class", "a"), "a").join(other.withColumnRenamed("other_class", "b"), "b")
    near = both.where(may_be_similar(percent, "other_")).select("a", "b", (F.col("size") + F.col("other_size")).alias("sum"))
    left = sets.select(F.col("class").alias("a"), F.col("sketch").alias("sketch_a"))
    right = sets.select(F.col("class").alias("b"), F.col("sketch").alias("sketch_b"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differ = [sketches_differ(x, y) for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            most = (100 - percent) * batch.column(2).to_numpy()
            close = pa.array((100 + percent) * np.array(differ, np.int64) <= most, pa.bool_())
            yield batch.select(["a", "b"]).filter(close)

    with_sketches = near.join(left, "a").join(right, "b").select("a", "b", "sum", "sketch_a", "sketch_b")
    return with_sketches.mapInArrow(work, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    left = sets.select(F.col("class").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("class").alias("b"), F.col("set").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    common = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("common"), (F.size("set_a") + F.size("set_b")).alias("sum"))
    return common.where(100 * F.col("common") >= percent * (F.col("sum") - F.col("common"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``class`` and ``label`` (smallest class of its component), for linked classes.

    Labels fall along links and then jump to their own labels, until nothing
    changes; a round is a few joins on written tables.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("class"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("class").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        fallen = labels.join(near.withColumnRenamed("a", "class"), "class").select("class", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        fallen = written(fallen, "labels")
        jump = fallen.select(F.col("class").alias("label"), F.col("label").alias("further"))
        after = written(fallen.join(jump, "label", "left").select("class", F.least("label", "further").alias("label"), "old"), "labels")
        if after.where("label < old").isEmpty():
            return after.select("class", "label")
        labels = after.select("class", "label")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, rounds: int = ROUNDS) -> DataFrame:
    """Per row: ``id_col``, ``n_shingles``, ``class`` and ``component_id``, the smallest id reachable by links.

    ``first`` is true for one row of each component (the smallest id) and for rows with an
    empty set; ``mark`` is the row's ``text_mark``.
    """
    limits = Limits(percent)
    chunks = sketched(docs, id_col, text, words)
    rows = written(documents_of(chunks), "sketched_documents")
    known = F.coalesce(F.col("id"), F.lit(LAST_ID))
    keys = written(shared_keys(chunks, words, limits), "shared_keys")
    one_each = rows.groupBy("class").agg(F.min(F.struct("chunk", "text")).alias("at"))
    sets = labels = links = checked = None
    for number in range(rounds + 1):
        labelled = keys.withColumn("label", F.col("class"))
        if labels is not None:
            labelled = keys.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
        spread = labelled.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("key")
        unsettled = written(labelled.join(spread, "key"), "unsettled")
        if unsettled.isEmpty():
            break
        if sets is None:  # of all classes that share a key with another one
            wanted = one_each.join(unsettled.select("class").distinct(), "class").select("at.chunk", "at.text")
            sets = written(sets_of(chunks, wanted, words), "sets")
        if number < rounds:
            # Every class against one class of its key; another one in each round.
            turn = F.xxhash64(F.lit(number), "class") if number else F.col("class")
            pivots = unsettled.withColumn("turn", turn).groupBy("key").agg(F.min("turn").alias("turn"))
            pivots = pivots.join(unsettled.select("key", turn.alias("turn"), F.col("class").alias("pivot"), F.col("label").alias("pivot_label")), ["key", "turn"])
            pairs = unsettled.join(pivots.drop("turn"), "key").where("label <> pivot_label").select("class", F.col("pivot").alias("other"))
        else:
            drawn = unsettled.join(sets.select("class", "size", *SKETCH), "class")
            other = drawn.select("key", *[F.col(c).alias(f"other_{c}") for c in ("class", "label", "size", *SKETCH)])
            apart = (F.col("label") < F.col("other_label")) & may_be_similar(percent, "other_")
            pairs = drawn.join(other.withColumnRenamed("key", "other_key"), (F.col("key") == F.col("other_key")) & apart).select("class", F.col("other_class").alias("other"))
        pairs = pairs.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct()
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        pairs = written(pairs, "candidate_pairs")
        found = written(verified(written(likely_pairs(pairs, sets, percent), "likely_pairs"), sets, percent), "verified_pairs")
        checked = pairs if checked is None else checked.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        labels = components(links)

    with_label = rows.withColumn("label", F.col("class"))
    if labels is not None:
        with_label = rows.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    # One row stands for a component: its smallest id, and the first such row.
    place = F.struct(known.alias("id"), "chunk", "text")
    least = with_label.where("size > 0").groupBy("label").agg(F.min(place).alias("least"))
    joined = with_label.join(least, "label", "left")
    component = F.when(F.col("size") > 0, F.nullif(F.col("least.id"), F.lit(LAST_ID))).otherwise(F.col("id"))
    first = (F.col("size") == 0) | (F.col("least") == place)
    return joined.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "class", component.alias("component_id"), first.alias("first"), "mark")


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Every link: ``a``, ``b`` and ``links``, how many pairs of rows the two classes link.

    Every pair of classes that shares a key is looked at, also inside a
    component. A class is linked with itself where it has several rows. The
    members of a class are the rows of ``jaccard_components`` with this
    ``class``; the number of links is the sum of ``links``. The work grows with
    the square of the classes that share a key, as the result may.
    """
    chunks = sketched(docs, id_col, text, words)
    rows = written(documents_of(chunks), "sketched_documents")
    keys = written(shared_keys(chunks, words, Limits(percent)), "shared_keys")
    classes = written(rows.where("size > 0").groupBy("class").agg(F.count("*").alias("n"), F.min(F.struct("chunk", "text")).alias("at")), "classes")
    wanted = classes.join(keys.select("class").distinct(), "class").select("at.chunk", "at.text")
    sets = written(sets_of(chunks, wanted, words), "sets")
    drawn = keys.join(sets.select("class", "size", *SKETCH), "class")
    other = drawn.select(*[F.col(c).alias(f"other_{c}") for c in ("key", "class", "size", *SKETCH)])
    near = (F.col("key") == F.col("other_key")) & (F.col("class") < F.col("other_class")) & may_be_similar(percent, "other_")
    pairs = written(drawn.join(other, near).select(F.col("class").alias("a"), F.col("other_class").alias("b")).distinct(), "candidate_pairs")
    counts = classes.select(F.col("class").alias("a"), F.col("n").alias("n_a"))
    between = verified(written(likely_pairs(pairs, sets, percent), "likely_pairs"), sets, percent).join(counts, "a").join(counts.toDF("b", "n_b"), "b")
    within = classes.where("n > 1").select(F.col("class").alias("a"), F.col("class").alias("b"), F.expr("n * (n - 1) div 2").alias("links"))
    return between.select("a", "b", (F.col("n_a") * F.col("n_b")).alias("links")).unionByName(within)


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: one row of each component stays."""
    rows = jaccard_components(docs, id_col, text, words, percent).where("first")
    stay = rows.groupBy(F.col(id_col).alias("__of"), F.col("mark").alias("__mark")).agg(F.count("*").alias("__stay"))
    number = F.row_number().over(Window.partitionBy("__of", "__mark").orderBy(F.lit(0)))
    joined = docs.join(stay, F.col(id_col).eqNullSafe(F.col("__of")) & (text_mark(text) == F.col("__mark")))
    return joined.where(F.col("__stay") > 0).withColumn("__number", number).where("__number <= __stay").select(*docs.columns)
