"""Line, byte and word dedup and near copies against brute force."""

import hashlib
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings, strategies as st
from pyspark.sql import GroupedData

from pricewright.llm import parity_join, passages, textbytes
from pricewright.llm.fm_dedup import Least, Segments, WaveletTree, remove_repeated_words
from pricewright.llm.fm_dedup import solver as word_solver
from pricewright.llm.line_dedup import LineRuns, dedup_lines
from pricewright.llm.parity_join import Limits, jaccard_components, jaccard_links, sketch_keys, without_near_copies
from pricewright.llm.suffix_arrays import common_prefixes, suffix_array
from pricewright.llm.suffix_dedup import remove_repeated_bytes
from pricewright.llm.suffix_dedup import solver as byte_solver
from pricewright.llm.textbytes import gram_hashes, prefix_sums, span_hashes

BLANKS = " \t\n\x0b\f\r"
LAST = 1 << 63
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def order(doc):
    return LAST if doc is None else doc


def rows_of(df, *columns):
    return Counter(tuple(bytes(v) if isinstance(v, bytearray) else v for v in (r[c] for c in columns)) for r in df.select(*columns).collect())


# -- lines --------------------------------------------------------------------------


def plain_lines(rows, least=10):
    key = lambda line: line.strip(BLANKS).translate(UPPER)
    owner = {}
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            owner[key(line)] = min(order(doc), owner.get(key(line), LAST))
    out = Counter()
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < least or owner[key(x)] == order(doc)]
        out[(doc, len(lines), len(lines) - len(stay), "\n".join(stay))] += 1
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (6, 3)])
def test_lines(odd, odd_rows, batches, fanout):
    got = dedup_lines(odd, batches=batches, fanout=fanout)
    assert [c for c in got.columns if c in odd.columns] == odd.columns
    assert rows_of(got, "doc_id", "n_lines", "n_dropped", "text") == plain_lines(odd_rows)


def test_lines_of_nothing(nothing):
    assert dedup_lines(nothing).count() == 0


def test_runs_are_compacted(spark):
    runs = LineRuns(spark, fanout=2, buckets=2)
    for i in range(5):
        hashes = spark.range(10 * i, 10 * i + 15).selectExpr("id as h1", "-id as h2")
        new = runs.new(hashes)
        assert new.count() == (15 if i == 0 else 10)
        runs.add(new)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert sum(spark.table(t).count() for t in runs.runs()) == 55
    runs.close()


# -- strings and windows of words ------------------------------------------------------


def plain_repeats(rows, units_of, window):
    owner = {}
    units = [units_of(text) for _, text, *_ in rows]
    for (doc, *_), u in zip(rows, units):
        for i in range(len(u) - window + 1):
            k = tuple(u[i : i + window])
            owner[k] = min(order(doc), owner.get(k, LAST))
    for (doc, *_), u in zip(rows, units):
        gone = np.zeros(len(u), bool)
        for i in range(len(u) - window + 1):
            if owner[tuple(u[i : i + window])] < order(doc):
                gone[i : i + window] = True
        yield doc, u, gone


@pytest.mark.parametrize("heat", [7, 0])
def test_bytes(odd, odd_rows, heat):
    """Also with every repeated anchor dealt to several shards (heat 0)."""
    want = Counter()
    for doc, u, gone in plain_repeats(odd_rows, lambda t: (t or "").encode(), 50):
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want[(doc, len(u), int(gone.sum()), spans, bytes(np.frombuffer(u, np.uint8)[~gone]))] += 1
    got = remove_repeated_bytes(odd.repartition(5, "doc_id"), shard_bytes=5000, shard_heat=heat)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept") == want


@pytest.mark.parametrize("heat", [7, 0])
def test_words(odd, odd_rows, heat):
    want = Counter()
    for doc, u, gone in plain_repeats(odd_rows, words, 50):
        want[(doc, len(u), int(gone.sum()), " ".join(w for w, g in zip(u, gone) if not g))] += 1
    got = remove_repeated_words(odd.repartition(5, "doc_id"), shard_bytes=5000, shard_heat=heat)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept") == want


@pytest.mark.parametrize("heat", [7, 0])
def test_a_passage_of_all_documents_is_sent_once_per_chunk(spark, monkeypatch, heat):
    """The shards get a hot passage once, not once for every document; twice in each document, too."""
    rng = np.random.default_rng(5)
    some = lambda n: " ".join(f"{x:x}" for x in rng.integers(0, 1 << 40, n))
    passage = some(150)
    rows = [(int(i), f"{some(3)} {passage} {some(2)} {passage} {some(3)}") for i in rng.permutation(200)]
    sent = spark.sparkContext.accumulator(0)
    plain, width = GroupedData.applyInArrow, sum(np.dtype(k).itemsize for k in passages.META.values())

    def counting(self, func, schema):
        def counted(table):
            if "words" in table.column_names and table.column("shard")[0].as_py() >= 0:
                sent.add(sum(len(zstandard.decompress(x)) // width for x in table.column("meta").to_pylist()))
            return func(table)

        return plain(self, counted, schema)

    monkeypatch.setattr(GroupedData, "applyInArrow", counting)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = Counter()
    for doc, u, gone in plain_repeats(rows, words, 50):
        want[(doc, len(u), int(gone.sum()), " ".join(w for w, g in zip(u, gone) if not g))] += 1
    assert rows_of(remove_repeated_words(docs, shard_heat=heat), "doc_id", "n_words", "n_removed", "kept") == want
    assert 0 < sent.value < 200 * 6  # a passage has some eight segments, of which those at its ends differ


def test_repeats_of_nothing(nothing):
    assert remove_repeated_bytes(nothing).count() == 0
    assert remove_repeated_words(nothing).count() == 0


TEXTS = st.lists(st.binary(min_size=3, max_size=14).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=7)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_suffix_array_and_prefixes(texts):
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    values = np.frombuffer(b"".join(texts), np.uint8)
    suffixes = sorted((list(t[i:]) + [-len(texts) + k], bounds[k] + i) for k, t in enumerate(texts) for i in range(len(t)))
    got, rank = suffix_array(values, bounds)
    assert got.tolist() == [at for _, at in suffixes]
    shared = common_prefixes(values, bounds, got, rank, 4)
    for (a, _), (b, _), n in zip(suffixes, suffixes[1:], shared[1:]):
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert n == min(same, 4)


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(0, 9))
def test_smallest_owner_of_windows(texts, seed):
    w = 3
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    owners = np.random.default_rng(seed).integers(0, 5, len(texts))
    n = np.diff(bounds) - w + 1
    want = [min(o for o, y in zip(owners, texts) if x[i : i + w] in y) for x in texts for i in range(len(x) - w + 1)]
    assert byte_solver(w)(np.frombuffer(b"".join(texts), np.uint8), bounds, n, owners).tolist() == want
    spaced = [b" ".join(bytes([c]) for c in t) for t in texts]
    raw, of = np.frombuffer(b"".join(spaced), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in spaced])))
    mine = np.repeat(owners, n)
    assert (word_solver(w)(raw, of, n, owners) < mine).tolist() == (np.array(want) < mine).tolist()


def test_wavelet_rank():
    rng = np.random.default_rng(1)
    sequence = rng.integers(0, 37, 1000)
    tree = WaveletTree(sequence, 37)
    symbols, places = rng.integers(0, 37, 200), rng.integers(0, 1001, 200)
    want = [int((sequence[:p] == s).sum()) for s, p in zip(symbols, places)]
    assert tree.rank(symbols, [places])[0].tolist() == want


def test_wavelet_access_and_select():
    sequence = np.random.default_rng(2).integers(0, 37, 1000)
    tree = WaveletTree(sequence, 37)
    symbols, ranks = tree.access(np.arange(1000))
    assert symbols.tolist() == sequence.tolist()
    assert ranks.tolist() == [int((sequence[:p] == s).sum()) for p, s in enumerate(sequence)]
    assert tree.select(symbols, ranks).tolist() == list(range(1000))


def test_least_of_ranges():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 200, 700).astype(np.uint8)
    low = rng.integers(0, 700, 3000)
    high = low + 1 + (rng.random(3000) * (700 - low)).astype(int)
    assert Least(values).of(low, high).tolist() == [values[a:b].min() for a, b in zip(low, high)]


def longest_match(x, texts):
    return next((n for n in range(len(x), 0, -1) if any(x[:n] in y for y in texts)), 0)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(0, 9), st.integers(2, 8))
def test_matching_statistics_equal_brute_force(texts, seed, w):
    """Later segments are not in the index; only older ones of the same node count."""
    rng = np.random.default_rng(seed)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    values = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) - 96
    node, later = rng.integers(0, 2, len(texts)), rng.random(len(texts)) < 0.5
    if not later.any() or later.all():
        return
    places, lengths = Segments(values, bounds, w).match(~later, later, node)
    want = [
        min(w, longest_match(x[i:], [y for y, m, late in zip(texts, node, later) if m == k and not late]))
        for x, k, late in zip(texts, node, later) if late for i in range(len(x))
    ]
    assert lengths.tolist() == want
    n = np.maximum(np.diff(bounds) - w + 1, 1)
    if (np.diff(bounds) >= w).all():
        _, some = Segments(values, bounds, w).match(~later, later, node, n)
        assert (some == w).tolist() == (lengths == w).tolist() and (some <= lengths).all()
    assert places.tolist() == [i for t, late in enumerate(later) if late for i in range(bounds[t], bounds[t + 1])]


def test_a_tree_is_as_deep_as_its_largest_node_needs(monkeypatch):
    """Not as all nodes together need; results are those of each node by itself."""
    rng = np.random.default_rng(4)
    texts = [rng.integers(1, 6, 12) for _ in range(80)]
    bounds, node, later = 12 * np.arange(81), np.arange(80) // 2, np.arange(80) % 2 == 1
    sizes = []
    tree = lambda sequence, symbols: sizes.append(symbols) or WaveletTree(sequence, symbols)
    monkeypatch.setattr("pricewright.llm.fm_dedup.WaveletTree", tree)
    _, lengths = Segments(np.concatenate(texts), bounds, 4).match(~later, later, node)
    assert sizes and max(sizes) <= 6
    want = [min(4, longest_match(bytes(x[i:].tolist()), [bytes(y.tolist())])) for y, x in zip(texts[::2], texts[1::2]) for i in range(12)]
    assert lengths.tolist() == want


def test_the_statistics_decide(monkeypatch):
    """Lengths that only tell how far a segment's end is give another answer."""
    one, two, other = ("a b c d", "x b c d", "x y c d")
    raw = np.frombuffer("".join((one, two, other)).encode(), np.uint8)
    bounds, n, owners = np.array([0, 7, 14, 21]), np.array([2, 2, 2]), np.array([1, 2, 3])
    solved = lambda: (word_solver(3)(raw, bounds, n, owners) < np.repeat(owners, n)).tolist()
    assert solved() == [False, False, False, True, False, False]
    ends = lambda self, symbols, first, stop, base: np.repeat(stop, len(symbols) // len(stop)) - np.arange(len(symbols))
    monkeypatch.setattr("pricewright.llm.fm_dedup.FMIndex.match", ends)
    assert solved() != [False, False, False, True, False, False]


# -- near copies -------------------------------------------------------------------


def shingle_set(text, n):
    w = words((text or "").translate(UPPER))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def test_sets_are_made_in_pieces(monkeypatch):
    """The same sets and keys whatever the piece, and little memory beside them."""
    rng = np.random.default_rng(5)
    texts = [rng.choice([b"ab", b"C", b"\xc3\xa9t", b"d\n"], n) for n in (0, 3, 40, 2, 700, 0, 90)] + [[b""]]
    raw = np.frombuffer(b" ".join([b""] + [b" ".join(t) for t in texts]), np.uint8)
    bounds = np.concatenate(([0], np.cumsum([1 + len(b" ".join(t)) for t in texts])))
    want = [x.tolist() for x in parity_join.shingles(raw, bounds, 3)]
    limits = (1, 50, 1000)
    for limit in limits:
        monkeypatch.setattr(parity_join, "text_pieces", lambda r, b, n=limit: textbytes.text_pieces(r, b, n))
        assert [x.tolist() for x in parity_join.shingles(raw, bounds, 3)] == want
    monkeypatch.undo()
    many = np.tile(np.frombuffer(b"seven green lights walk under stones " * 27, np.uint8), 2000)
    tracemalloc.start()
    hashes, of = parity_join.shingles(many, 999 * np.arange(2001), 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(of) == 2001 and most < 12 * len(many)


def plain_components(rows, n, percent):
    sets = [shingle_set(text, n) for _, text, *_ in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                label[root(i)] = root(j)
    least = defaultdict(lambda: LAST)
    for i, (doc, *_) in enumerate(rows):
        least[root(i)] = min(least[root(i)], order(doc))
    out = Counter()
    for i, (doc, *_) in enumerate(rows):
        component = least[root(i)] if sets[i] else order(doc)
        out[(doc, len(sets[i]), None if component == LAST else component)] += 1
    return out, len({root(i) for i in range(len(rows)) if sets[i]}) + sum(not s for s in sets)


def test_copies_share_keys_once(spark):
    """Copies in several chunks do not multiply the rows of their class."""
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(i, base if i % 2 else base + " more") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5, "doc_id")
    keys = parity_join.shared_keys(parity_join.sketched(docs, "doc_id", "text", 3), 3, Limits(90))
    assert keys.select("class").distinct().count() == 2
    assert keys.count() == keys.distinct().count()


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_every_link(odd, odd_rows, n, percent):
    """Also links inside a component that others hold together."""
    sets = [frozenset(shingle_set(text, n)) for _, text, *_ in odd_rows]
    similar = lambda a, b: a and b and 100 * len(a & b) >= percent * len(a | b)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if similar(sets[i], sets[j])]
    got = jaccard_links(odd.repartition(5, "doc_id"), words=n, percent=percent).collect()
    assert sum(r["links"] for r in got) == len(pairs)
    assert len({(r["a"], r["b"]) for r in got}) == len(got) == len({frozenset((sets[i], sets[j])) for i, j in pairs})


@pytest.mark.parametrize("n,percent,rounds", [(3, 90, 2), (5, 80, 1), (3, 60, 0)])
def test_components(odd, odd_rows, n, percent, rounds):
    got = jaccard_components(odd, words=n, percent=percent, rounds=rounds)
    want, groups = plain_components(odd_rows, n, percent)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == want
    assert got.where("first").count() == groups


def test_a_chain_of_near_copies(spark):
    """Each text is similar to its neighbours only; all are one component."""
    w = [f"w{i}" for i in range(400)]
    rows = [(50 - k, " ".join(w[6 * k : 6 * k + 200])) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_components(df, rounds=1)
    want, _ = plain_components(rows, 3, 90)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == want
    assert got.select("component_id").distinct().count() == 1


def test_one_of_each_group_stays(odd, odd_rows):
    got = without_near_copies(odd, words=5, percent=80)
    assert got.columns == odd.columns
    _, groups = plain_components(odd_rows, 5, 80)
    assert got.count() == groups
    assert rows_of(got, "doc_id", "text") - Counter((d, t) for d, t, _ in odd_rows) == Counter()


def test_near_copies_of_nothing(nothing):
    assert jaccard_components(nothing).count() == 0
    assert without_near_copies(nothing).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(0, 10_000), st.sampled_from([60, 80, 90]))
def test_similar_sets_share_a_key(n, seed, percent):
    """As many elements replaced or dropped as the similarity allows."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64)
    drop = rng.integers(0, n * (100 - percent) // 100 + 1)
    b = a[: n - drop]
    spare = (100 * len(b) - percent * n) // percent
    b = np.concatenate((b, rng.integers(0, 1 << 63, max(0, spare), dtype=np.int64).astype(np.uint64)))
    common = n - drop
    if 100 * common < percent * (n + len(b) - common) or not len(b):
        return
    keys, counts = sketch_keys(np.concatenate((np.sort(a), np.sort(b))), np.array([0, n, n + len(b)]), Limits(percent))
    assert set(keys[: counts[0]].tolist()) & set(keys[counts[0] :].tolist())


def test_short_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 400, n).astype(np.uint64)) for n in rng.integers(1, 300, 2))
        both = parity_join.short_sketches(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
        assert np.bitwise_count(both[0] ^ both[1]).sum() <= len(np.setxor1d(a, b))


def test_long_sketches_never_differ_more_than_sets_and_tell_strangers_apart():
    rng = np.random.default_rng(3)
    draw = lambda n: np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64))
    for n in (1, 63, 64, 65, 1000, 5000, 20_000):
        common, more, fewer = draw(n), draw(n // 8 + 1), draw(n // 8 + 1)
        a, b = np.union1d(common, more), np.union1d(common, fewer)
        x, y = parity_join.long_sketches(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
        assert parity_join.sketches_differ(x, y) <= len(np.setxor1d(a, b))
        if n > 100:
            stranger = draw(len(a))
            (z,) = parity_join.long_sketches(stranger, np.array([0, len(stranger)]))
            assert 180 * parity_join.sketches_differ(x, z) > 20 * (len(a) + len(stranger))


@pytest.mark.parametrize("size", [60, 100, 300, 1100, 3000])
def test_strangers_share_no_keys(size):
    """Empty parts are the same in strangers; hardly any set has to offer them."""
    rng = np.random.default_rng(size)
    hashes = np.sort(rng.integers(0, 1 << 63, (1000, size), dtype=np.int64).astype(np.uint64), axis=1).ravel()
    keys, _ = sketch_keys(hashes, np.arange(0, 1001 * size, size), Limits(80))
    assert np.unique(keys, return_counts=True)[1].max() <= 5


def _twins():
    """A long word and its a/b-swapped twin in Thue-Morse order, which collide modulo 2^64."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_twin_words_are_different_texts(spark):
    one, other = _twins()
    docs = spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in parity_join.jaccard_components(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_windows_of_twin_words_do_not_repeat(spark):
    shared, (one, other) = " ".join(f"w{i}" for i in range(49)), _twins()
    docs = spark.createDataFrame([(1, f"{shared} {one}"), (2, f"{shared} {other}"), (3, f"x {shared} {one}")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in remove_repeated_words(docs).collect()}
    assert got == {1: (0, f"{shared} {one}"), 2: (0, f"{shared} {other}"), 3: (50, "x")}


@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=1, max_size=60), st.integers(0, 40))
def test_span_hashes_do_not_depend_on_the_place(values, before):
    x = np.array(values, np.uint64)
    moved = np.concatenate((np.full(before, 7, np.uint64), x))
    here = span_hashes(prefix_sums(x), np.array([0]), np.array([len(x)]))
    there = span_hashes(prefix_sums(moved), np.array([before]), np.array([before + len(x)]))
    assert here == there == gram_hashes(prefix_sums(moved), len(x))[-1]
