"""Removing passages that also stand in a document with a smaller id.

A window is a fixed number of consecutive units (bytes or words) of one document.
Its anchor is the smallest hash of the shorter grams in it, so equal windows have
equal anchors. A document is cut into segments, runs of windows with one anchor:

1. Documents are packed into chunks. ``repeats`` tells which anchors occur in
   more than one chunk; the others can't belong to a repeated window.
2. Segments with a repeated anchor go to the shard of their anchor, with text.
   Equal ones go once per chunk, in their smallest document there: in larger
   documents all their windows are repeated, and further ones in the same
   document (twins) take over its answer. Exact copies of whole texts stay out:
   they only need their smallest id.
3. A shard keeps each distinct segment once with its smallest document and hands
   the segments of anchors that have several contents to an index (``solve``)
   which finds the smallest document of every window.
4. The removed runs go back to their chunks.

Anchors that occur in very many chunks are dealt to several shards by segment
content, as many as their frequency asks for. What such a shard finds is partial:
the windows for which it knows no smaller document (one document per distinct
window) are merged across shards by binary search among sorted window hashes.

Defined cases: a null text is empty; a null id counts as larger than all others,
and rows with one id never remove from each other; texts shorter than a window
stay whole; repeated rows each give a row; extra columns are not read; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.recfunctions import repack_fields as packed
from pyspark.sql import DataFrame, functions as F

from ..session import written
from .repeats import chunk_rows, heats, known_ids, packed_texts, unpacked, with_flags
from .textbytes import Sums, byte_values, gram_hashes, mix, prefix_sums, sliding_min, span_hashes, words_of

# Text per shard; of it, a shard gets the segments that may repeat.
SHARD_BYTES = 3_500_000
# Longer runs (of periodic text) are cut, so that no segment is much longer than others.
MOST_WINDOWS = 128
# Halvings of an anchor's chunk count that one shard takes.
SHARD_HEAT = 7
RUN = "chunk long, runs binary"
RUN_KIND = np.dtype([("at", "<i4"), ("n", "<u2")])
# Windows that take over what is found for as many windows from ``of`` on.
TWIN_KIND = np.dtype([("of", "<i4"), ("at", "<i4"), ("n", "<u2")])

# solve(bytes, bounds, n_windows, owners, groups) -> for every window, in order, a number below its
# owner if a smaller owner has it, else its owner. Equal windows are in segments of equal groups.
Solve = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Units:
    """What windows are made of: hashed units, and where they lie in the bytes."""

    values: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def byte_units(raw: np.ndarray, bounds: np.ndarray) -> Units:
    places = np.arange(len(raw))
    return Units(byte_values(raw), bounds, places, places + 1)


def word_units(raw: np.ndarray, bounds: np.ndarray) -> Units:
    starts, ends, of_texts = words_of(raw, bounds)
    return Units(span_hashes(prefix_sums(byte_values(raw)), starts, ends), of_texts, starts, ends)


@dataclass(frozen=True)
class Segments:
    """Runs of windows with one anchor: window numbers from ``first`` to ``stop``."""

    text: np.ndarray
    first: np.ndarray
    stop: np.ndarray
    anchor: np.ndarray


def segments_of(units: Units, sums: Sums, window: int, gram: int) -> Segments:
    least = sliding_min(gram_hashes(sums, gram), window - gram + 1)
    owner = np.repeat(np.arange(len(units.bounds) - 1), np.diff(units.bounds))
    n = len(least)
    whole = owner[:n] == owner[window - 1 : window - 1 + n]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:n] != owner[: n - 1])
    edge = np.flatnonzero(np.concatenate((new | ~whole, [True]))) if n else np.zeros(1, np.int64)
    first = edge[:-1][whole[edge[:-1]]]
    stop = edge[1:][whole[edge[:-1]]]
    pieces = -(-(stop - first) // MOST_WINDOWS)
    if len(pieces) and pieces.max() > 1:
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(first, pieces) + step * MOST_WINDOWS
        stop = np.minimum(np.repeat(stop, pieces), first + MOST_WINDOWS)
    return Segments(owner[first], first, stop, least[first])


def _gather(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans one after another, and their bounds."""
    lengths = ends - starts
    return raw[_places(starts, lengths)], np.concatenate(([0], np.cumsum(lengths)))


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of spans one after another."""
    offsets = np.cumsum(lengths) - lengths
    return np.repeat(starts - offsets, lengths) + np.arange(lengths.sum())


def _once(content: np.ndarray, anchor: np.ndarray, n: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of segments, by number: one of each content in its smallest document, those in larger
    documents, further ones in the smallest document, and the first ones that these equal."""
    order = np.argsort(content, kind="stable")
    c, a, m, d = content[order], anchor[order], n[order], doc[order]
    new = np.concatenate(([True], (c[1:] != c[:-1]) | (a[1:] != a[:-1]) | (m[1:] != m[:-1])))
    kind = np.cumsum(new) - 1
    larger = d > np.minimum.reduceat(d, np.flatnonzero(new))[kind]
    same = np.flatnonzero(~larger)
    first = np.concatenate(([True], np.diff(kind[same]) != 0))
    heads = order[same[first]]
    return heads, order[larger], order[same[~first]], heads[kind[same[~first]]]


def runs_blob(chunk: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.Table:
    """Runs of removed windows (first window in the chunk and length), one packed row per chunk."""
    order = np.lexsort((at, chunk))
    chunk, pairs = chunk[order], np.empty(len(order), RUN_KIND)
    pairs["at"], pairs["n"] = at[order], n[order]
    cuts = np.flatnonzero(np.diff(chunk)) + 1
    blobs = [x.tobytes() for x in np.split(pairs, cuts)] if len(chunk) else []
    return pa.table({"chunk": pa.array(chunk[np.append(0, cuts)] if len(chunk) else [], pa.int64()), "runs": pa.array(blobs, pa.binary())})


def _pieces(flags: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of set flags within a row: row, first place and length."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (np.diff(row[at]) != 0)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    return row[at[begin]], place[at[begin]], place[at[end]] + 1 - place[at[begin]]


# What a segment carries besides its bytes, column by column in a compressed blob.
META = {"anchor": np.uint32, "content": np.uint64, "doc": np.int64, "at": np.int32, "n": np.uint16, "size": np.int32, "split": np.bool_}


def _packed(columns: dict[str, np.ndarray], zstd: zstandard.ZstdCompressor) -> bytes:
    return zstd.compress(b"".join(columns[k].astype(kind).tobytes() for k, kind in META.items()))


def _opened(blobs: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The columns of several blobs, and how many rows each blob had."""
    width = sum(np.dtype(kind).itemsize for kind in META.values())
    found, counts = {k: [] for k in META}, []
    for blob in map(zstandard.decompress, blobs):
        n, at = len(blob) // width, 0
        counts.append(n)
        for k, kind in META.items():
            found[k].append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {k: np.concatenate(v) for k, v in found.items()}, np.array(counts)


def repeated_runs(chunks: DataFrame, cut: Callable, window: int, gram: int, solve: Solve, shard_bytes: int, shard_heat: int) -> tuple[DataFrame, DataFrame]:
    """``chunk`` and packed runs of windows that repeat; ``chunk`` and its copies."""
    size = chunks.agg(F.sum("n_bytes")).first()[0] or 0

    def cut_chunk(chunk: dict) -> tuple:
        ids, _, raw, bounds = unpacked(chunk)
        units = cut(raw, bounds)
        sums = prefix_sums(units.values)
        return ids, raw, units, sums, segments_of(units, sums, window, gram)

    flagged, buckets = with_flags(chunks, ["ids", "known", "bounds", "texts", "n_bytes"], lambda c: mix(cut_chunk(c)[-1].anchor), size // 14)

    # Whole texts that stand in a smaller document too; their windows are all repeated.
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunk_rows(batches):
            ids = known_ids(chunk)
            columns = [np.full(len(ids), chunk["chunk"]), np.arange(len(ids)), ids, *[np.frombuffer(chunk[k], np.int64) for k in ("h1", "h2")]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["chunk", "text", "id", "h1", "h2"])

    rows = chunks.select("chunk", "ids", "known", "h1", "h2").mapInArrow(hashed, "chunk long, text long, id long, h1 long, h2 long")
    smallest = rows.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    copies = rows.join(smallest, ["h1", "h2"]).where("id > least").groupBy("chunk").agg(F.collect_list("text").alias("copies"))
    shards = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // shard_bytes)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdCompressor(level=1)
        for chunk in chunk_rows(batches):
            ids, raw, units, sums, found = cut_chunk(chunk)
            if not len(found.anchor):
                continue
            heat = heats(chunk, mix(found.anchor), buckets)
            copy = np.zeros(len(ids), bool)
            copy[np.array(chunk["copies"] or [], np.int64)] = True
            # Anchors that repeat within the chunk, in different documents.
            order = np.argsort(found.anchor, kind="stable")
            starts = np.flatnonzero(np.concatenate(([True], np.diff(found.anchor[order]) != 0)))
            owner = ids[found.text[order]]
            several = np.minimum.reduceat(owner, starts) < np.maximum.reduceat(owner, starts)
            local = np.zeros(len(order), bool)
            local[order] = np.repeat(several, np.diff(np.append(starts, len(order))))
            use = np.flatnonzero((local | (heat > 0)) & ~copy[found.text])
            text, first, stop, anchor = found.text[use], found.first[use], found.stop[use], found.anchor[use]
            if not len(use):
                continue
            content = span_hashes(sums, first, stop + window - 1)
            heads, larger, twins, twin_of = _once(content, anchor, stop - first, ids[text])
            if len(larger) or len(twins):
                settled, same = np.empty(len(larger), RUN_KIND), np.empty(len(twins), TWIN_KIND)
                settled["at"], settled["n"] = first[larger], (stop - first)[larger]
                same["of"], same["at"], same["n"] = first[twin_of], first[twins], (stop - first)[twins]
                values = (-1 - chunk["chunk"] % shards, 0, chunk["chunk"], settled.tobytes(), same.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for v in values], names=SEGMENT_COLUMNS)
            use, text, first, stop, anchor, content = (x[heads] for x in (use, text, first, stop, anchor, content))
            salts = np.uint64(1) << np.maximum(heat[use].astype(np.int64) - shard_heat, 0).astype(np.uint64)
            shard_no, salt = (anchor % np.uint64(shards)).astype(np.int64), (content % salts).astype(np.int64)
            starts, ends = units.starts[first], units.ends[stop + window - 2]
            columns = {
                "anchor": (anchor >> np.uint64(32)), "content": content, "doc": ids[text],
                "at": first, "n": stop - first, "size": ends - starts, "split": salts > 1,
            }
            # One row for each shard, with its segments column by column.
            order = np.lexsort((salt, shard_no))
            new = np.concatenate(([True], (np.diff(shard_no[order]) != 0) | (np.diff(salt[order]) != 0)))
            groups = np.split(order, np.flatnonzero(new)[1:])
            heads = np.array([g[0] for g in groups])
            meta = [_packed({k: v[g] for k, v in columns.items()}, zstd) for g in groups]
            words = [zstd.compress(_gather(raw, starts[g], ends[g])[0].tobytes()) for g in groups]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard_no[heads], pa.int64()),
                    pa.array(salt[heads], pa.int64()),
                    pa.array(np.full(len(groups), chunk["chunk"]), pa.int64()),
                    pa.array(meta, pa.binary()),
                    pa.array(words, pa.binary()),
                ],
                names=SEGMENT_COLUMNS,
            )

    def shard(table: pa.Table) -> pa.Table:
        if table.column("shard")[0].as_py() < 0:
            # What the chunks have settled themselves.
            return _found(table.column("chunk"), table.column("meta"), twins=table.column("words"))
        columns, counts = _opened(table.column("meta").to_pylist())
        split, anchor, content, doc, at, size = (columns[k] for k in ("split", "anchor", "content", "doc", "at", "size"))
        n = columns["n"].astype(np.int64)
        blob = np.repeat(np.arange(len(counts)), counts)
        chunk = table.column("chunk").to_numpy()[blob]
        order = np.lexsort((doc, n, content, anchor))
        a, c, m = anchor[order], content[order], n[order]
        new = np.concatenate(([True], (np.diff(a) != 0) | (np.diff(c) != 0) | (np.diff(m) != 0)))
        begin = np.flatnonzero(new)
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        heads, lengths = order[begin], m[begin]
        owner = doc[heads]
        offsets = np.cumsum(lengths) - lengths
        least = np.repeat(owner, lengths)
        larger = doc > owner[kind]
        # Distinct contents of anchors that have more than one.
        new_anchor = np.concatenate(([True], np.diff(a[begin]) != 0))
        contents = np.bincount(np.cumsum(new_anchor) - 1)
        several = np.flatnonzero(np.repeat(contents > 1, contents))
        # Text is opened where it is needed: once for each content.
        open_rows = np.flatnonzero(split & ~larger)
        wanted = np.zeros(len(counts), bool)
        wanted[blob[heads[several]]] = wanted[blob[heads[kind[open_rows]]]] = True
        words = table.column("words")
        raw = np.frombuffer(b"".join(zstandard.decompress(words[i].as_py()) for i in np.flatnonzero(wanted).tolist()), np.uint8)
        held = np.where(wanted[blob], size, 0)
        begins = np.cumsum(held, dtype=np.int64) - held
        if len(several):
            chosen = heads[several]
            least[_places(offsets[several], lengths[several])] = solve(*_gather(raw, begins[chosen], begins[chosen] + size[chosen]), lengths[several], owner[several], anchor[chosen])
        # Which windows of a content a document before its owner has.
        of = np.repeat(np.arange(len(heads)), lengths)
        inside = np.arange(len(of)) - offsets[of]
        gone = least < owner[of]
        run_kind, run_first, run_n = _pieces(gone, of, inside)
        # Back to the rows: the owner's lose these windows, those of larger documents all.
        runs = np.bincount(run_kind, minlength=len(heads))
        whole, own = np.flatnonzero(larger), np.flatnonzero(~larger)
        piece = _places((np.cumsum(runs) - runs)[kind[own]], runs[kind[own]])
        row = np.concatenate((whole, np.repeat(own, runs[kind[own]])))
        out_first = np.concatenate((np.zeros(len(whole), np.int64), run_first[piece]))
        decided = runs_blob(chunk[row], at[row] + out_first, np.concatenate((n[whole], run_n[piece])))
        tables = [_found(decided.column("chunk"), decided.column("runs"))]
        if len(open_rows):
            kinds = kind[open_rows]
            texts = _gather(raw, begins[heads[kinds]], begins[heads[kinds]] + size[heads[kinds]])
            places, number = _places(offsets[kinds], lengths[kinds]), np.repeat(np.arange(len(open_rows)), lengths[kinds])
            places, number = places[~gone[places]], number[~gone[places]]
            mine = open_rows[number]
            who = {"doc": doc[mine], "chunk": chunk[mine], "place": inside[places] + at[mine]}
            tables.append(_open_windows(cut(*texts), number, inside[places], who, window, shards))
        return pa.concat_tables(tables)

    found = with_copies(flagged, copies).mapInArrow(candidates, SEGMENT).groupBy("shard", "salt").applyInArrow(shard, FOUND)
    found = written(found, "repeated_runs")
    merged = found.where("part IS NOT NULL").groupBy("part").applyInArrow(_merge, RUN)
    return found.where("part IS NULL").select("chunk", "runs", "twins").unionByName(merged.withColumn("twins", F.lit(None).cast("binary"))), copies


# A chunk's segments for a shard; below shard 0, its settled runs and its twins.
SEGMENT = "shard long, salt long, chunk long, meta binary, words binary"
SEGMENT_COLUMNS = ["shard", "salt", "chunk", "meta", "words"]
FOUND = "chunk long, runs binary, twins binary, keys binary, part long"
OPEN = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("doc", "<i8"), ("chunk", "<i8"), ("place", "<i4")])


def with_copies(chunks: DataFrame, copies: DataFrame) -> DataFrame:
    return chunks.join(copies, "chunk", "left")


def _found(chunk, runs=None, twins=None, keys=None, part=None) -> pa.Table:
    columns = {"chunk": (chunk, pa.int64()), "runs": (runs, pa.binary()), "twins": (twins, pa.binary()), "keys": (keys, pa.binary()), "part": (part, pa.int64())}
    n = max(len(x) for x, _ in columns.values() if x is not None)
    return pa.table({k: pa.nulls(n, kind) if x is None else x for k, (x, kind) in columns.items()})


def _open_windows(units: Units, number: np.ndarray, inside: np.ndarray, who: dict[str, np.ndarray], window: int, parts: int) -> pa.Table:
    """Windows of split anchors that this shard can't decide, sorted by hash, by ranges of the hash."""
    start = units.bounds[number] + inside
    out = np.empty(len(start), OPEN)
    out["h1"] = span_hashes(prefix_sums(units.values), start, start + window)
    out["h2"] = span_hashes(prefix_sums(mix(units.values)), start, start + window)
    for name, values in who.items():
        out[name] = values
    out = out[np.lexsort((out["doc"], out["h2"], out["h1"]))]
    part = (out["h1"] >> np.uint64(32)).astype(np.int64) * parts >> 32
    cuts = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else np.zeros(0, np.int64)
    blobs = [x.tobytes() for x in np.split(out, cuts[1:])] if len(part) else []
    return _found(None, keys=pa.array(blobs, pa.binary()), part=pa.array(part[cuts], pa.int64()))


def _merge(table: pa.Table) -> pa.Table:
    """Sorted lists of windows from several shards: those with a smaller document elsewhere."""
    lists = [np.frombuffer(x, OPEN) for x in table.column("keys").to_pylist()]
    # The distinct hashes in order; every list finds its windows there by binary search.
    both = ["h1", "h2"]
    keys = np.unique(np.concatenate([packed(x[both]) for x in lists]))
    least = np.full(len(keys), np.iinfo(np.int64).max)
    places = [np.searchsorted(keys, packed(x[both])) for x in lists]
    for x, at in zip(lists, places, strict=True):
        np.minimum.at(least, at, x["doc"])
    gone = np.concatenate([x[least[at] < x["doc"]] for x, at in zip(lists, places, strict=True)])
    return runs_blob(gone["chunk"], gone["place"], np.ones(len(gone), np.int64))


def remove_repeats(
    docs: DataFrame,
    cut: Callable,
    window: int,
    gram: int,
    solve: Solve,
    join: bool,
    id_col: str = "doc_id",
    text: str = "text",
    shard_bytes: int = SHARD_BYTES,
    shard_heat: int = SHARD_HEAT,
) -> DataFrame:
    """Per row: ``id_col``, ``n_units``, ``n_removed``, ``n_spans`` and ``kept`` (bytes).

    ``join`` puts one space between kept units; otherwise bytes are kept as they stand.
    """
    chunks = packed_texts(docs, id_col, text)
    runs, copies = repeated_runs(chunks, cut, window, gram, solve, shard_bytes, shard_heat)
    of_chunk = runs.groupBy("chunk").agg(F.collect_list("runs").alias("runs"), F.collect_list("twins").alias("twins"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunk_rows(batches):
            ids, known, raw, bounds = unpacked(chunk)
            units = cut(raw, bounds)
            n = np.diff(units.bounds)
            found = np.frombuffer(b"".join(chunk["runs"] or []), RUN_KIND)
            twins = np.frombuffer(b"".join(chunk["twins"] or []), TWIN_KIND)
            starts = np.zeros(len(units.values), bool)
            starts[_places(found["at"].astype(np.int64), found["n"].astype(np.int64))] = True
            like = starts[_places(twins["of"].astype(np.int64), twins["n"].astype(np.int64))]
            starts[_places(twins["at"].astype(np.int64), twins["n"].astype(np.int64))[like]] = True
            # From where repeated windows start to the end of the last of them.
            edges = np.diff(starts.astype(np.int8), prepend=0, append=0)
            change = np.zeros(len(units.values) + 1, np.int32)
            change[np.flatnonzero(edges == 1)] = 1
            change[np.flatnonzero(edges == -1) + window - 1] -= 1
            gone = np.cumsum(change)[:-1] > 0
            for text_no in chunk["copies"] or []:
                if n[text_no] >= window:
                    gone[units.bounds[text_no] : units.bounds[text_no + 1]] = True
            owner = np.repeat(np.arange(len(n)), n)
            first = gone.copy()
            first[1:] &= ~gone[:-1] | (owner[1:] != owner[:-1])
            removed, spans = np.bincount(owner[gone], minlength=len(n)), np.bincount(owner[first], minlength=len(n))
            stay = ~gone
            if join:
                kept = _joined(raw, units, stay, owner, len(n))
            else:
                sizes = np.bincount(owner[stay], minlength=len(n))
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
                kept = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(raw[stay])]).cast(pa.binary())
            columns = [pa.array(ids, pa.int64(), mask=~known), *[pa.array(x, pa.int64()) for x in (n, removed, spans)], kept]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_units", "n_removed", "n_spans", "kept"])

    whole = with_copies(chunks, copies).join(of_chunk, "chunk", "left")
    done = whole.mapInArrow(finish, "id long, n_units long, n_removed long, n_spans long, kept binary")
    return done.withColumnRenamed("id", id_col)


def _joined(raw: np.ndarray, units: Units, stay: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """Kept words of each text with one space between them."""
    starts, lengths, of = units.starts[stay], (units.ends - units.starts)[stay], owner[stay]
    last = np.append(of[1:] != of[:-1], True) if len(of) else np.zeros(0, bool)
    sizes = lengths + ~last
    ends = np.cumsum(sizes)
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    inside = np.repeat(np.arange(len(starts)), lengths)
    step = np.arange(len(inside)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[(ends - sizes)[inside] + step] = raw[starts[inside] + step]
    offsets = np.concatenate(([0], np.cumsum(np.bincount(of, sizes, minlength=n)))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.binary())
