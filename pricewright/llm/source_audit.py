"""Source divergence audit: how the words of each source differ from the others of its language.

Every source of a language, and the language as a whole, gives each kept term of
the language a share in whole billionths, ``share`` below; two shares p and q
diverge by ``floor((p - q)^2 / q)``. ``pair`` rows sum that over all kept terms for
each ordered pair of sources of a language; ``term`` rows list the terms that a
source uses more than its language does, the largest divergence first.

Tasks count the terms of their texts in packed form (``packed_terms``) and hand
on one row for each term, source and chunk of texts, which Spark adds up before
it shuffles them. Pairs of sources are summed from three parts: the terms of
one source against the other's share of an absent term (by how often each count
occurs), terms absent in both, and a correction for terms that both hold, which is
added up inside tasks over blocks of terms; no pair of rows ever leaves a task.

Defined cases: a null text, language or source counts as empty; a text without
terms still makes its source occur; repeated rows, also with equal ids, are documents
of their own; terms may be of any length; columns other than the three are not
read; an empty table, or one without kept terms and with one source a language,
gives an empty table; without kept terms pairs have the value 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written
from .packed_terms import COLUMNS, TERM, counted, runs_of, term_text
from .repeats import slices
from .textbytes import lower_ascii, texts_of

BILLION = 1_000_000_000
MIN_DOCS = 3
TOP = 200
SLICE_BYTES = 4_000_000
# Rows of terms in a block; each block hands on a sum for each pair of sources it has seen.
BLOCK_ROWS = 50_000

# Bytes of terms: ASCII letters and all that is not ASCII.
_TERM_BYTES = np.zeros(256, bool)
_TERM_BYTES[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def counted_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows of ``lang``, ``source``, a term and its counts, one or more for each; a row without ``n`` says that the group occurs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for part in slices(batch, np.diff(texts_of(batch.column(0))[1]), SLICE_BYTES):
                raw, bounds = texts_of(part.column(0))
                numbers: dict[tuple[str, str], int] = {}
                names = zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)
                group = np.array([numbers.setdefault(x, len(numbers)) for x in names], np.int64)
                known = [pa.array(x, pa.string()) for x in zip(*numbers, strict=True)]
                nothing = [pa.nulls(len(numbers), kind) for kind in (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*known, *nothing], names=out)
                raw = lower_ascii(raw)
                starts, ends, of = runs_of(_TERM_BYTES[raw], bounds)
                for found in counted(raw, starts, ends, of, group[of]):
                    yield pa.RecordBatch.from_arrays([*[x.take(pa.array(found.group)) for x in known], *found.columns()], names=out)

    schema = f"lang string, source string, {COLUMNS}"
    out = [x.split()[0] for x in schema.split(", ")]
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))]
    return docs.select(*plain).mapInArrow(work, schema)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / (total + terms)), exactly; null without terms."""
    wide = [F.lit(BILLION).cast("decimal(10,0)") * (count + 1).cast("decimal(18,0)"), F.nullif(total + terms, F.lit(0)).cast("decimal(19,0)")]
    return F.lit(1).cast("long") + F.call_function("div", *wide)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _corrections(kept: DataFrame, blocks: int) -> DataFrame:
    """Per ordered pair of sources: over the terms both hold, what their true divergence adds to the
    sum that takes each as absent from the other (and takes away the one that takes it as absent from both)."""

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    def work(table: pa.Table) -> pa.Table:
        langs, sources = (table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
        lang, source = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (langs, sources))
        terms = [table.column(c).combine_chunks() for c in TERM]
        long = terms[2].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        order = np.lexsort((long, *[x.to_numpy(zero_copy_only=False) for x in terms[1::-1]], lang))
        keys = [x[order] for x in (lang, *[x.to_numpy(zero_copy_only=False) for x in terms[:2]], long)]
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        number = np.cumsum(new)
        lang, source = lang[order], source[order]
        p, absent = (table.column(c).to_numpy()[order] for c in ("p", "absent"))
        total: dict[int, int] = {}
        for step in range(1, int(np.bincount(number).max())):
            i = np.flatnonzero(number[step:] == number[:-step])
            for a, b in ((i, i + step), (i + step, i)):
                value = f(p[a], p[b]) - f(p[a], absent[b]) - f(absent[a], p[b]) + f(absent[a], absent[b])
                pair, at = np.unique((lang[a] * len(sources.dictionary) + source[a]) * len(sources.dictionary) + source[b], return_inverse=True)
                sums = np.zeros(len(pair), np.int64)
                np.add.at(sums, at, value)
                for k, v in zip(pair.tolist(), sums.tolist(), strict=True):
                    total[k] = total.get(k, 0) + v
        code = np.array(list(total), np.int64)
        n = len(sources.dictionary)
        columns = [langs.dictionary.take(pa.array(code // (n * n))), sources.dictionary.take(pa.array(code // n % n)), sources.dictionary.take(pa.array(code % n))]
        return pa.table([*columns, pa.array(list(total.values()), pa.int64())], names=["lang", "source", "item", "value"])

    dealt = kept.withColumn("block", F.pmod(F.xxhash64("lang", *TERM), F.lit(blocks)))
    rows = dealt.select("block", "lang", "source", *TERM, "p", "absent")
    return rows.groupBy("block").applyInArrow(work, "lang string, source string, item string, value long")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank`` as described above."""
    added = counted_terms(docs, text, lang, source).groupBy("lang", "source", *TERM).agg(F.sum("n").alias("n"), F.sum("n_texts").alias("n_texts"))
    # A window over the few sources of a term; the rows that only name a group have no term.
    same = Window.partitionBy("lang", *TERM)
    counts = added.withColumns({
        "docs": F.sum("n_texts").over(same),
        "in_lang": F.sum("n").over(same),
        "first": (F.row_number().over(same.orderBy("source")) == 1).cast("int"),
    })
    counts = written(counts.where(F.col("n").isNull() | (F.col("docs") >= min_docs)), "terms")
    kept = counts.where("n IS NOT NULL")
    groups = counts.groupBy("lang", "source").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("n").alias("present"), F.coalesce(F.sum(F.when(F.col("n").isNotNull(), F.col("first"))), F.lit(0)).alias("firsts"))
    whole = Window.partitionBy("lang")
    groups = groups.withColumns({"terms": F.sum("firsts").over(whole), "lang_total": F.sum("total").over(whole)})
    groups = written(groups.withColumn("absent", share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))).drop("firsts"), "sources")

    shared = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    q = share(F.col("in_lang"), F.col("lang_total"), F.col("terms"))
    more = shared.withColumn("q", q).where("p > q").select("lang", "source", *TERM, divergence(F.col("p"), F.col("q")).alias("value"))
    ranked = more.withColumn("item", term_text())
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_term = ranked.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    # How often each count occurs in a source stands for the terms themselves.
    histogram = shared.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    others = groups.select("lang", F.col("source").alias("other"), F.col("absent").alias("other_absent"))
    against = histogram.join(others, "lang").where("source <> other")
    wide = "decimal(38,0)"
    forth = against.select("lang", "source", F.col("other").alias("item"), (F.col("m") * divergence(F.col("p"), F.col("other_absent")).cast("decimal(19,0)")).cast(wide).alias("value"))
    back = against.select("lang", F.col("other").alias("source"), F.col("source").alias("item"), (F.col("m") * divergence(F.col("other_absent"), F.col("p")).cast("decimal(19,0)")).cast(wide).alias("value"))
    pairs = groups.alias("a").join(groups.alias("b"), "lang").where("a.source <> b.source")
    neither = (F.col("a.terms") - F.col("a.present") - F.col("b.present")) * F.coalesce(divergence(F.col("a.absent"), F.col("b.absent")), F.lit(0)).cast("decimal(19,0)")
    base = pairs.select("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), neither.cast(wide).alias("value"))
    both = _corrections(shared, 1 + kept.count() // BLOCK_ROWS).withColumn("value", F.col("value").cast(wide))
    summed = base.unionByName(forth).unionByName(back).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    by_pair = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return by_pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(by_term)
