"""Personal data by weak supervision: labelers vote on spans, and a classifier decides.

``base_spans`` are the e-mail addresses, IP addresses, card and phone numbers
that have the fixed form. They always count. ``candidates`` adds spans that only
look like one (a spelled-out address, a phone number without a plus sign,
a card number that fails its check digit), where they touch no base span. Six labelers,
two of forms, two of lists (``gazetteer``) and two of the surroundings, vote yes,
no or nothing on every candidate. Expectation-maximisation estimates from the
counts of vote patterns over all documents how reliable each labeler is for a
kind, and so how likely a pattern means personal data. A logistic regression on
votes, shape and neighbouring words, trained to these likelihoods, decides
whether a candidate that isn't a base span is added.

The pattern counts are at most 4 * 3^6 rows, whatever the corpus; the
regression is fitted on at most ``sample`` different candidates of each kind (those with
the smallest hashes), weighted by how often they occur. All documents are read
twice, in whole; every scan is linear in the text.

Defined cases: a null text counts as empty; an empty text has no spans; spans
are in code points with the end exclusive, by start and then by kind as listed;
equal rows get equal results; columns named like an output are replaced, others
pass through; an empty table gives an empty table; with no candidates, or all
of them likely or unlikely, nothing is added.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import written

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 5_000
DIMENSIONS = 1 << 12
ACCEPT = 0.9
ABSTAIN, YES, NO = 0, 1, 2
LABELERS = ("form", "validity", "gazetteer", "words before", "borders", "variety")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LABEL = re.compile(r"[A-Za-z0-9-]+")
_DIGITS = re.compile(r"[0-9]+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# What looks like one of the kinds.
_AT = re.compile(r"\x20?[\[(]\x20?at\x20?[\])]\x20?", re.IGNORECASE)
_SPELLED = re.compile(r"[A-Za-z0-9-]+(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[A-Za-z0-9-]+)+", re.IGNORECASE)
_GROUPS = re.compile(r"[0-9]{2,4}\)?(?:[\x20.-]\(?[0-9]{2,5}\)?){1,4}(?![0-9A-Za-z])")
_WORD = re.compile(r"[^\W\d_]+")

# Top-level domains, first digits of card issuers, country calling codes, and words that stand before a kind or before other numbers.
DOMAINS = frozenset("com org net edu gov int io info biz de fr es uk us eu it nl ch at be pt pl se no dk fi ie ca au nz jp cn in br mx ar ru".split())
ISSUERS = frozenset("3456")
COUNTRIES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
WORDS = {
    "email": frozenset("email mail e contact write address courriel correo reach".split()),
    "ip": frozenset("ip host server address client from addr".split()),
    "card": frozenset("card visa mastercard amex credit pay payment carte tarjeta karte".split()),
    "phone": frozenset("phone tel telephone call fax mobile cell telefon teléfono téléphone contact dial".split()),
}
OTHER_NUMBERS = frozenset("version v page pages isbn no number nr id license section chapter year order invoice ref".split())

Span = tuple[str, int, int]


def _local_start(text: str, end: int, least: int) -> int:
    while end > least and text[end - 1] in _LOCAL:
        end -= 1
    return end


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _small_parts(span: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in span.split("."))


def _digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def _scan(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and what has a base span's form but fails its test."""
    good: list[Span] = []
    bad: list[Span] = []
    at, least = text.find("@"), 0
    while at >= 0:
        start, found = _local_start(text, at, least), _DOMAIN.match(text, at + 1)
        if start < at and found:
            good.append(("email", start, found.end()))
            least = found.end()
        elif start < at and (label := _LABEL.match(text, at + 1)):
            bad.append(("email", start, label.end()))
        at = text.find("@", at + 1)
    upto = {"ip": 0, "card": 0}
    for run in _DIGITS.finditer(text):
        for kind, form in (("ip", _DOTTED), ("card", _CARD)):
            if run.start() >= upto[kind] and (found := form.match(text, run.start())):
                upto[kind] = found.end()
                span = found.group()
                if kind == "ip":
                    (good if _small_parts(span) else bad).append((kind, *found.span()))
                elif 12 <= len(digits := _digits(span)) <= 19:
                    (good if luhn(digits) else bad).append((kind, *found.span()))
    plus, least = text.find("+"), 0
    while plus >= 0:
        found = _PHONE.match(text, plus)
        if found:
            (good if 9 <= len(_digits(found.group())) <= 15 else bad).append(("phone", *found.span()))
        plus = text.find("+", found.end() if found else plus + 1)
    return good, bad


def _in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the spans of the fixed forms, in order."""
    return _in_order(_scan(text)[0])


def candidates(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and spans that look like personal data and touch no base span or each other."""
    good, more = _scan(text)
    for at in _AT.finditer(text):
        start, found = _local_start(text, at.start(), 0), _SPELLED.match(text, at.end())
        if start < at.start() and found:
            more.append(("email", start, found.end()))
    upto = 0
    for run in _DIGITS.finditer(text):
        start = run.start()
        if start < upto or not (found := _GROUPS.match(text, start)):
            continue
        upto = found.end()
        start -= text[start - 1 : start] == "("
        before = text[start - 1 : start]
        if 7 <= len(_digits(found.group())) <= 15 and not (before.isalnum() or before in ("+", ".", "-")):
            more.append(("phone", start, found.end()))
    # Both lists by start; a candidate is tested against the base spans near it.
    taken = sorted((s, e) for _, s, e in good)
    edges = [0]
    for _, e in taken:
        edges.append(max(edges[-1], e))
    starts = [s for s, _ in taken]
    kept, free = [], 0
    for kind, start, end in _in_order(more):
        upto = edges[int(np.searchsorted(starts, end))]  # base spans that start before the candidate's end
        if start >= free and start >= upto:
            kept.append((kind, start, end))
            free = end
    return _in_order(good), kept


def votes(text: str, span: Span, is_base: bool) -> tuple[int, ...]:
    """One vote of each labeler on a candidate."""
    kind, start, end = span
    found = text[start:end]
    digits = _digits(found)
    yes = lambda x: YES if x else NO
    spelled = kind == "email" and "@" not in found
    unsigned = kind == "phone" and not found.startswith("+")
    form = YES if is_base else ABSTAIN if spelled or unsigned else NO
    if kind == "email":
        validity, listed = yes(spelled or _DOMAIN.search(found)), yes(_WORD.findall(found)[-1:] and _WORD.findall(found)[-1].lower() in DOMAINS)
        variety = yes(len(set(found)) >= 5)
    elif kind == "ip":
        first = found.split(".")[0].lstrip("0") or "0"
        validity, listed, variety = yes(_small_parts(found)), yes(len(first) <= 3 and 0 < int(first) < 240), yes(len(set(digits)) >= 2)
    elif kind == "card":
        validity, listed, variety = yes(luhn(digits)), yes(digits[0] in ISSUERS), yes(len(set(digits)) >= 4)
    else:
        validity = YES if 10 <= len(digits) <= 13 else ABSTAIN if 7 <= len(digits) <= 15 else NO
        listed = ABSTAIN if unsigned else yes(any(digits[:n] in COUNTRIES for n in (1, 2)))
        variety = yes(len(set(digits)) >= 3)
    near = {w.lower() for w in _WORD.findall(text[max(0, start - 24) : start])}
    before = YES if near & WORDS[kind] else NO if near & OTHER_NUMBERS else ABSTAIN
    sides = text[max(0, start - 1) : start] + text[end : end + 1]
    borders = yes(not any(c.isalnum() or c in "_=/#\"'" for c in sides))
    return form, validity, listed, before, borders, variety


def features(text: str, span: Span, voted: tuple[int, ...]) -> list[int]:
    """Hashed features of a candidate: votes, shape, words on both sides."""
    kind, start, end = span
    shape = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: f"9{len(m.group())}", text[start : min(end, start + 64)]))
    before, after = _WORD.findall(text[max(0, start - 24) : start]), _WORD.findall(text[end : end + 24])
    named = [f"{i}={v}" for i, v in enumerate(voted)] + [f"shape {shape}", f"before {before[-1].lower() if before else ''}", f"after {after[0].lower() if after else ''}"]
    return sorted({zlib.crc32(f"{kind} {x}".encode()) % DIMENSIONS for x in [*named, ""]})


def _pattern(voted: tuple[int, ...]) -> int:
    return sum(v * 3**i for i, v in enumerate(voted))


def reliabilities(patterns: np.ndarray, counts: np.ndarray, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """By expectation-maximisation: how likely each pattern means yes, and each labeler's chances of its votes.

    The chances are [no, yes] x labeler x vote; a labeler without a vote says nothing. It
    starts from the share of yes among the votes cast.
    """
    cast = (patterns[:, None] // 3 ** np.arange(len(LABELERS))) % 3
    one_hot = np.eye(3)[cast]  # pattern, labeler, vote
    yes, no = (cast == YES).sum(1), (cast == NO).sum(1)
    likely = (yes + 0.5) / (yes + no + 1)
    chances = np.zeros((2, len(LABELERS), 3))
    for _ in range(steps):
        for side, weight in enumerate((1 - likely, likely)):
            share = np.einsum("p,plv->lv", weight * counts, one_hot) + 1.0
            chances[side] = share / share[:, 1:].sum(1, keepdims=True)
        chances[:, :, ABSTAIN] = 1
        prior = (likely @ counts + 1) / (counts.sum() + 2)
        score = np.einsum("plv,slv->ps", one_hot, np.log(chances))
        odds = score[:, 1] - score[:, 0] + np.log(prior / (1 - prior))
        after = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(after - likely).max() < 1e-9:
            break
        likely = after
    return likely, chances


@dataclass(frozen=True)
class SpanModel:
    """A logistic regression on hashed features, and the likelihood of each kind's vote patterns."""

    weights: np.ndarray
    patterns: dict[tuple[str, int], float]

    def likely(self, columns: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[columns].sum(), -50, 50))))


def _voted(docs: DataFrame, text: str) -> DataFrame:
    """``kind``, ``pattern`` and ``features`` of every candidate, base spans included."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, patterns, columns = [], [], []
            for value in batch.column(0):
                value = value.as_py()
                if not value:
                    continue
                good, more = candidates(value)
                for spans, is_base in ((good, True), (more, False)):
                    for span in spans:
                        voted = votes(value, span, is_base)
                        kinds.append(span[0])
                        patterns.append(_pattern(voted))
                        columns.append(features(value, span, voted))
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(patterns, pa.int32()), pa.array(columns, pa.list_(pa.int32()))], names=["kind", "pattern", "features"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(work, "kind string, pattern int, features array<int>")


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE, steps: int = 300, rate: float = 0.5, decay: float = 1e-4) -> SpanModel:
    """Reliabilities from all candidates, and a classifier fitted to them on a bounded sample."""
    distinct = written(_voted(docs, text).groupBy("kind", "pattern", "features").agg(F.count("*").alias("n")), "candidates")
    counted = distinct.groupBy("kind", "pattern").agg(F.sum("n").alias("n"), F.count("*").alias("different")).orderBy("kind", "pattern").toArrow().to_pydict()
    kinds, patterns, n = (np.array(counted[c]) for c in ("kind", "pattern", "n"))
    likely: dict[tuple[str, int], float] = {}
    hashed = F.xxhash64("kind", "pattern", "features")
    low = F.lit(False)
    for kind in KINDS:
        of = kinds == kind
        if of.any():
            chance, _ = reliabilities(patterns[of].astype(np.int64), n[of].astype(float))
            likely |= {(kind, int(p)): float(c) for p, c in zip(patterns[of], chance, strict=True)}
            # About twice the sample passes, so that little meets in one task.
            share = min(1.0, 2 * sample / int(np.array(counted["different"])[of].sum()))
            low = low | ((F.col("kind") == kind) & (hashed.cast("double") <= (2 * share - 1) * 2.0**63))
    place = Window.partitionBy("kind").orderBy("hash", "pattern", "features")
    drawn = distinct.where(low).withColumn("hash", hashed).withColumn("place", F.row_number().over(place)).where(F.col("place") <= sample)
    rows = drawn.orderBy("kind", "place").select("kind", "pattern", "features", "n").toArrow().to_pydict()
    weights = np.zeros(DIMENSIONS)
    wanted = np.array([likely[k, p] for k, p in zip(rows["kind"], rows["pattern"], strict=True)])
    if len(wanted) and wanted.min() < 0.5 <= wanted.max():
        column = np.concatenate([np.array(x, np.int64) for x in rows["features"]])
        row = np.repeat(np.arange(len(wanted)), [len(x) for x in rows["features"]])
        weight = np.log1p(np.array(rows["n"], float))
        weight /= weight.sum()
        for _ in range(steps):
            error = weight * (1 / (1 + np.exp(-np.bincount(row, weights[column], minlength=len(wanted)))) - wanted)
            gradient = np.bincount(column, error[row], minlength=DIMENSIONS)
            # Each feature at its own pace, by how much weight it bears.
            weights -= rate * (gradient / (np.bincount(column, weight[row], minlength=DIMENSIONS) + 1e-3) + decay * weights)
    return SpanModel(weights, likely)


def _text_of(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


OUTPUTS = {"base": T.StringType(), "spans": T.StringType()} | {f"n_{kind}": T.LongType() for kind in KINDS} | {"n_added": T.LongType()}


def find_personal_data(docs: DataFrame, model: SpanModel, text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """Adds ``base`` and ``spans`` (kind:start:end, comma-joined), base spans of each kind, and ``n_added``."""
    plain = [F.col(c) for c in docs.columns if c not in OUTPUTS and c != text]
    given = docs.select(*plain, F.col(text).cast("string").alias("__text"))
    kept = [f for f in given.schema if f.name != "__text"] + ([T.StructField(text, T.StringType())] if text not in OUTPUTS else [])
    schema = T.StructType([*kept, *[T.StructField(n, k) for n, k in OUTPUTS.items()]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new: list[list] = [[] for _ in OUTPUTS]
            for value in batch.column(batch.num_columns - 1):
                value = value.as_py() or ""
                good, more = candidates(value)
                added = []
                for span in more:
                    voted = votes(value, span, False)
                    if model.patterns.get((span[0], _pattern(voted)), 0.0) >= 0.5 and model.likely(features(value, span, voted)) >= accept:
                        added.append(span)
                of_kind = [sum(s[0] == kind for s in good) for kind in KINDS]
                for column, x in zip(new, (_text_of(good), _text_of(_in_order(good + added)), *of_kind, len(added)), strict=True):
                    column.append(x)
            arrays = [pa.array(x, pa.string() if isinstance(k, T.StringType) else pa.int64()) for x, k in zip(new, OUTPUTS.values(), strict=True)]
            old = batch.columns if text not in OUTPUTS else batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*old, *arrays], names=schema.names)

    return given.mapInArrow(work, schema)
