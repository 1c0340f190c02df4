"""URL filter: fixed host rules first, then a logistic regression on n-grams.

Features are counts of hashed character n-grams of ``host`` and of ``path``,
scaled to unit length. The regression is trained from a small labelled URL
table; ``train`` fits it on at most ``sample`` distinct labelled URLs (those
with the smallest hashes, so the choice is repeatable) and ``judge`` applies it
to every row where no rule fits. The weights have a fixed size.

Defined cases: a null URL, or one without ``://``, has an empty host and path
and is judged by the regression's intercept; with no or one-sided labels all
weights stay 0 and the verdict is the more frequent label, block on a tie;
other columns pass through, columns named like an output are replaced;
repeated rows stay; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .textbytes import byte_values, gram_hashes, prefix_sums, texts_of

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GRAMS = (3, 4, 5)
DIMENSIONS = 1 << 16
SAMPLE = 20_000

# Host, path and verdict of the rules (fixed values).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    found = F.when(F.instr(url, "://") > 0, F.substr(url, F.char_length(rest) + 4))
    return F.coalesce(F.translate(F.regexp_extract(found, r"^[^/?#]*", 0), UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring_index(url, "://", 1)
    found = F.when(F.instr(url, "://") > 0, F.substr(url, F.char_length(rest) + 4))
    return F.coalesce(F.regexp_extract(found, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """Adds ``host``, ``path``, the longest fitting ``rule`` and its verdict."""
    host, path = F.col("host"), F.col("path")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for of_host, of_path, outcome in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == of_host) | host.endswith(f".{of_host}")) & path.startswith(of_path)
        rule = F.when(fits, F.lit(of_host + of_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(outcome)).otherwise(verdict)
    split = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    return split.withColumns({"rule": rule, "rule_verdict": verdict})


def features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the features, rows scaled to unit length."""
    rows, columns = [], []
    for salt, texts in enumerate((hosts, paths)):
        raw, bounds = texts_of(texts)
        sums = prefix_sums(byte_values(raw))
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for m in GRAMS:
            hashes = gram_hashes(sums, m)
            whole = owner[: len(hashes)] == owner[m - 1 : m - 1 + len(hashes)]
            rows.append(owner[: len(hashes)][whole])
            columns.append(((hashes[whole] >> np.uint64(salt * 16)) % np.uint64(DIMENSIONS)).astype(np.int64))
    row, column = np.concatenate(rows), np.concatenate(columns)
    pairs, counts = np.unique(row * DIMENSIONS + column, return_counts=True)
    row, column = pairs // DIMENSIONS, pairs % DIMENSIONS
    length = np.sqrt(np.bincount(row, counts.astype(float) ** 2, minlength=len(hosts)))
    return row, column, counts / length[row] if len(row) else counts.astype(float)


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    intercept: float

    def blocked(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        row, column, value = features(hosts, paths)
        return self.intercept + np.bincount(row, self.weights[column] * value, minlength=len(hosts)) >= 0


def train(labelled: DataFrame, sample: int = SAMPLE, steps: int = 200, rate: float = 8.0, decay: float = 1e-4) -> UrlModel:
    """Fit on ``host``, ``path`` and ``verdict`` of a bounded sample of distinct URLs."""
    distinct = labelled.select("host", "path", "verdict").where("verdict IS NOT NULL").distinct()
    rows = distinct.orderBy(F.xxhash64("host", "path"), "host", "path", "verdict").limit(sample).toArrow()
    wanted = np.array([v == "block" for v in rows.column("verdict").to_pylist()], float)
    weights = np.zeros(DIMENSIONS)
    if wanted.size == 0 or wanted.min() == wanted.max():
        return UrlModel(weights, 1.0 if wanted.size == 0 or wanted[0] else -1.0)
    row, column, value = features(rows.column("host").combine_chunks(), rows.column("path").combine_chunks())
    share = wanted.mean()
    intercept, n = float(np.log(share / (1 - share))), len(wanted)
    for _ in range(steps):
        odds = intercept + np.bincount(row, weights[column] * value, minlength=n)
        error = 1 / (1 + np.exp(-odds)) - wanted
        weights -= rate * (np.bincount(column, error[row] * value, minlength=DIMENSIONS) / n + decay * weights)
        intercept -= rate * float(error.mean())
    return UrlModel(weights, intercept)


def judge(pages: DataFrame, model: UrlModel, url: str = "url", rules=RULES) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict``."""
    ruled = with_rule(pages, url, rules).drop("verdict")
    names = [c for c in ruled.columns if c not in ("host", "path", "rule", "rule_verdict")]
    ruled = ruled.select(*names, "host", "path", "rule", "rule_verdict")
    schema = T.StructType([*ruled.schema.fields[:-1], T.StructField("verdict", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, path, _, verdict = batch.columns[-4:]
            said = pa.array(np.where(model.blocked(host, path), "block", "allow").tolist(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pc.coalesce(verdict, said)], names=schema.names)

    return ruled.mapInArrow(work, schema)
