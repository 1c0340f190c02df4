"""A corpus from raw documents: filter, deduplicate, mix and encode.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's rows to the shared folder and hands the reread table on. All but
the last stage return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pricewright.llm import quality_rules
from pricewright.llm.line_dedup import dedup_lines
from pricewright.llm.mixing import mix_sources
from pricewright.llm.parity_join import without_near_copies
from pricewright.llm.piece_codec import encode_documents
from pricewright.session import written
from pricewright.sources.tables import load

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with ``n_chars`` as the text now is."""
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.judge(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand in an earlier document."""
    return _documents(dedup_lines(docs.select(*COLUMNS)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity of 0.8)."""
    return without_near_copies(docs.select(*COLUMNS), words=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, a row for each pass over its source."""
    return _documents(mix_sources(docs.select(*COLUMNS)).taken_texts())


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``n_tokens``, ``ids`` and the text ``decoded`` from them."""
    return encode_documents(docs.select(*COLUMNS), MODEL)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", pieces),
]

# Shingle sets, hashed draws and the tokenizer have no SQL form; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0]}")
    return docs
