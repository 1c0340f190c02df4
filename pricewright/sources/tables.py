"""Readers for the input tables, in batch and as file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Column names and types of the tables, as the files store them (fixed values).
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; the schema is declared, so no footer is read to plan."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def stream_path(sf_dir: str, name: str) -> str:
    """A pattern that a stream can read whether the table is a file or a folder of files."""
    return f"{sf_dir}/{name}.parque[t]"


def load_stream(spark: SparkSession, folder: str, name: str = "events", max_files: int | None = None) -> DataFrame:
    """Read a folder of parquet files of one table as a stream.

    Watermarks need ``timestamp``, so the wall-clock columns are cast to it;
    the session time zone should be UTC. What has arrived is one batch, unless
    ``max_files`` splits it: then files must arrive in the order of their times.
    """
    reader = spark.readStream.schema(SCHEMAS[name])
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    df = reader.parquet(folder)
    clocks = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in clocks})
