"""Query registry and shared helpers for the registered queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    headline: bool = False


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, headline: bool = False):
    def wrap(fn):
        if name in REGISTRY:
            raise KeyError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql.strip() if sql else None, headline)
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column (and add 0.0 so -0.0 prints as 0.0): the
    oracle compares hashes of values, so both sides round the same way."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append((F.round(F.col(f.name).cast("double"), places) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# Shared derived inputs (the same rule is written in each oracle SQL).
def events_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with a missing value on every 7th event id (the supplied tables
    have no nulls)."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", "user_id", "event_type",
                     F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))


EVENTS_WITH_NULLS_SQL = """
SELECT event_id, user_id, event_type,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value
FROM events"""


def documents_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with its word count: ``n_words = size(split(text, ' '))``."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", F.size(F.split("text", " ")).cast("double").alias("n_words"),
                    F.col("n_chars").cast("double").alias("n_chars"))


DOCUMENTS_WORDS_SQL = """
SELECT doc_id, lang, CAST(len(string_split(text, ' ')) AS DOUBLE) AS n_words,
       CAST(n_chars AS DOUBLE) AS n_chars
FROM documents"""


# DuckDB's names for the Spark types of the supplied tables.
DUCKDB_TYPE_NAMES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
                     "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean", "FLOAT": "float"}
NUMERIC_DUCKDB_TYPES = ["BIGINT", "INTEGER", "DOUBLE", "BOOLEAN", "FLOAT"]


def column_listing_sql(table_name: str, columns: list[str]) -> str:
    """Oracle form of ``list_columns(..., with_counts=True)``."""
    mapping = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DUCKDB_TYPE_NAMES.items())
    numeric = ", ".join(f"'{t}'" for t in NUMERIC_DUCKDB_TYPES)
    counts = " UNION ALL ".join(f"SELECT '{c}' AS name, count({c})::BIGINT AS n_present FROM {table_name}"
                                for c in columns)
    return f"""
SELECT (c.ordinal_position - 1)::INTEGER AS pos, c.column_name AS name,
       CASE c.data_type {mapping} END AS type, c.data_type IN ({numeric}) AS is_numeric, n.n_present
FROM information_schema.columns c JOIN ({counts}) n ON c.column_name = n.name
WHERE c.table_name = '{table_name}'"""


def exact_mean_sql(col: str) -> str:
    """The half-up 6-decimal mean of a non-negative two-decimal column,
    computed exactly (integer cents), as a DOUBLE: the oracle twin of Spark's
    average over DECIMAL(18,2)."""
    cents = f"CAST(sum(CAST({col} AS DECIMAL(18,2))) * 100 AS HUGEINT)"
    n = f"count({col})"
    return (f"CAST(CAST((2 * {cents} * 10000 + {n}) // (2 * {n}) AS DECIMAL(38,0)) "
            f"* CAST(0.000001 AS DECIMAL(18,6)) AS DOUBLE)")


def as_money(df: DataFrame, cols: list[str]) -> DataFrame:
    """Two-decimal amounts read as DECIMAL(18,2), so that sums and means are
    exact."""
    return df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in cols})
