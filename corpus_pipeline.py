"""Corpus pipeline over ``documents``: quality rules, SimHash near-dedup,
repeated passages, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet to the shared checkpoint folder and reread as the next
stage's ``docs``.  All stages but the last return the columns of documents;
``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import packing, quality_rules, secret_scan, simhash_dedup, suffix_dedup
from quarry.session import cut_lineage, cuts_of, drop_cuts, ensure_checkpoint_dir

#: Application -> what its last stage wrote for itself.
_LEFT: dict[str, list[str]] = {}


def _stage(fn):
    """Before a stage, delete what the stage before it wrote for itself: that
    one's result has been written and reread since (where it has not, ``docs``
    still reads those tables and they stay)."""
    @functools.wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        app = spark.sparkContext.applicationId
        drop_cuts(spark, _LEFT.pop(app, []), still_read_by=docs)
        before = set(cuts_of(spark))
        out = fn(spark, docs, sf_dir)
        _LEFT[app] = [p for p in cuts_of(spark) if p not in before]
        return out

    return run


def _recount(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(kind)).select(*docs.columns)


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the
    smallest id."""
    return simhash_dedup.keep_one(docs, words=3, max_bits=2)


@_stage
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut from the text."""
    return _recount(suffix_dedup.cut_repeats(docs, min_len=50))


@_stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text."""
    return _recount(secret_scan.redact(docs))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4,096 tokens: one row per piece, with its ids."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_duplicates), ("suffix_array_dedup", repeated_passages),
          ("secret_scan", secrets), ("pattern_packing", pack)]

#: SQL has no SimHash, transform or tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    written: list[str] = []
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
            drop_cuts(spark, written)
            written = cuts_of(spark)[-1:]
    return docs
