"""Lookup join: attach a table holding one row per key to the rows of a
DataFrame.

A left join that null keys take part in.  Spark's adaptive execution picks the
form from the sizes it has measured: a small lookup table (its own broadcast
limit, ``spark.sql.autoBroadcastJoinThreshold``) is broadcast, otherwise both
sides are shuffled and a partition that one key has blown up is split over
several tasks (``spark.sql.adaptive.skewJoin.enabled``), in pieces of
``spark.sql.adaptive.advisoryPartitionSizeInBytes``, so the number of pieces
follows the rows of the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` left-joined with ``table`` (unique on ``keys``; null keys match
    null keys)."""
    values = [c for c in table.columns if c not in keys]
    right = table.select(*[F.col(k).alias(f"__tk_{k}") for k in keys], *[F.col(v).alias(f"__tv_{v}") for v in values])
    joined = df.join(right, [df[k].eqNullSafe(right[f"__tk_{k}"]) for k in keys], "left")
    return joined.select(*df.columns, *[F.col(f"__tv_{v}").alias(v) for v in values])
