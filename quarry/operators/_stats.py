"""Column statistics attached to data rows.

Every scaler and filter follows one pattern: a single ``agg`` computes all
column statistics in one pass (partial aggregation map-side, one tiny final
exchange), and each data row then reads them.

* Without ``by`` the statistics are one row.  They are read as one scalar
  subquery (``DataFrame.scalar()`` of a struct): Spark runs it once before
  the main job and inlines the value, so the data side needs no join and no
  shuffle.
* With ``by`` they are one row per group, and the number of groups is not
  bounded, so they are attached by ``lookup_join``, whose form adaptive
  execution picks from the measured sizes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators._lookup import lookup_join


def attach(df: DataFrame, stats: DataFrame, by: list[str] | None = None
           ) -> tuple[DataFrame, Callable[[str], Column]]:
    """Return ``(frame, stat)``: ``frame`` is ``df`` (joined to the statistics
    when grouped) and ``stat(name)`` is the Column holding that statistic."""
    if not by:
        # one scalar subquery holding every statistic as a struct, projected
        # once: later references are field accesses on a column, so chained
        # operators do not copy the subquery into each expression
        col = f"__stats_{uuid.uuid4().hex[:10]}"
        frame = df.withColumn(col, stats.select(F.struct(*stats.columns)).scalar())
        return frame, lambda name: F.col(col)[name]
    return lookup_join(df, stats, by), F.col


def grouped_agg(df: DataFrame, by: list[str] | None, exprs: list[Column]) -> DataFrame:
    """Aggregate per group (or over the table)."""
    return df.groupBy(*by).agg(*exprs) if by else df.agg(*exprs)
