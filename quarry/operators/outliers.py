"""Outlier exclusion by z-score: P4, P5, P6.

A row is kept when |z| ≤ threshold (inclusive) in *every* chosen column, z by
the sample standard deviation.  A row whose z is missing (missing value, or a
constant column) is not kept, and so counts as an outlier (P5 includes it).
Both halves come from one mask column, so kept ∪ excluded is the input and
the two never overlap, with no row identity and no join.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import as_double, require_numeric, safe_div
from quarry.operators._stats import attach, grouped_agg

KEEP = "__keep"


def with_outlier_mask(df: DataFrame, cols: list[str], threshold: float = 3.0,
                      by: list[str] | None = None) -> DataFrame:
    """``df`` plus boolean ``__keep`` (never null)."""
    require_numeric(df, cols)
    exprs = []
    for i, c in enumerate(cols):
        x = as_double(df, c)
        exprs += [F.avg(x).alias(f"__m_{i}"), F.stddev_samp(x).alias(f"__s_{i}")]
    frame, stat = attach(df, grouped_agg(df, by, exprs), by)
    tests: list[Column] = [
        F.abs(safe_div(as_double(df, c) - stat(f"__m_{i}"), stat(f"__s_{i}"))) <= F.lit(float(threshold))
        for i, c in enumerate(cols)]
    keep = F.coalesce(reduce(and_, tests), F.lit(False))
    return frame.select(*df.columns, keep.alias(KEEP))


def exclude_outliers(df: DataFrame, cols: list[str], threshold: float = 3.0,
                     by: list[str] | None = None) -> DataFrame:
    """Rows kept for fitting."""
    return with_outlier_mask(df, cols, threshold, by).where(F.col(KEEP)).drop(KEEP)


def outlier_rows(df: DataFrame, cols: list[str], threshold: float = 3.0,
                 by: list[str] | None = None) -> DataFrame:
    """P5: the excluded rows, including those whose z is missing."""
    return with_outlier_mask(df, cols, threshold, by).where(~F.col(KEEP)).drop(KEEP)


def outlier_count(df: DataFrame, cols: list[str], threshold: float | None = 3.0,
                  by: list[str] | None = None) -> DataFrame:
    """``(by..., n_excluded)``; 0 when exclusion is off (threshold None)."""
    if threshold is None:
        return grouped_agg(df, by, [F.lit(0).cast("bigint").alias("n_excluded")])
    masked = with_outlier_mask(df, cols, threshold, by)
    return grouped_agg(masked, by, [F.count_if(~F.col(KEEP)).cast("bigint").alias("n_excluded")])
