"""Missing values and scaling: P3, P8, A2-A5, C1.

Scaling and filling apply to numeric columns only; other columns pass
through unchanged (a string column is never scaled).  Numeric outputs are
doubles.  Division is ANSI-safe: a constant column scales to null
(A3/A4) or to 0 (C1, population z-score).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import (as_double, is_missing, nan_to_null, numeric_columns,
                                      require_columns, safe_div)
from quarry.operators._stats import attach, grouped_agg

MISSING_METHODS = ("none", "drop", "mean")
SCALING_METHODS = ("none", "standardize", "normalize")


def _targets(df: DataFrame, cols: list[str] | None, by: list[str] | None) -> list[str]:
    if cols is not None:
        require_columns(df, cols)
    return [c for c in numeric_columns(df, cols) if c not in (by or [])]


def drop_missing(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Drop rows with a missing (null or NaN) cell in ``cols`` (all columns
    by default)."""
    subset = cols if cols is not None else df.columns
    require_columns(df, subset)
    if not subset:
        return df
    return df.where(~reduce(or_, [is_missing(df, c) for c in subset]))


def missing_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``(column, n_missing)`` for each column, in one aggregation."""
    cols = cols if cols is not None else df.columns
    require_columns(df, cols)
    wide = df.agg(*[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").cast("bigint").alias("n_missing"))
            for i, c in enumerate(cols)]
    return wide.select(F.inline(F.array(*rows)))


def assert_complete(df: DataFrame, cols: list[str]) -> None:
    """Refuse to model on missing values (reads one aggregate row)."""
    counts = missing_counts(df, cols).where("n_missing > 0").collect()
    if counts:
        detail = ", ".join(f"{r['column']}={r['n_missing']}" for r in counts)
        raise ValueError(f"data contains missing values: {detail}")


def fill_mean(df: DataFrame, cols: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """A2: replace missing numeric cells with the column mean (per group with
    ``by``).  An all-missing column stays missing."""
    targets = _targets(df, cols, by)
    if not targets:
        return df
    means = [F.avg(as_double(df, c)).alias(f"__mean_{i}") for i, c in enumerate(targets)]
    stats = grouped_agg(df, by, means)
    joined, stat = attach(df, stats, by)
    out = {c: F.coalesce(as_double(df, c), stat(f"__mean_{i}")) for i, c in enumerate(targets)}
    return joined.select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns])


def _scale(df: DataFrame, cols, by, kind: str) -> DataFrame:
    targets = _targets(df, cols, by)
    if not targets:
        return df
    exprs = []
    for i, c in enumerate(targets):
        x = as_double(df, c)
        if kind == "standardize":
            exprs += [F.avg(x).alias(f"__a_{i}"), F.stddev_samp(x).alias(f"__b_{i}")]
        elif kind == "zscore_pop":
            exprs += [F.avg(x).alias(f"__a_{i}"), F.stddev_pop(x).alias(f"__b_{i}")]
        else:
            exprs += [F.min(x).alias(f"__a_{i}"), (F.max(x) - F.min(x)).alias(f"__b_{i}")]
    joined, stat = attach(df, grouped_agg(df, by, exprs), by)
    out = {}
    for i, c in enumerate(targets):
        v = safe_div(as_double(df, c) - stat(f"__a_{i}"), stat(f"__b_{i}"))
        if kind == "zscore_pop":
            # a constant column scales to 0, as the reference's scaler does
            v = F.when(as_double(df, c).isNotNull(), F.coalesce(v, F.lit(0.0)))
        out[c] = v
    return joined.select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns])


def standardize(df: DataFrame, cols: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """A3: (x - mean) / sample std.  Constant column → null."""
    return _scale(df, cols, by, "standardize")


def normalize(df: DataFrame, cols: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """A4: (x - min) / (max - min).  Constant column → null."""
    return _scale(df, cols, by, "normalize")


def zscore_population(df: DataFrame, cols: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """(x - mean) / population std.  Constant column → 0."""
    return _scale(df, cols, by, "zscore_pop")


def preprocess(df: DataFrame, missing: str = "drop", scaling: str = "none",
               cols: list[str] | None = None) -> DataFrame:
    """A5: null step then scale step.  Always start from the original table;
    scale statistics come from the data after the null step."""
    if missing not in MISSING_METHODS:
        raise ValueError(f"missing must be one of {MISSING_METHODS}")
    if scaling not in SCALING_METHODS:
        raise ValueError(f"scaling must be one of {SCALING_METHODS}")
    out = nan_to_null(df)
    if missing == "drop":
        out = drop_missing(out, cols)
    elif missing == "mean":
        out = fill_mean(out, cols)
    if scaling == "standardize":
        out = standardize(out, cols)
    elif scaling == "normalize":
        out = normalize(out, cols)
    return out
