"""Data behind the charts, bounded for a large table: G1 (scatter), G2
(3-D scatter), G3 (line over time), G5 (residual points), G6 (report).
G4 (heatmap cells) is in ``correlate``.

A chart of a billion points is not drawn point by point, so scatters come as
equal-width bins with counts: an aggregation over all rows whose size is
bins², whatever the data size.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.columns import as_double, clean_value, numeric_columns, require_columns, require_numeric, safe_div
from quarry.operators._stats import attach, grouped_agg


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin 0..bins-1 of x over [lo, hi] (hi falls in the last bin)."""
    raw = F.floor(safe_div((x - lo) * F.lit(float(bins)), hi - lo))
    return F.least(F.greatest(F.coalesce(raw, F.lit(0)), F.lit(0)), F.lit(bins - 1)).cast("int")


def scatter_bins(df: DataFrame, cols: list[str], bins: int = 50, by: list[str] | None = None) -> DataFrame:
    """G1/G2 binned: ``(by..., b0, b1[, b2], lo0, hi0, ..., n)`` for rows with
    every coordinate present; lo/hi are each bin's edges."""
    require_numeric(df, cols)
    by = by or []
    vals = {c: as_double(df, c) for c in cols}
    present = None
    for v in vals.values():
        present = v.isNotNull() if present is None else present & v.isNotNull()
    base = df.where(present)
    edges = [e for i, c in enumerate(cols)
             for e in (F.min(vals[c]).alias(f"__lo{i}"), F.max(vals[c]).alias(f"__hi{i}"))]
    span = grouped_agg(base, by, edges)
    frame, stat = attach(base, span, by)
    keyed = frame.select(*by, *[_bin(vals[c], stat(f"__lo{i}"), stat(f"__hi{i}"), bins).alias(f"b{i}")
                                for i, c in enumerate(cols)],
                         *[stat(f"__lo{i}").alias(f"__lo{i}") for i in range(len(cols))],
                         *[stat(f"__hi{i}").alias(f"__hi{i}") for i in range(len(cols))])
    counted = keyed.groupBy(*by, *[f"b{i}" for i in range(len(cols))]).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        *[F.first(f"__lo{i}").alias(f"__lo{i}") for i in range(len(cols))],
        *[F.first(f"__hi{i}").alias(f"__hi{i}") for i in range(len(cols))])
    edges = []
    for i in range(len(cols)):
        width = (F.col(f"__hi{i}") - F.col(f"__lo{i}")) / bins
        edges += [(F.col(f"__lo{i}") + F.col(f"b{i}") * width).alias(f"lo{i}"),
                  (F.col(f"__lo{i}") + (F.col(f"b{i}") + 1) * width).alias(f"hi{i}")]
    return counted.select(*by, *[f"b{i}" for i in range(len(cols))], *edges, "n")


def line_series(df: DataFrame, time: str, value: str, unit: str = "hour", key=None) -> DataFrame:
    """Value over time in ``unit`` buckets (``date_trunc`` units):
    ``(key..., bucket, n, min, max, avg)`` as doubles.  A decimal column is
    aggregated exactly (its average rounded half-up to the decimal's scale
    + 4), so the result does not depend on summation order."""
    keys = [key] if isinstance(key, str) else list(key or [])
    require_columns(df, keys + [time, value])
    bucket = F.date_trunc(unit, F.col(time).cast("timestamp_ntz")).cast("timestamp_ntz")
    exact = isinstance(df.schema[value].dataType, T.DecimalType)
    v = F.col(value) if exact else as_double(df, value)
    out = df.groupBy(*keys, bucket.alias("bucket")).agg(
        F.count(v).cast("bigint").alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("avg"))
    return out.select(*keys, "bucket", "n", *[F.col(c).cast("double").alias(c) for c in ("min", "max", "avg")])


def residual_points(residuals: DataFrame, bins: int = 50) -> DataFrame:
    """Predicted vs residual, binned (input: R4's output)."""
    return scatter_bins(residuals, ["y_hat", "residual"], bins)


def _report_metrics(df: DataFrame, cols: list[str]) -> list[Column]:
    """Every number of the report as one aggregate over the rows."""
    num = set(numeric_columns(df, cols))
    out = [F.count(F.lit(1)).cast("double").alias("n")]
    for i, c in enumerate(cols):
        out.append((F.count(F.lit(1)) - F.count(clean_value(df, c))).cast("double").alias(f"m{i}"))
        if c in num:
            x = as_double(df, c)
            exact = F.col(c) if isinstance(df.schema[c].dataType, T.DecimalType) else x
            out += [F.count(x).cast("double").alias(f"count{i}"), F.avg(exact).cast("double").alias(f"mean{i}"),
                    F.stddev_samp(x).alias(f"std{i}"), F.min(x).cast("double").alias(f"min{i}"), F.max(x).cast("double").alias(f"max{i}")]
    return out


def _report_rows(cols: list[str], num: list[str], value) -> list[Column]:
    """The report's rows from the metrics, which ``value`` names."""
    def row(section: str, name: str, metric: str, v: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"), F.lit(metric).alias("metric"), v.cast("double").alias("value"))

    rows = [row("shape", "table", "n_rows", value("n")), row("shape", "table", "n_cols", F.lit(len(cols)))]
    rows += [row("statistics", c, m, value(f"{m}{cols.index(c)}")) for c in num for m in ("count", "mean", "std", "min", "max")]
    return rows + [row("missing", c, "n_missing", value(f"m{i}")) for i, c in enumerate(cols)]


def result_section(section: str, result: DataFrame) -> DataFrame:
    """An operator's result as report rows: its numbers are metrics, its other
    columns together the name."""
    kinds = {f.name: f.dataType for f in result.schema.fields}
    numbers = [c for c, k in kinds.items() if isinstance(k, (T.NumericType, T.BooleanType))]
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in kinds if c not in numbers]
    name = F.concat_ws(" ", *texts) if texts else F.lit("table")
    return result.select(F.lit(section).alias("section"), name.alias("name"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numbers])))


def analysis_report(df: DataFrame, cols: list[str] | None = None, results: dict[str, DataFrame] | None = None) -> DataFrame:
    """``(section, name, metric, value)`` rows: the shape, the column
    statistics of the numeric columns, the missing counts of all columns, and a
    section for each of ``results`` (fits, tests, matrices: any operator's
    table).  One aggregation over one scan gives all but the results.  Write it
    with ``df.write`` (Parquet or CSV)."""
    cols = cols if cols is not None else df.columns
    out = df.agg(*_report_metrics(df, cols)).select(F.inline(F.array(*_report_rows(cols, numeric_columns(df, cols), F.col))))
    for section, result in (results or {}).items():
        out = out.unionByName(result_section(section, result))
    return out


def observed_report(df: DataFrame, cols: list[str] | None = None) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """G6 without a pass of its own: ``df`` to be written or counted by the
    caller, and a function that gives the report of the rows that passed, once
    they have."""
    cols = cols if cols is not None else df.columns
    seen = Observation(f"report-{uuid.uuid4().hex[:8]}")
    frame = df.observe(seen, *_report_metrics(df, cols))

    def report() -> DataFrame:
        found = seen.get
        rows = _report_rows(cols, numeric_columns(df, cols), lambda name: F.lit(found[name]).cast("double"))
        return df.sparkSession.range(1).select(F.inline(F.array(*rows)))

    return frame, report


def write_report(report: DataFrame, path: str, fmt: str = "parquet") -> str:
    """G6 sink: write the report rows as one Parquet or CSV file (the report
    has 2 + 6 rows per column, so one file is the right size)."""
    if fmt not in ("parquet", "csv"):
        raise ValueError("fmt must be parquet or csv")
    writer = report.coalesce(1).write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
    return path
