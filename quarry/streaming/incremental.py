"""Streaming forms of A1, A9, R1, G3 and of the per-row operators (A3/A4,
P4, C4, R4/R6) with statistics fitted on a batch table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.columns import as_double, clean_value, numeric_columns, safe_div
from quarry.operators.cluster import assign_expr


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A file-source stream (new files in ``path`` become new rows)."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def running_column_stats(stream: DataFrame, cols: list[str] | None = None,
                         by: list[str] | None = None) -> DataFrame:
    """A1 over a stream: count, mean, sample std, min, max per numeric column
    (wide: ``<col>_count``, ``<col>_mean``...), kept as streaming state per
    group; emit with output mode ``update`` or ``complete``."""
    targets = [c for c in numeric_columns(stream, cols) if c not in (by or [])]
    aggs = []
    for c in targets:
        x = as_double(stream, c)
        aggs += [F.count(x).alias(f"{c}_count"), F.avg(x).alias(f"{c}_mean"),
                 F.stddev_samp(x).alias(f"{c}_std"), F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max")]
    return stream.groupBy(*(by or [])).agg(*aggs)


def running_crosstab(stream: DataFrame, a: str, b: str) -> DataFrame:
    """A9 over a stream: running count per observed pair."""
    keys = stream.select(clean_value(stream, a).alias(a), clean_value(stream, b).alias(b))
    return keys.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(
        F.count(F.lit(1)).alias("n"))


def running_ols(stream: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """R1 over a stream: slope, intercept and R² of y on x, refitted as rows
    arrive (``regr_*`` aggregates kept as streaming state per group)."""
    xv, yv = as_double(stream, x), as_double(stream, y)
    return stream.groupBy(*(by or [])).agg(
        F.regr_count(yv, xv).alias("n"), F.regr_slope(yv, xv).alias("slope"),
        F.regr_intercept(yv, xv).alias("intercept"), F.regr_r2(yv, xv).alias("r2"))


def windowed_line_series(stream: DataFrame, time: str, value: str, window: str = "1 hour",
                         watermark: str = "2 hours", key: str | None = None) -> DataFrame:
    """G3 over a stream: per event-time window count/min/max/avg; windows
    older than the watermark are final and their state is dropped (output
    mode ``append`` emits each window once)."""
    v = as_double(stream, value)
    keys = [key] if key else []
    # watermarks need an instant (TIMESTAMP); wall-clock times are read in
    # the session time zone and the bucket is returned as wall-clock time
    timed = stream.withColumn("__evt", F.col(time).cast("timestamp"))
    return (timed.withWatermark("__evt", watermark)
            .groupBy(F.window("__evt", window).alias("w"), *keys)
            .agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("avg"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), *keys, "n", "min", "max", "avg"))


def frozen_statistics(reference: DataFrame, cols: list[str]) -> dict:
    """Mean, sample std, population std, min and max of each column of a
    batch table: one aggregate row (bounded: 5 numbers per column)."""
    aggs = []
    for i, c in enumerate(cols):
        x = as_double(reference, c)
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"), F.stddev_pop(x).alias(f"p{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    r = reference.agg(*aggs).first()
    return {c: {"mean": r[f"m{i}"], "std": r[f"s{i}"], "std_pop": r[f"p{i}"], "min": r[f"lo{i}"],
                "max": r[f"hi{i}"]} for i, c in enumerate(cols)}


def apply_scaling(stream: DataFrame, stats: dict, kind: str = "standardize") -> DataFrame:
    """A3/A4 with frozen statistics (works on batch and streaming frames)."""
    out = []
    for c in stream.columns:
        if c not in stats:
            out.append(F.col(c))
            continue
        s, x = stats[c], as_double(stream, c)
        if kind == "standardize":
            v = safe_div(x - F.lit(s["mean"]), F.lit(s["std"]))
        elif kind == "normalize":
            v = safe_div(x - F.lit(s["min"]), F.lit(None if s["max"] is None else s["max"] - s["min"]))
        else:
            raise ValueError("kind must be standardize or normalize")
        out.append(v.alias(c))
    return stream.select(*out)


def apply_outlier_mask(stream: DataFrame, stats: dict, threshold: float = 3.0, out: str = "keep") -> DataFrame:
    """P4's mask with frozen mean / sample std: ``out`` is true when every
    chosen column has |z| ≤ threshold."""
    test = None
    for c, s in stats.items():
        z = F.abs(safe_div(as_double(stream, c) - F.lit(s["mean"]), F.lit(s["std"])))
        t = F.coalesce(z <= F.lit(float(threshold)), F.lit(False))
        test = t if test is None else test & t
    return stream.withColumn(out, test)


def apply_cluster_centres(stream: DataFrame, cols: list[str], centres: list[list[float]],
                          stats: dict | None = None, out: str = "cluster") -> DataFrame:
    """C4 on a stream: nearest given centre, after the batch table's
    population z-score when ``stats`` is given (as C2 fitted them)."""
    feats = []
    for c in cols:
        x = as_double(stream, c)
        if stats:
            x = F.coalesce(safe_div(x - F.lit(stats[c]["mean"]), F.lit(stats[c]["std_pop"])), F.lit(0.0))
        feats.append(x)
    return stream.withColumn(out, assign_expr(feats, centres))


def apply_linear_model(stream: DataFrame, intercept: float, coefficients: dict[str, float],
                       out: str = "y_hat") -> DataFrame:
    """R4/R6 on a stream: fitted values from given coefficients."""
    yhat = F.lit(float(intercept))
    for c, b in coefficients.items():
        yhat = yhat + F.lit(float(b)) * as_double(stream, c)
    return stream.withColumn(out, yhat)
