"""Ranks with ties averaged, without a single-partition window.

``Window.orderBy`` with no partition runs in one task.  Instead:

1. ``counts``: one row per distinct (group, value), pre-aggregated map-side,
   so a value held by a third of all rows is a single row from here on.
2. Cut points: ``percentile_approx`` over the distinct values gives
   ``buckets - 1`` cut points per group; each distinct value gets the bucket
   number of cut points below it (a compiled binary search).  Buckets hold
   about equal numbers of distinct values, so every window below is bounded
   by distinct / buckets rows, not by the data size.  Per-group cut points
   are attached by a skew-safe lookup join, or broadcast when the number of
   groups is bounded by the plan (one group per selected column).
3. Inside each (group, bucket): running sum of counts before the value.
4. Bucket offsets: running sum over bucket totals (``buckets`` rows per group).
5. rank = offset + before + (count + 1) / 2 (``average``), or + 1 (``min``),
   or + count (``max``).
6. Join back to the data rows on (group, value), one shuffle join; a hot
   value's partition is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.columns import clean_value, require_columns
from quarry.operators._lookup import lookup_join
from quarry.session import cut_lineage

DEFAULT_BUCKETS = 64
MIN_BUCKETS = 16


def _default_buckets(df: DataFrame) -> int:
    """One bucket per shuffle partition, so that the bucket windows follow the
    same sizing as every other shuffle."""
    return max(MIN_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def value_counts(df: DataFrame, value: Column, by: list[str] | None = None,
                 then: list[Column] | None = None) -> DataFrame:
    """One row per distinct (by..., __v, __o0...) with ``__cnt`` (map-side
    combined).  ``then`` are further order columns (tie-breakers) after
    ``value``."""
    by = by or []
    extra = [c.alias(f"__o{i}") for i, c in enumerate(then or [])]
    names = [f"__o{i}" for i in range(len(extra))]
    return (df.select(*by, value.alias("__v"), *extra).where(F.col("__v").isNotNull())
            .groupBy(*by, "__v", *names).agg(F.count(F.lit(1)).alias("__cnt")))


def _then_names(counts: DataFrame) -> list[str]:
    return [c for c in counts.columns if c.startswith("__o")]


def value_ranks(counts: DataFrame, by: list[str] | None = None, buckets: int = DEFAULT_BUCKETS,
                accuracy: int = 10_000, max_groups: int | None = None) -> DataFrame:
    """Rank table from ``value_counts``: adds ``__before``, the number of rows
    strictly before the value within its group, and ``__total``, the
    group's number of rows.  ``max_groups``: a bound on the number of groups
    known when the plan is built (for example one group per selected
    column); the per-group tables are then broadcast outright."""
    by = by or []
    fractions = [i / buckets for i in range(1, buckets)]
    if isinstance(counts.schema["__v"].dataType, (T.StringType, T.BinaryType)):
        # no approximate percentile: the buckets are Spark's own range
        # partitions, written so that every later read sees the same ones
        order = [*by, "__v", *_then_names(counts)]
        with_cuts = cut_lineage(counts.repartitionByRange(buckets, *order).withColumn("__range", F.spark_partition_id()))
        bucket = F.col("__range")
    elif buckets > 1:
        cut_expr = F.percentile_approx("__v", fractions, accuracy).alias("__cuts")
        if by:
            # per-group cut points, attached skew-safely (one group may hold
            # most distinct values)
            per_group = counts.groupBy(*by).agg(cut_expr)
            if max_groups is not None and max_groups <= 10_000:
                with_cuts = counts.join(F.broadcast(per_group), by, "left")
            else:
                with_cuts = lookup_join(counts, per_group, by)
        else:
            # one array of ``buckets - 1`` values, read as a scalar subquery
            with_cuts = counts.withColumn("__cuts", counts.agg(cut_expr).scalar())
        # number of cut points below the value: a binary search over the
        # sorted cut array in log2(buckets) compiled steps (a higher-order
        # function's lambda would be interpreted per row)
        # (one projection; each step names the previous one as a lateral alias)
        steps, prev, step = [], "0", 1 << ((buckets - 1).bit_length() - 1)
        while step >= 1:
            cur = f"__bs{step}"
            steps.append(f"CASE WHEN coalesce(try_element_at(__cuts, {prev} + {step}) < __v, false) "
                         f"THEN {prev} + {step} ELSE {prev} END AS {cur}")
            prev, step = cur, step // 2
        with_cuts = with_cuts.selectExpr("*", *steps)
        bucket = F.col(prev)
    else:
        with_cuts, bucket = counts, F.lit(0)
    then = _then_names(counts)
    bucketed = with_cuts.select(*by, "__v", *then, "__cnt", bucket.alias("__b"))
    inner = Window.partitionBy(*by, "__b").orderBy("__v", *then).rowsBetween(Window.unboundedPreceding, -1)
    within = bucketed.withColumn("__in", F.coalesce(F.sum("__cnt").over(inner), F.lit(0)))
    # from the window's output, already hash-partitioned by (group, bucket):
    # the totals need no further shuffle
    totals = within.groupBy(*by, "__b").agg(F.sum("__cnt").alias("__bt"))
    # ``buckets`` rows per group: bounded, whatever the data size
    outer = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "__b", F.coalesce(F.sum("__bt").over(outer), F.lit(0)).alias("__off"),
                            F.sum("__bt").over(Window.partitionBy(*by)).alias("__total"))
    # ``buckets`` rows per group: broadcast when the groups are bounded too
    bounded = not by or (max_groups is not None and max_groups * buckets <= 1_000_000)
    offsets = F.broadcast(offsets) if bounded else offsets
    ranked = within.join(offsets, by + ["__b"], "inner")
    return ranked.select(*by, "__v", *then, "__cnt", (F.col("__off") + F.col("__in")).alias("__before"),
                         "__total")


def rank_expr(method: str, ascending: bool = True) -> Column:
    cnt = F.col("__cnt").cast("double")
    before = F.col("__before").cast("double")
    if not ascending:                    # rows that come before in the other direction
        before = F.col("__total").cast("double") - before - cnt
    if method == "average":
        return before + (cnt + 1.0) / 2.0
    if method == "min":
        return before + 1.0
    if method == "max":
        return before + cnt
    raise ValueError("method must be average, min or max")


def attach_ranks(df: DataFrame, value: Column, ranks: DataFrame, out: str, method: str = "average",
                 by: list[str] | None = None, then: list[Column] | None = None, total_out: str | None = None,
                 ascending: bool = True) -> DataFrame:
    """Join the rank table back to data rows in one shuffle join on
    (by..., value).  The table has one row per distinct value; a value that a
    large part of all rows hold makes a skewed partition, which adaptive
    execution splits (see ``_lookup``).  Rows with a missing value get a null
    rank."""
    by = by or []
    then = then or []
    tn = [f"__o{i}" for i in range(len(then))]
    data = df.withColumns({"__v": value, **dict(zip(tn, then, strict=True))})
    table = ranks.select(*[F.col(k).alias(f"__rk_{k}") for k in by], F.col("__v").alias("__rv"),
                         *[F.col(n).alias(f"__r{n}") for n in tn],
                         rank_expr(method, ascending).alias("__r"), F.col("__total").alias("__rt"))
    cond = ([data[k].eqNullSafe(F.col(f"__rk_{k}")) for k in by] + [data["__v"] == F.col("__rv")]
            + [data[n].eqNullSafe(F.col(f"__r{n}")) for n in tn])
    joined = data.join(table, cond, "left")
    extra = [F.col("__rt").alias(total_out)] if total_out else []
    return joined.select(*df.columns, F.col("__r").alias(out), *extra)


def average_rank(df: DataFrame, col: str, by: list[str] | None = None, out: str = "rank",
                 method: str = "average", ascending: bool = True,
                 buckets: int | None = None) -> DataFrame:
    """``df`` plus ``out``, the rank of ``col`` within ``by`` groups,
    ties averaged (``method='average'``).  Missing values get null ranks and
    are not counted.  ``ascending=False`` ranks the largest value first, for
    any type that has an order."""
    require_columns(df, [col] + (by or []))
    value = clean_value(df, col)
    ranks = value_ranks(value_counts(df, value, by), by, buckets or _default_buckets(df))
    return attach_ranks(df, value, ranks, out, method, by, ascending=ascending)
