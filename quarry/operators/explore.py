"""Select, text filter, sort, shape, column list, preview, column
statistics and cross-tabulation: P1, P2, O1, O2, S6, S7, S8, A1, A9."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import cut_lineage
from quarry.functions.columns import (as_double, clean_value, is_numeric_type, numeric_columns,
                                      render_text, require_columns)
from quarry.operators._stats import grouped_agg


def select_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Keep the chosen columns (pruned down to the scan by Catalyst)."""
    require_columns(df, cols)
    return df.select(*cols)


def filter_any_text(df: DataFrame, text: str, cols: list[str] | None = None) -> DataFrame:
    """Keep rows where any non-missing cell, rendered as lower-case text,
    contains ``text`` (lower-cased, literal).  Empty text keeps every row."""
    needle = (text or "").lower()
    cols = cols if cols is not None else df.columns
    require_columns(df, cols)
    if not needle or not cols:
        return df
    tests = [F.coalesce(F.lower(render_text(df, c)).contains(F.lit(needle)), F.lit(False)) for c in cols]
    return df.where(reduce(or_, tests))


def sort_by(df: DataFrame, col: str, ascending: bool = True, then: list[str] | None = None) -> DataFrame:
    """O1: sort by one column, missing last in both directions (NaN counts as
    missing), ties by the columns ``then``, ascending.  A global sort:
    range-partitioned by Spark, no single task."""
    require_columns(df, [col, *(then or [])])
    key = clean_value(df, col)
    order = [key.asc_nulls_last() if ascending else key.desc_nulls_last()]
    return df.orderBy(*order, *[clean_value(df, c).asc_nulls_last() for c in then or []])


def sorted_positions(df: DataFrame, col: str, ascending: bool = True, then: list[str] | None = None,
                     out: str = "pos") -> DataFrame:
    """The rows of ``sort_by`` with their consecutive place 1..n in it, read
    off the sorted partitions: the place inside its partition plus the rows of
    the partitions before (one small row per partition)."""
    placed = cut_lineage(sort_by(df, col, ascending, then).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(
        Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("__part", part).join(F.broadcast(before), "__part").select(
        *df.columns, (F.col("__before") + inside).cast("bigint").alias(out))


def sort_position(df: DataFrame, col: str, ascending: bool = True, out: str = "pos") -> DataFrame:
    """O1 with each row's place in the order: 1 + the number of rows that sort
    strictly before it (ties share a place); missing values come last.  Uses
    the distributed rank of A8, not a single-partition window."""
    from quarry.operators.rank import average_rank

    require_columns(df, [col])
    ranked = average_rank(df, col, out=out, method="min", ascending=ascending)
    n_present = df.agg(F.count(clean_value(df, col))).scalar()
    return ranked.withColumn(out, F.coalesce(F.col(out), n_present + 1).cast("bigint"))


def next_direction(state: dict, col: str) -> tuple[bool, dict]:
    """O2: the sort toggle.  First click on a column sorts ascending; each
    further click flips.  Returns (ascending, new_state) without mutating."""
    ascending = state.get(col, True)
    new_state = dict(state)
    new_state[col] = not ascending
    return ascending, new_state


def profile_shape(df: DataFrame) -> DataFrame:
    """One row ``(n_rows, n_cols)``."""
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_cols"))


def list_columns(df: DataFrame, with_counts: bool = False) -> DataFrame:
    """``(pos, name, type, is_numeric)`` from the schema (no data read);
    with ``with_counts`` also ``n_present``, the non-missing cells of each
    column (one aggregation)."""
    rows = [(i, f.name, f.dataType.simpleString(), is_numeric_type(f.dataType))
            for i, f in enumerate(df.schema.fields)]
    schema = T.StructType([
        T.StructField("pos", T.IntegerType()), T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()), T.StructField("is_numeric", T.BooleanType())])
    listing = df.sparkSession.createDataFrame(rows, schema)
    if not with_counts:
        return listing
    from quarry.functions.columns import is_missing

    counts = df.agg(*[F.count_if(~is_missing(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    present = counts.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.col(f"c{i}").cast("bigint").alias("n_present"))
        for i in range(len(df.columns))])))
    return listing.join(present, "pos", "left")


def preview(df: DataFrame, n: int = 100, order_by: list[str] | None = None,
            missing_marker: str = "NaN") -> DataFrame:
    """Rows as display text, missing shown as ``NaN``.  Bounded: the first
    ``n`` rows in ``order_by`` order (a top-n, planned as TakeOrderedAndProject:
    each task keeps n rows, the driver merges n × tasks)."""
    order_by = order_by or df.columns[:1]
    require_columns(df, order_by)
    text = [F.coalesce(render_text(df, c), F.lit(missing_marker)).alias(c) for c in df.columns]
    keys = [clean_value(df, c).asc_nulls_last() for c in order_by]
    return df.orderBy(*keys).limit(n).select(*text)


def column_stats(df: DataFrame, cols: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """A1: count, mean, sample std, min, max per numeric column, long form
    ``(by..., column, count, mean, std, min, max)``, from a single aggregation.
    Decimal columns get an exact mean."""
    targets = [c for c in numeric_columns(df, cols) if c not in (by or [])]
    exprs = []
    for i, c in enumerate(targets):
        x = as_double(df, c)
        # a decimal column's mean is exact (rounded half-up at scale + 4), so
        # it does not depend on summation order
        exact = F.col(c) if isinstance(df.schema[c].dataType, T.DecimalType) else x
        exprs += [F.count(x).alias(f"n{i}"), F.avg(exact).cast("double").alias(f"a{i}"),
                  F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    wide = grouped_agg(df, by, exprs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").cast("bigint").alias("count"),
                     F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("std"),
                     F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"))
            for i, c in enumerate(targets)]
    return wide.select(*(by or []), F.inline(F.array(*rows)))


#: Keys of one side of a dense crosstab that are expanded together.
CHUNK_KEYS = 1000


def crosstab(df: DataFrame, a: str, b: str, dense: bool = False) -> DataFrame:
    """Long contingency table ``(a, b, n)``; rows with a missing key are
    dropped.

    The observed counts come from one partial+final aggregation, so a hot
    pair costs one row per task, never a hot task.  By default only observed
    pairs are returned; ``dense=True`` also emits the zero cells: the distinct
    keys of ``b`` are dealt into chunks of about ``CHUNK_KEYS``, every distinct
    key of ``a`` is expanded to the chunks' numbers, meets them in a join on
    the number, and is expanded to their keys.  No task and no driver holds all
    keys of either side.
    """
    require_columns(df, [a, b])
    base = df.select(clean_value(df, a).alias("__a"), clean_value(df, b).alias("__b")).where(
        F.col("__a").isNotNull() & F.col("__b").isNotNull())
    observed = base.groupBy("__a", "__b").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    if dense:
        chunks = F.coalesce(F.ceil(base.agg(F.count_distinct("__b")).scalar() / CHUNK_KEYS), F.lit(1)).cast("int")
        chunks = F.greatest(chunks, F.lit(1))
        keys = (base.select("__b").distinct().withColumn("__chunk", F.pmod(F.xxhash64("__b"), chunks).cast("int"))
                .groupBy("__chunk").agg(F.collect_list("__b").alias("__keys")))
        wide = base.select("__a").distinct().select("__a", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("__chunk"))
        grid = wide.join(keys, "__chunk").select("__a", F.explode("__keys").alias("__b"))
        observed = grid.join(observed, ["__a", "__b"], "left").select(
            "__a", "__b", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    return observed.select(F.col("__a").alias(a), F.col("__b").alias(b), "n")
