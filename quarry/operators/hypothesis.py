"""Statistical tests: T1 (two-sample t-test), T2 (chi-square test of
independence), T3 (expected counts).  p-values (X1) are computed on the
result rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.columns import as_double, require_columns, require_numeric, safe_div
from quarry.functions.pvalues import chi2_pvalue, t_pvalue
from quarry.operators._stats import grouped_agg
from quarry.operators.explore import crosstab
from quarry.session import ship_package


def _t_from_moments(n1, m1, v1, n2, m2, v2):
    dof = n1 + n2 - 2
    pooled = safe_div((n1 - 1) * v1 + (n2 - 1) * v2, dof.cast("double"))
    se = F.sqrt(pooled * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    return safe_div(m1 - m2, se), dof


def ttest_ind(df: DataFrame, a: str, b: str, by: list[str] | None = None,
              with_pvalue: bool = True) -> DataFrame:
    """The two columns as two independent samples, equal variances,
    two-sided.  ``(by..., t, dof, p, n1, n2, status)``.  A missing value in
    either column makes the result missing (status ``missing_values``), as
    the reference's default does."""
    require_numeric(df, [a, b])
    x, y = as_double(df, a), as_double(df, b)
    aggs = [F.count(F.lit(1)).alias("__n"), F.count(x).alias("n1"), F.count(y).alias("n2"),
            F.avg(x).alias("__m1"), F.var_samp(x).alias("__v1"),
            F.avg(y).alias("__m2"), F.var_samp(y).alias("__v2")]
    m = grouped_agg(df, by, aggs)
    t, dof = _t_from_moments(F.col("n1"), F.col("__m1"), F.col("__v1"), F.col("n2"), F.col("__m2"), F.col("__v2"))
    complete = (F.col("n1") == F.col("__n")) & (F.col("n2") == F.col("__n"))
    out = m.select(*(by or []), F.when(complete, t).alias("t"), dof.cast("bigint").alias("dof"),
                   F.col("n1").cast("bigint").alias("n1"), F.col("n2").cast("bigint").alias("n2"),
                   F.when(~complete, "missing_values").when(dof < 1, "too_few_rows").otherwise("ok").alias("status"))
    if with_pvalue:
        ship_package(df.sparkSession)
        out = out.withColumn("p", t_pvalue(F.col("t"), F.col("dof")))
    return out


def ttest_groups(df: DataFrame, value: str, group: str, first, second,
                 with_pvalue: bool = True) -> DataFrame:
    """T1 variant: compare ``value`` between two groups of one column
    (missing values are left out, as a grouped comparison does)."""
    require_numeric(df, [value])
    require_columns(df, [group])
    x = as_double(df, value)
    g = F.col(group)
    aggs = []
    for tag, lvl in (("1", first), ("2", second)):
        sel = F.when(g == F.lit(lvl), x)
        aggs += [F.count(sel).alias(f"n{tag}"), F.avg(sel).alias(f"__m{tag}"), F.var_samp(sel).alias(f"__v{tag}")]
    m = df.agg(*aggs)
    t, dof = _t_from_moments(F.col("n1"), F.col("__m1"), F.col("__v1"), F.col("n2"), F.col("__m2"), F.col("__v2"))
    out = m.select(t.alias("t"), dof.cast("bigint").alias("dof"),
                   F.col("n1").cast("bigint").alias("n1"), F.col("n2").cast("bigint").alias("n2"))
    if with_pvalue:
        ship_package(df.sparkSession)
        out = out.withColumn("p", t_pvalue(F.col("t"), F.col("dof")))
    return out


def _with_margins(cells: DataFrame) -> DataFrame:
    """Observed cells (``__a, __b, __o``, one row per distinct pair) with their
    row total, column total, and the number of observed cells in their row and
    column.  Windows over the cells, so the data is read once."""
    of_a, of_b = Window.partitionBy("__a"), Window.partitionBy("__b")
    return cells.select("*", F.sum("__o").over(of_a).alias("__ra"), F.count(F.lit(1)).over(of_a).alias("__ka")).select(
        "*", F.sum("__o").over(of_b).alias("__cb"), F.count(F.lit(1)).over(of_b).alias("__kb"))


def chi_square(df: DataFrame, a: str, b: str, correction: bool = True,
               with_pvalue: bool = True) -> DataFrame:
    """Chi-square test of independence on the cross-tabulation of a and b.
    ``(stat, dof, p, n)``.  Yates' correction when dof = 1 (as the reference's
    library does by default).

    Works on the sparse table of observed cells: with E = R·C/N, the sum of
    (O − E)²/E over all cells, absent ones included, is N·(Σ O²/(R·C) − 1),
    and Σ O²/(R·C) − 1 = Σ (O²/(R·C) − O/N).  In a 2 × 2 table every cell has
    the same |O − E| = D, so the corrected statistic is (D − min(½, D))² · Σ 1/E,
    with Σ 1/E = N · Σ 1/R · Σ 1/C.  One scan and one aggregation of the data.
    """
    require_columns(df, [a, b])
    cells = crosstab(df, a, b).select(F.col(a).alias("__a"), F.col(b).alias("__b"), F.col("n").alias("__o"))
    o, r, c = (F.col(x).cast("double") for x in ("__o", "__ra", "__cb"))
    agg = _with_margins(cells).agg(
        F.sum("__o").cast("double").alias("N"),
        F.sum(F.lit(1.0) / F.col("__ka")).alias("r"), F.sum(F.lit(1.0) / F.col("__kb")).alias("c"),
        F.sum(o * (o / (r * c))).alias("q"),
        F.sum(F.lit(1.0) / (r * F.col("__ka"))).alias("ir"), F.sum(F.lit(1.0) / (c * F.col("__kb"))).alias("ic"),
        F.min(F.struct("__a", "__b", o.alias("o"), r.alias("r"), c.alias("c"))).alias("one"))
    agg = agg.select("*", ((F.round("r") - 1) * (F.round("c") - 1)).cast("bigint").alias("dof"))
    N = F.col("N")
    d = F.abs(F.col("one.o") - F.col("one.r") * F.col("one.c") / N)
    yates = F.pow(d - F.least(d, F.lit(0.5)), 2) * N * F.col("ir") * F.col("ic")
    plain = F.greatest(N * (F.col("q") - 1.0), F.lit(0.0))
    stat = F.when(F.col("dof") == 0, F.lit(0.0)).when((F.col("dof") == 1) & F.lit(correction), yates).otherwise(plain)
    out = agg.select(stat.alias("stat"), F.col("dof"), N.cast("bigint").alias("n"))
    if with_pvalue:
        ship_package(df.sparkSession)
        out = out.withColumn("p", chi2_pvalue(F.col("stat"), F.col("dof")))
    return out


def expected_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """``(a, b, observed, expected)`` for every cell of the table, absent
    pairs included, expected = row total × column total / N.  In the dense
    table a row holds every column once, so N is the sum of its column
    totals."""
    require_columns(df, [a, b])
    of_a, of_b = Window.partitionBy(F.col(a)), Window.partitionBy(F.col(b))
    dense = crosstab(df, a, b, dense=True).select("*", F.sum("n").over(of_b).cast("double").alias("__cb"))
    full = dense.select("*", F.sum("n").over(of_a).alias("__ra"), F.sum("__cb").over(of_a).alias("__N"))
    return full.select(a, b, F.col("n").alias("observed"), (F.col("__ra") * F.col("__cb") / F.col("__N")).alias("expected"))
