"""Correlation matrices: A6 (Pearson), A7 (Spearman), G4 (heatmap cells).

Output is long: ``(by..., var_a, var_b, r)`` with all k² cells (mirrored,
diagonal included), the form a heatmap or any later join wants.

Pearson: pairwise-complete (a row counts for a pair when both of its values
are present), from the pair sums of ``_gram.pair_moments``: one pass for the
means and one for all products, whatever the number of columns.

Spearman: Pearson on average ranks (A8), ranks taken per pair after
dropping that pair's missing rows.  One aggregate row tells whether any
selected value is missing.  If none is, each column is ranked once (one rank
pass for all columns), the ranks are attached to the rows and the Pearson
aggregation above runs on them.  Otherwise each column is still put in order
once, with a count of present rows per partner at each value, and the running
sums of these counts are the pairs' ranks.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import as_double, require_numeric, safe_div
from quarry.operators._gram import pair_moments
from quarry.operators._lookup import lookup_join
from quarry.operators._stats import grouped_agg
from quarry.operators.carried import running_sums
from quarry.operators.rank import _default_buckets, attach_ranks, value_ranks
from quarry.session import cut_lineage

METHODS = ("pearson", "spearman")


def _self_r(a: Column) -> Column:
    return safe_div(F.var_pop(a), F.var_pop(a))


def _pearson_matrix(df: DataFrame, names: list[str], values: list[Column], by: list[str]) -> DataFrame:
    """All cells from the pair sums of ``pair_moments``; null where a column
    is constant over the pair's rows."""
    m = pair_moments(df, values, by)
    varied = (F.col("n") > 0) & ~F.col("flat_i") & ~F.col("flat_j") & (F.col("sii") > 0) & (F.col("sjj") > 0)
    r = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("sij") / (F.sqrt("sii") * F.sqrt("sjj")))))
    upper = m.select(*by, "i", "j", F.when(varied, r).alias("r"))
    label = F.array(*[F.lit(c) for c in names])
    # a cell and its mirror from one row
    cells = upper.select(*by, "r", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b"))))
                                             .otherwise(F.array(F.struct(F.col("i").alias("a"), F.col("j").alias("b")),
                                                                F.struct(F.col("j").alias("a"), F.col("i").alias("b"))))).alias("c"))
    return cells.select(*by, F.get(label, F.col("c.a")).alias("var_a"), F.get(label, F.col("c.b")).alias("var_b"), "r")


def correlation(df: DataFrame, cols: list[str], method: str = "pearson",
                by: list[str] | None = None) -> DataFrame:
    """Correlation matrix of ``cols`` (at least two) as long rows."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if len(cols) < 2:
        raise ValueError("select at least two variables")
    require_numeric(df, cols)
    by = by or []
    if method == "pearson":
        return _pearson_matrix(df, cols, [as_double(df, c) for c in cols], by)
    return _spearman(df, cols, by)


def _spearman(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    names = [f"__x{i}" for i in range(len(cols))]
    base = df.select(*by, *[as_double(df, c).alias(n) for c, n in zip(cols, names)])
    buckets = _default_buckets(df)
    any_missing = base.agg(F.max(F.greatest(*[F.col(n).isNull().cast("int") for n in names]))).first()[0]
    if not any_missing:
        return _spearman_complete(base, cols, names, by, buckets)
    return _spearman_pairwise(base, cols, names, by)


def _spearman_complete(base: DataFrame, cols: list[str], names: list[str], by: list[str],
                       buckets: int) -> DataFrame:
    """No missing value: every pair sees the same rows, so each column is
    ranked once (all columns in one rank pass keyed by column index), the
    ranks are attached to the rows, and one Pearson aggregation follows."""
    long = base.select(*by, F.explode(F.array(*[
        F.struct(F.lit(i).alias("ci"), F.col(n).alias("v")) for i, n in enumerate(names)])).alias("__c"))
    counts = (long.select(*by, "__c.ci", F.col("__c.v").alias("__v"))
              .groupBy(*by, "ci", "__v").agg(F.count(F.lit(1)).alias("__cnt")))
    ranks = value_ranks(counts, by + ["ci"], buckets, max_groups=None if by else len(cols))
    ranked = base
    for i, n in enumerate(names):
        ri = ranks.where(F.col("ci") == i).drop("ci")
        ranked = attach_ranks(ranked, F.col(n), ri, f"{n}_r", "average", by)
    return _pearson_matrix(ranked, cols, [F.col(f"{n}_r") for n in names], by)


def _spearman_pairwise(base: DataFrame, cols: list[str], names: list[str], by: list[str]) -> DataFrame:
    """Missing values: ranks per pair over that pair's complete rows.  Each
    column is put in order once; at each of its values the rows in which every
    other column is present are counted, and running sums of these counts are
    the value's ranks for all partners at once.  A row meets its columns' ranks
    in one join, so there is one record per row and column, none per pair."""
    k = len(cols)
    flags = F.array(*[F.col(n).isNotNull().cast("long") for n in names]).alias("flags")
    cells = F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("ci"), F.col(n).alias("v")) for i, n in enumerate(names)]),
                               lambda c: c["v"].isNotNull())).alias("c")
    counts = (base.select(*by, flags, cells).groupBy(*by, "c.ci", "c.v")
              .agg(*[F.sum(F.get("flags", F.lit(j))).alias(f"c{j}") for j in range(k)]))
    placed = running_sums(counts, [*by, "ci"], ["v"], {f"b{j}": F.col(f"c{j}") for j in range(k)}, inclusive=False)
    rank = F.array(*[(F.col(f"b{j}") + (F.col(f"c{j}") + 1) / 2).cast("double") for j in range(k)]).alias("r")
    ranks = cut_lineage(placed.select(*by, "ci", "v", rank, F.array(*[F.col(f"c{j}").cast("double") for j in range(k)]).alias("w")))
    # numbers of rows and squares of ranks per (column, partner), from the values alone
    own = ranks.select(*by, "ci", F.posexplode(F.arrays_zip("r", "w")).alias("j", "x")).groupBy(*by, F.col("ci").alias("i"), "j").agg(
        F.sum("x.w").alias("n"), F.sum(F.col("x.w") * F.col("x.r") * F.col("x.r")).alias("square"))
    rows = base.withColumn("rid", F.monotonically_increasing_id()).select(*by, "rid", cells).select(*by, "rid", "c.ci", "c.v")
    met = lookup_join(rows, ranks.drop("w"), [*by, "ci", "v"])
    per_row = met.groupBy(*by, "rid").agg(F.map_from_entries(F.collect_list(F.struct("ci", "r"))).alias("m"))

    def product(i: int, j: int) -> Column:
        return F.sum(F.get(F.col("m")[i], F.lit(j)) * F.get(F.col("m")[j], F.lit(i)))

    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), product(i, j).alias("both")) for i, j in combinations(range(k), 2)])
    products = grouped_agg(per_row, by, [pairs.alias("p")]).select(*by, F.inline("p"))
    there = lookup_join(products, own.select(*by, "i", "j", "n", F.col("square").alias("sa")), [*by, "i", "j"])
    back = own.select(*by, F.col("j").alias("i"), F.col("i").alias("j"), F.col("square").alias("sb"))
    s = lookup_join(there, back, [*by, "i", "j"])
    middle = F.col("n") * F.pow((F.col("n") + 1) / 2, F.lit(2))
    va, vb = F.col("sa") - middle, F.col("sb") - middle
    r = F.least(F.greatest((F.col("both") - middle) / F.sqrt(va * vb), F.lit(-1.0)), F.lit(1.0))
    fwd = s.select(*by, "i", "j", F.when((va > 0) & (vb > 0), r).alias("r"))
    mirrored = fwd.unionByName(fwd.select(*by, F.col("j").alias("i"), F.col("i").alias("j"), "r"))
    # diagonal: 1 for a column with spread, null for a constant or empty one
    diag = grouped_agg(base, by, [_self_r(F.col(n)).alias(f"d{i}") for i, n in enumerate(names)])
    diag = diag.select(*by, F.inline(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(i).alias("j"), F.col(f"d{i}").alias("r")) for i in range(k)])))
    label = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(i), F.lit(c))])
    return mirrored.unionByName(diag).select(*by, label[F.col("i")].alias("var_a"),
                                             label[F.col("j")].alias("var_b"), "r")


def heatmap_matrix(df: DataFrame, cols: list[str], method: str = "pearson",
                   by: list[str] | None = None) -> DataFrame:
    """Matrix cells with the fixed colour scale −1..1 and the cell text."""
    m = correlation(df, cols, method, by)
    return m.select("*", F.lit(-1.0).alias("z_min"), F.lit(1.0).alias("z_max"),
                    F.format_number(F.col("r"), 2).alias("text"))
