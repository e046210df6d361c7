"""Registered queries: correlation (A6, A7, G4), t-test (T1), chi-square
(T2, T3) and their p-values (X1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.pvalues import chi2_pvalue, t_pvalue
from quarry.operators import correlate, hypothesis
from quarry.plans.registry import EVENTS_WITH_NULLS_SQL, events_with_nulls, register, rounded, table

_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _matrix_sql(src: str, cols: list[str], prefix: str = "") -> str:
    parts = []
    for a in cols:
        for b in cols:
            r = (f"covar_pop({a}, {b}) / sqrt(var_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) "
                 f"* var_pop(CASE WHEN {a} IS NOT NULL THEN {b} END))")
            parts.append(f"SELECT '{a}' AS var_a, '{b}' AS var_b, round({r}, 6) + 0.0 AS r FROM {src}")
    return prefix + " UNION ALL ".join(parts)


@register("corr_pearson", sql=_matrix_sql("lineitem", _COLS))
def corr_pearson(spark, sf):
    return rounded(correlate.correlation(table(spark, sf, "lineitem"), _COLS, "pearson"))


_E = f"WITH e AS ({EVENTS_WITH_NULLS_SQL}) "


@register("corr_pearson_missing", sql=_matrix_sql("e", ["user_id", "value", "event_id"], _E))
def corr_pearson_missing(spark, sf):
    return rounded(correlate.correlation(events_with_nulls(spark, sf), ["user_id", "value", "event_id"]))


def _rank_sql(cols):
    return ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}"
                     for c in cols)


@register("corr_spearman", sql=f"WITH rk AS (SELECT {_rank_sql(_COLS)} FROM lineitem) "
          + _matrix_sql("rk", _COLS))
def corr_spearman(spark, sf):
    return rounded(correlate.correlation(table(spark, sf, "lineitem"), _COLS, "spearman"))


def _pairwise_spearman_sql() -> str:
    cols = ["user_id", "value", "event_id"]
    parts = []
    for a in cols:
        for b in cols:
            src = (f"(SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, "
                   f"rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb "
                   f"FROM e WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")
            parts.append(f"SELECT '{a}' AS var_a, '{b}' AS var_b, "
                         f"round(covar_pop(ra, rb) / sqrt(var_pop(ra) * var_pop(rb)), 6) + 0.0 AS r FROM {src}")
    return _E + " UNION ALL ".join(parts)


@register("corr_spearman_missing", sql=_pairwise_spearman_sql())
def corr_spearman_missing(spark, sf):
    return rounded(correlate.correlation(events_with_nulls(spark, sf), ["user_id", "value", "event_id"],
                                         "spearman"))


@register("heatmap_matrix", sql=f"""
SELECT var_a, var_b, r, -1.0 AS z_min, 1.0 AS z_max, printf('%.2f', r) AS text
FROM ({_matrix_sql('lineitem', _COLS)}) m""")
def heatmap_matrix(spark, sf):
    return rounded(correlate.heatmap_matrix(table(spark, sf, "lineitem"), _COLS))


_T_SQL = """
WITH m AS (SELECT count(l_discount) AS n1, avg(l_discount) AS m1, var_samp(l_discount) AS v1,
                  count(l_tax) AS n2, avg(l_tax) AS m2, var_samp(l_tax) AS v2 FROM lineitem)
SELECT round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 6) + 0.0 AS t,
       (n1 + n2 - 2)::BIGINT AS dof, n1::BIGINT AS n1, n2::BIGINT AS n2, 'ok' AS status FROM m"""


@register("ttest_ind", sql=_T_SQL)
def ttest_ind(spark, sf):
    return rounded(hypothesis.ttest_ind(table(spark, sf, "lineitem"), "l_discount", "l_tax", with_pvalue=False))


@register("ttest_pvalue")
def ttest_pvalue(spark, sf):
    """T1 with its p-value (X1): compare l_quantity between two return flags."""
    return hypothesis.ttest_groups(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag", "A", "R")


_CHI_SQL = """
WITH c AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {t} GROUP BY 1, 2),
ra AS (SELECT a, sum(o) AS ra FROM c GROUP BY a), cb AS (SELECT b, sum(o) AS cb FROM c GROUP BY b),
n AS (SELECT sum(o)::DOUBLE AS n FROM c),
cell AS (SELECT c.o, ra.ra * cb.cb / n.n AS e FROM c JOIN ra USING (a) JOIN cb USING (b) CROSS JOIN n),
k AS (SELECT (SELECT count(*) FROM ra) AS r, (SELECT count(*) FROM cb) AS cc)
SELECT round(s, 6) + 0.0 AS stat, dof, n, round({p}, 6) + 0.0 AS p FROM (
  SELECT CASE WHEN (r - 1) * (cc - 1) = 1
              THEN sum(power(greatest(abs(o - e) - 0.5, 0.0), 2) / e)
              ELSE sum(power(o - e, 2) / e) END AS s,
         ((r - 1) * (cc - 1))::BIGINT AS dof, (SELECT n FROM n)::BIGINT AS n
  FROM cell CROSS JOIN k GROUP BY r, cc) x"""


@register("chi_square", sql=_CHI_SQL.format(a="l_returnflag", b="l_linestatus", t="lineitem", p="exp(-s / 2)"))
def chi_square(spark, sf):
    """3 × 2 table, dof 2: the p-value has the closed form exp(-x/2)."""
    return rounded(hypothesis.chi_square(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"))


@register("chi_square_yates", sql=_CHI_SQL.format(a="quality", b="toxic", t="labels", p="0.0").replace(
    "round(0.0, 6) + 0.0 AS p", "0.0 AS p_unused").replace(", round(s, 6)", ", round(s, 6)"))
def chi_square_yates(spark, sf):
    out = hypothesis.chi_square(table(spark, sf, "labels"), "quality", "toxic", with_pvalue=False)
    return rounded(out.selectExpr("stat", "dof", "n", "0.0 AS p_unused"))


@register("chi_square_pvalue")
def chi_square_pvalue(spark, sf):
    """T2 p-value for dof 1 (incomplete gamma, X1 on the result row)."""
    return hypothesis.chi_square(table(spark, sf, "labels"), "quality", "toxic")


@register("p_values", sql="""
WITH s AS (SELECT p_size, p_size / 10.0::DOUBLE AS t, p_size::DOUBLE AS x, count(*) AS n FROM part GROUP BY ALL)
SELECT p_size, n, round(1 - 2 / pi() * atan(t), 9) + 0.0 AS t1, round(1 - t / sqrt(2 + t * t), 9) + 0.0 AS t2,
       round(1 - 2 / pi() * (atan(t / sqrt(3)) + t * sqrt(3) / (3 + t * t)), 9) + 0.0 AS t3,
       round(exp(-x / 2), 9) + 0.0 AS c2, round(exp(-x / 2) * (1 + x / 2), 9) + 0.0 AS c4,
       round(exp(-x / 2) * (1 + x / 2 + x * x / 8), 9) + 0.0 AS c6 FROM s""")
def p_values(spark, sf):
    """X1 against closed forms: t with 1, 2 and 3 degrees of freedom, chi-square with 2, 4 and 6."""
    sizes = table(spark, sf, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))
    t, x = F.col("p_size") / F.lit(10.0), F.col("p_size").cast("double")
    return rounded(sizes.select("p_size", "n", *[t_pvalue(t, F.lit(k)).alias(f"t{k}") for k in (1, 2, 3)],
                                *[chi2_pvalue(x, F.lit(k)).alias(f"c{k}") for k in (2, 4, 6)]), 9)


@register("expected_counts", sql="""
WITH c AS (SELECT l_returnflag, l_linestatus, count(*) AS o FROM lineitem GROUP BY 1, 2),
ra AS (SELECT l_returnflag, sum(o) AS ra FROM c GROUP BY 1), cb AS (SELECT l_linestatus, sum(o) AS cb FROM c GROUP BY 1)
SELECT l_returnflag, l_linestatus, o::BIGINT AS observed,
       round(ra * cb / (SELECT sum(o) FROM c)::DOUBLE, 6) + 0.0 AS expected
FROM c JOIN ra USING (l_returnflag) JOIN cb USING (l_linestatus)""")
def expected_counts(spark, sf):
    return rounded(hypothesis.expected_counts(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"))


def _grouped_matrix_sql(src: str, cols: list[str], group: str) -> str:
    parts = []
    for a in cols:
        for b in cols:
            r = (f"covar_pop({a}, {b}) / sqrt(var_pop(CASE WHEN {b} IS NOT NULL THEN {a} END) "
                 f"* var_pop(CASE WHEN {a} IS NOT NULL THEN {b} END))")
            parts.append(f"SELECT {group}, '{a}' AS var_a, '{b}' AS var_b, round({r}, 6) + 0.0 AS r "
                         f"FROM {src} GROUP BY {group}")
    return " UNION ALL ".join(parts)


_GCOLS = ["l_quantity", "l_extendedprice", "l_discount"]


@register("corr_pearson_by_group", sql=_grouped_matrix_sql("lineitem", _GCOLS, "l_returnflag"))
def corr_pearson_by_group(spark, sf):
    return rounded(correlate.correlation(table(spark, sf, "lineitem"), _GCOLS, "pearson", by=["l_returnflag"]))


@register("corr_spearman_by_group", sql="WITH rk AS (SELECT l_returnflag, " + ", ".join(
    f"rank() OVER (PARTITION BY l_returnflag ORDER BY {c}) "
    f"+ (count(*) OVER (PARTITION BY l_returnflag, {c}) - 1) / 2.0 AS {c}" for c in _GCOLS)
    + " FROM lineitem) " + _grouped_matrix_sql("rk", _GCOLS, "l_returnflag"))
def corr_spearman_by_group(spark, sf):
    return rounded(correlate.correlation(table(spark, sf, "lineitem"), _GCOLS, "spearman", by=["l_returnflag"]))


@register("ttest_by_group", sql="""
WITH m AS (SELECT l_linestatus, count(l_discount) AS n1, avg(l_discount) AS m1, var_samp(l_discount) AS v1,
                  count(l_tax) AS n2, avg(l_tax) AS m2, var_samp(l_tax) AS v2 FROM lineitem GROUP BY 1)
SELECT l_linestatus,
       round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 6) + 0.0 AS t,
       (n1 + n2 - 2)::BIGINT AS dof, n1::BIGINT AS n1, n2::BIGINT AS n2, 'ok' AS status FROM m""")
def ttest_by_group(spark, sf):
    return rounded(hypothesis.ttest_ind(table(spark, sf, "lineitem"), "l_discount", "l_tax", by=["l_linestatus"],
                                        with_pvalue=False))
