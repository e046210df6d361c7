"""Registered queries: outliers (P4-P6) and single-predictor regression
(R1-R4) on documents: n_chars on the word count."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import outliers, regress
from quarry.plans.registry import (DOCUMENTS_WORDS_SQL, column_listing_sql, documents_words, register, rounded,
                                   table)

_Z = """
d AS ({docs}),
s AS (SELECT avg(n_words) AS mx, stddev_samp(n_words) AS sx,
             avg(n_chars) AS my, stddev_samp(n_chars) AS sy FROM d),
m AS (SELECT d.*, coalesce(abs((n_words - mx) / sx) <= 3.0 AND abs((n_chars - my) / sy) <= 3.0, false) AS keep
      FROM d CROSS JOIN s)""".format(docs=DOCUMENTS_WORDS_SQL)

_FIT_COLUMNS = """
  regr_count(n_chars, n_words)::BIGINT AS n,
  regr_r2(n_chars, n_words) AS r2,
  regr_intercept(n_chars, n_words) AS intercept,
  regr_slope(n_chars, n_words) AS slope,
  sqrt(greatest(regr_syy(n_chars, n_words) - regr_slope(n_chars, n_words) * regr_sxy(n_chars, n_words), 0.0)
       / (regr_count(n_chars, n_words) - 2) / regr_sxx(n_chars, n_words)) AS slope_se"""


def _fit_sql(source: str, extra: str = "", group: str = "") -> str:
    return f"""
SELECT {group} n, {extra} round(r2, 6) + 0.0 AS r2, round(intercept, 6) + 0.0 AS intercept,
       round(slope, 6) + 0.0 AS slope, round(slope_se, 6) + 0.0 AS slope_se,
       round(slope / slope_se, 6) + 0.0 AS slope_t, 'ok' AS status
FROM ({source}) f"""


@register("ols_single", sql="WITH" + _Z + _fit_sql(
    f"SELECT {_FIT_COLUMNS}, 0::BIGINT AS n_excluded FROM d", "n_excluded,"))
def ols_single(spark, sf):
    fit = regress.ols(documents_words(spark, sf), "n_words", "n_chars", with_pvalue=False)
    return rounded(fit)


@register("ols_single_outliers", headline=True, sql="WITH" + _Z + _fit_sql(
    f"SELECT {_FIT_COLUMNS}, (SELECT count(*) FROM m WHERE NOT keep) AS n_excluded FROM m WHERE keep",
    "n_excluded,"))
def ols_single_outliers(spark, sf):
    fit = regress.ols(documents_words(spark, sf), "n_words", "n_chars", outlier_threshold=3.0,
                      with_pvalue=False)
    return rounded(fit)


@register("ols_single_by_group", sql="WITH" + _Z + _fit_sql(
    f"SELECT lang, {_FIT_COLUMNS}, 0::BIGINT AS n_excluded FROM d GROUP BY lang", "n_excluded,", "lang,"))
def ols_single_by_group(spark, sf):
    fit = regress.ols(documents_words(spark, sf), "n_words", "n_chars", by=["lang"], with_pvalue=False)
    return rounded(fit)


@register("ols_single_pvalue")
def ols_single_pvalue(spark, sf):
    """R1 with the slope p-value (X1 on the result row; no SQL form)."""
    return regress.ols(documents_words(spark, sf), "n_words", "n_chars", by=["lang"],
                       outlier_threshold=3.0).select("lang", "slope_t", "slope_p")


@register("exclude_outliers", sql="WITH" + _Z + " SELECT doc_id, lang, n_words, n_chars FROM m WHERE keep")
def exclude_outliers(spark, sf):
    return outliers.exclude_outliers(documents_words(spark, sf), ["n_words", "n_chars"], 3.0)


@register("outlier_rows", sql="WITH" + _Z + " SELECT doc_id, lang, n_words, n_chars FROM m WHERE NOT keep")
def outlier_rows(spark, sf):
    return outliers.outlier_rows(documents_words(spark, sf), ["n_words", "n_chars"], 3.0)


@register("outlier_count", sql="WITH" + _Z + " SELECT count(*) FILTER (WHERE NOT keep)::BIGINT AS n_excluded FROM m")
def outlier_count(spark, sf):
    return outliers.outlier_count(documents_words(spark, sf), ["n_words", "n_chars"], 3.0)


_LINE_SQL = "WITH" + _Z + """,
f AS (SELECT regr_intercept(n_chars, n_words) AS a, regr_slope(n_chars, n_words) AS b FROM m WHERE keep),
r AS (SELECT min(n_words) AS lo, max(n_words) AS hi FROM d)
SELECT i::INTEGER AS i,
       round(CASE WHEN i = 99 THEN hi ELSE lo + i * ((hi - lo) / 99.0) END, 6) + 0.0 AS x,
       round(a + b * CASE WHEN i = 99 THEN hi ELSE lo + i * ((hi - lo) / 99.0) END, 6) + 0.0 AS y_hat
FROM r CROSS JOIN f CROSS JOIN range(100) t(i)"""


@register("regression_line", sql=_LINE_SQL)
def regression_line(spark, sf):
    docs = documents_words(spark, sf)
    fit = regress.ols(docs, "n_words", "n_chars", outlier_threshold=3.0, with_pvalue=False)
    return rounded(regress.regression_line(docs, "n_words", fit, 100))


_RESID_SQL = "WITH" + _Z + """,
f AS (SELECT regr_intercept(n_chars, n_words) AS a, regr_slope(n_chars, n_words) AS b FROM m WHERE keep)
SELECT doc_id, round(a + b * n_words, 6) + 0.0 AS y_hat, round(n_chars - (a + b * n_words), 6) + 0.0 AS residual
FROM m CROSS JOIN f WHERE keep"""


@register("residuals", sql=_RESID_SQL)
def residuals(spark, sf):
    docs = documents_words(spark, sf)
    kept = outliers.exclude_outliers(docs, ["n_words", "n_chars"], 3.0)
    fit = regress.ols(kept, "n_words", "n_chars", with_pvalue=False)
    res = regress.residuals(kept, "n_words", "n_chars", fit)
    return rounded(res.select("doc_id", "y_hat", "residual"))


# ------------------------------------------------------------ several x

def _normal2_sql(src: str, x1: str, x2: str, y: str) -> str:
    """Two-predictor least squares from centred moments, in SQL."""
    return f"""
WITH s AS (SELECT count(*) AS n, avg({x1}) AS m1, avg({x2}) AS m2, avg({y}) AS my,
                  var_pop({x1}) AS s11, var_pop({x2}) AS s22, covar_pop({x1}, {x2}) AS s12,
                  covar_pop({x1}, {y}) AS s1y, covar_pop({x2}, {y}) AS s2y, var_pop({y}) AS syy FROM {src}),
b AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
                (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM s),
f AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, (b1 * s1y + b2 * s2y) / syy AS r2 FROM b)"""


def _coef_sql(src, x1, x2, y):
    return _normal2_sql(src, x1, x2, y) + f"""
SELECT v AS variable, round(c, 6) + 0.0 AS coefficient, round(r2, 6) + 0.0 AS r2, n::BIGINT AS n, 'ok' AS status
FROM f CROSS JOIN LATERAL (VALUES ('__intercept__', b0), ('{x1}', b1), ('{x2}', b2)) t(v, c)"""


@register("ols_multiple", sql=_coef_sql("part", "p_partkey", "p_size", "p_retailprice"))
def ols_multiple(spark, sf):
    part = table(spark, sf, "part")
    return rounded(regress.ols_multiple(part, ["p_partkey", "p_size"], "p_retailprice"))


@register("ols_multiple_lineitem", sql=_coef_sql("lineitem", "l_quantity", "l_discount", "l_extendedprice"))
def ols_multiple_lineitem(spark, sf):
    li = table(spark, sf, "lineitem")
    return rounded(regress.ols_multiple(li, ["l_quantity", "l_discount"], "l_extendedprice"))


@register("ols_multiple_by_group", sql="""
WITH s AS (SELECT p_size % 5 AS g, count(*) AS n, avg(p_partkey) AS m1, avg(p_retailprice) AS my,
                  var_pop(p_partkey) AS s11, covar_pop(p_partkey, p_retailprice) AS s1y,
                  var_pop(p_retailprice) AS syy FROM part GROUP BY 1)
SELECT g, v AS variable, round(c, 6) + 0.0 AS coefficient, round(s1y * s1y / s11 / syy, 6) + 0.0 AS r2,
       n::BIGINT AS n, 'ok' AS status
FROM s CROSS JOIN LATERAL (VALUES ('__intercept__', my - s1y / s11 * m1), ('p_partkey', s1y / s11)) t(v, c)""")
def ols_multiple_by_group(spark, sf):
    part = table(spark, sf, "part").withColumn("g", F.col("p_size") % 5)
    return rounded(regress.ols_multiple(part, ["p_partkey"], "p_retailprice", by=["g"]))


@register("ols_predict", sql=_normal2_sql("part", "p_partkey", "p_size", "p_retailprice") + """
SELECT p_partkey, round(b0 + b1 * p_partkey + b2 * p_size, 6) + 0.0 AS y_hat FROM part CROSS JOIN f""")
def ols_predict(spark, sf):
    part = table(spark, sf, "part")
    model = regress.ols_multiple(part, ["p_partkey", "p_size"], "p_retailprice")
    pred = regress.ols_predict(part, ["p_partkey", "p_size"], model)
    return rounded(pred.select("p_partkey", "y_hat"))


@register("r2_score", sql=_normal2_sql("part", "p_partkey", "p_size", "p_retailprice") + """,
p AS (SELECT p_retailprice AS y, b0 + b1 * p_partkey + b2 * p_size AS y_hat FROM part CROSS JOIN f)
SELECT round(1 - sum(power(y - y_hat, 2)) / (var_pop(y) * count(y)), 6) + 0.0 AS r2 FROM p""")
def r2_score(spark, sf):
    part = table(spark, sf, "part")
    model = regress.ols_multiple(part, ["p_partkey", "p_size"], "p_retailprice")
    pred = regress.ols_predict(part, ["p_partkey", "p_size"], model)
    return rounded(regress.r2_score(pred, "p_retailprice", "y_hat"))


@register("require_numeric", sql="SELECT name, is_numeric AS usable, n_present FROM ("
          + column_listing_sql("part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"])
          + ") c")
def require_numeric(spark, sf):
    """The numeric check as a table: each column of part and whether it
    may be used as X or Y."""
    from quarry.operators.explore import list_columns
    cols = list_columns(table(spark, sf, "part"), with_counts=True)
    return cols.select("name", F.col("is_numeric").alias("usable"), "n_present")


@register("outlier_count_by_group", sql=f"""
WITH d AS ({DOCUMENTS_WORDS_SQL}),
s AS (SELECT lang AS g, avg(n_words) AS mx, stddev_samp(n_words) AS sx,
             avg(n_chars) AS my, stddev_samp(n_chars) AS sy FROM d GROUP BY lang),
m AS (SELECT d.lang, coalesce(abs((n_words - mx) / sx) <= 3.0 AND abs((n_chars - my) / sy) <= 3.0, false) AS keep
      FROM d JOIN s ON d.lang = s.g)
SELECT lang, count(*) FILTER (WHERE NOT keep)::BIGINT AS n_excluded FROM m GROUP BY lang""")
def outlier_count_by_group(spark, sf):
    """P6 with z-scores per language (the grouped statistics are attached by
    the skew-safe lookup join)."""
    return outliers.outlier_count(documents_words(spark, sf), ["n_words", "n_chars"], 3.0, by=["lang"])
