"""Registered queries: data behind the charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import outliers, plotdata, regress
from quarry.plans.registry import (DOCUMENTS_WORDS_SQL, as_money, documents_words, exact_mean_sql, register,
                                   rounded, table)


def _bins_sql(src: str, cols: list[str], bins: int = 20) -> str:
    spans = ", ".join(f"min({c}) AS lo{i}, max({c}) AS hi{i}" for i, c in enumerate(cols))
    keys = ", ".join(
        f"least(greatest(coalesce(floor(({c} - lo{i}) * {bins}.0 / nullif(hi{i} - lo{i}, 0)), 0), 0), {bins - 1})::INTEGER AS b{i}"
        for i, c in enumerate(cols))
    edges = ", ".join(
        f"round(lo{i} + b{i} * ((hi{i} - lo{i}) / {bins}), 6) + 0.0 AS lo{i}, "
        f"round(lo{i} + (b{i} + 1) * ((hi{i} - lo{i}) / {bins}), 6) + 0.0 AS hi{i}" for i in range(len(cols)))
    bs = ", ".join(f"b{i}" for i in range(len(cols)))
    his = ", ".join(f"lo{i}, hi{i}" for i in range(len(cols)))
    return f"""
WITH src AS ({src}), s AS (SELECT {spans} FROM src),
k AS (SELECT {keys}, {his} FROM src CROSS JOIN s)
SELECT {bs}, {edges}, count(*)::BIGINT AS n FROM k GROUP BY {bs}, {his}"""


_LI = "SELECT l_quantity, l_extendedprice, l_discount FROM lineitem"


@register("scatter_points", sql=_bins_sql(_LI, ["l_quantity", "l_extendedprice"]))
def scatter_points(spark, sf):
    return rounded(plotdata.scatter_bins(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], 20))


@register("scatter3_points", sql=_bins_sql(_LI, ["l_quantity", "l_discount", "l_extendedprice"]))
def scatter3_points(spark, sf):
    return rounded(plotdata.scatter_bins(table(spark, sf, "lineitem"),
                                         ["l_quantity", "l_discount", "l_extendedprice"], 20))


@register("line_series", sql="""
WITH b AS (SELECT event_type, date_trunc('hour', ts) AS bucket, count(value)::BIGINT AS n,
                  min(value) AS min, max(value) AS max,
                  CAST(sum(CAST(value AS DECIMAL(18,2))) * 100 AS HUGEINT) AS cents FROM events GROUP BY 1, 2)
SELECT event_type, bucket, n, min, max,
       CAST(CAST((2 * cents * 10000 + n) // (2 * n) AS DECIMAL(38,0)) * CAST(0.000001 AS DECIMAL(18,6)) AS DOUBLE) AS avg
FROM b""")
def line_series(spark, sf):
    """G3 on events.value, a two-decimal amount, read as DECIMAL(18,2) so
    that sums and the average are exact (values are non-negative, so the
    oracle's integer half-up rounding applies)."""
    ev = table(spark, sf, "events").withColumn("value", F.col("value").cast("decimal(18,2)"))
    return plotdata.line_series(ev, "ts", "value", "hour", "event_type")


_RESID = f"""
WITH d AS ({DOCUMENTS_WORDS_SQL}),
s AS (SELECT avg(n_words) AS mx, stddev_samp(n_words) AS sx, avg(n_chars) AS my, stddev_samp(n_chars) AS sy FROM d),
m AS (SELECT d.* FROM d CROSS JOIN s WHERE abs((n_words - mx) / sx) <= 3.0 AND abs((n_chars - my) / sy) <= 3.0),
f AS (SELECT regr_intercept(n_chars, n_words) AS a, regr_slope(n_chars, n_words) AS b FROM m)
SELECT a + b * n_words AS y_hat, n_chars - (a + b * n_words) AS residual FROM m CROSS JOIN f"""


@register("residual_points", sql=_bins_sql(_RESID, ["y_hat", "residual"]))
def residual_points(spark, sf):
    docs = documents_words(spark, sf)
    kept = outliers.exclude_outliers(docs, ["n_words", "n_chars"], 3.0)
    fit = regress.ols(kept, "n_words", "n_chars", with_pvalue=False)
    res = regress.residuals(kept, "n_words", "n_chars", fit)
    return rounded(plotdata.scatter_bins(res, ["y_hat", "residual"], 20))


_REPORT_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]


def _report_sql() -> str:
    num = ["l_quantity", "l_extendedprice", "l_discount"]
    parts = ["SELECT 'shape' AS section, 'table' AS name, 'n_rows' AS metric, count(*)::DOUBLE AS value FROM lineitem",
             f"SELECT 'shape', 'table', 'n_cols', {len(_REPORT_COLS)}.0"]
    for c in num:
        for m, e in (("count", f"count({c})::DOUBLE"), ("mean", exact_mean_sql(c)), ("std", f"stddev_samp({c})"),
                     ("min", f"min({c})"), ("max", f"max({c})")):
            parts.append(f"SELECT 'statistics', '{c}', '{m}', {e} FROM lineitem")
    for c in _REPORT_COLS:
        parts.append(f"SELECT 'missing', '{c}', 'n_missing', count(*) FILTER (WHERE {c} IS NULL)::DOUBLE FROM lineitem")
    return ("SELECT section, name, metric, round(value, 6) + 0.0 AS value FROM ("
            + " UNION ALL ".join(parts) + ") r")


@register("analysis_report", sql=_report_sql())
def analysis_report(spark, sf):
    li = as_money(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(plotdata.analysis_report(li, _REPORT_COLS))


_RESULTS_SQL = f"""
SELECT * FROM ({_report_sql()}) UNION ALL
SELECT 'regression', 'table', m.metric, round(m.value, 6) + 0.0
FROM (SELECT unnest([{{'metric': 'n', 'value': n::DOUBLE}}, {{'metric': 'r2', 'value': r2}}, {{'metric': 'intercept', 'value': a}},
                     {{'metric': 'slope', 'value': b}}]) AS m
      FROM (SELECT regr_count(l_extendedprice, l_quantity) AS n, regr_r2(l_extendedprice, l_quantity) AS r2,
                   regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem)) UNION ALL
SELECT 'groups', l_returnflag, 'n', count(*)::DOUBLE FROM lineitem GROUP BY ALL"""


@register("analysis_report_results", sql=_RESULTS_SQL)
def analysis_report_results(spark, sf):
    """G6 with fitted results as further sections."""
    li = as_money(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    fit = regress.ols(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", with_pvalue=False).select("n", "r2", "intercept", "slope")
    groups = li.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return rounded(plotdata.analysis_report(li, _REPORT_COLS, {"regression": fit, "groups": groups}))
