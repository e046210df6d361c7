"""Registered queries: time parsing and forecasting (P9, F1-F4, F6) on
events: value over ts, one series per user_id, ties broken by event_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import forecast as fc
from quarry.operators import likelihood
from quarry.plans.registry import register, rounded, table


def _series(spark, sf):
    ev = table(spark, sf, "events")
    return fc.as_series(ev, "ts", "value", key="user_id", tiebreak="event_id", materialize=True)


# The twins work on rows and lists: residuals of the long autoregression are
# taken row by row, shocks and forecasts by recursion over a series' list.
_BASE = """
s AS (SELECT user_id, ts, value AS y, row_number() OVER w AS t, count(*) OVER (PARTITION BY user_id) AS n,
             value - lag(value) OVER w AS d, ts - lag(ts) OVER w AS gap
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
l AS (SELECT *, lag(d, 1) OVER w AS d1, lag(d, 2) OVER w AS d2, lag(d, 3) OVER w AS d3, lag(d, 4) OVER w AS d4,
             lag(d, 5) OVER w AS d5, lag(d, 6) OVER w AS d6, lag(d, 7) OVER w AS d7
      FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t)),
r AS (SELECT user_id, max(n) AS n, [sum(d * d), sum(d * d1), sum(d * d2), sum(d * d3), sum(d * d4), sum(d * d5), sum(d * d6)] AS r
      FROM l GROUP BY 1),
lev AS (SELECT user_id, r, 1 AS k, [r[2] / r[1]] AS a, r[1] * (1 - power(r[2] / r[1], 2)) AS e FROM r WHERE r[1] > 0
        UNION ALL
        SELECT user_id, r, k + 1, list_concat(list_transform(range(1, k + 1), lambda j: a[j] - w * a[k + 1 - j]), [w]), e * (1 - w * w)
        FROM (SELECT *, (r[k + 2] - list_sum(list_transform(range(1, k + 1), lambda j: a[j] * r[k + 2 - j]))) / e AS w FROM lev WHERE k < 6)),
x AS (SELECT l.user_id, d, d1, d1 - (a[1] * d2 + a[2] * d3 + a[3] * d4 + a[4] * d5 + a[5] * d6 + a[6] * d7) AS e
      FROM l JOIN lev USING (user_id) WHERE k = 6 AND d7 IS NOT NULL),
g AS (SELECT user_id, sum(d * d) AS yy, sum(d * d1) AS ya, sum(d * e) AS ye, sum(d1 * d1) AS aa, sum(d1 * e) AS ae, sum(e * e) AS ee,
             count(*) AS n2 FROM x GROUP BY 1),
raw AS (SELECT r.user_id, r.n, g.*, (ee * ya - ae * ye) / nullif(aa * ee - ae * ae, 0) AS p, (aa * ye - ae * ya) / nullif(aa * ee - ae * ae, 0) AS q
        FROM r LEFT JOIN g USING (user_id)),
fit AS (SELECT *, n >= 11 AND p IS NOT NULL AND q IS NOT NULL AND NOT isnan(p) AND NOT isnan(q) AS ok FROM raw),
par AS (SELECT user_id, n, CASE WHEN ok THEN greatest(-0.99, least(0.99, p)) ELSE 0 END AS phi,
               CASE WHEN ok THEN greatest(-0.99, least(0.99, q)) ELSE 0 END AS theta,
               CASE WHEN ok THEN 'ok' ELSE 'too_short_or_constant' END AS status, yy, ya, ye, aa, ae, ee, n2 FROM fit)"""
_FORECAST_BODY = f"""WITH RECURSIVE {_BASE},
ser AS (SELECT user_id, list(d ORDER BY t) FILTER (d IS NOT NULL) AS ds, max_by(y, t) AS y_last, max(ts) AS ts_last,
               min(gap) AS lo, max(gap) AS hi FROM s GROUP BY 1),
sh AS (SELECT *, list_reduce(list_transform(range(0, len(ds) + 1), lambda i: {{'d': CASE WHEN i = 0 THEN 0.0 ELSE ds[i] END, 'e': 0.0}}),
                             lambda b, c: {{'d': c.d, 'e': c.d - phi * b.d - theta * b.e}}) AS z FROM ser JOIN par USING (user_id)),
ah AS (SELECT user_id, n, step, CASE WHEN lo = hi AND lo > INTERVAL 0 SECOND THEN ts_last + lo * step END AS ts,
              y_last + list_sum(list_transform(range(0, step), lambda i: power(phi, i) * (phi * z.d + theta * z.e))) AS yhat
       FROM sh CROSS JOIN range(1, 11) t(step))
"""
# The exact likelihood by the filter itself, a step at a time.
_LIKELIHOOD_AT = [(0.5, 0.3), (-0.2, 0.7), (0.0, -0.9), (0.8, -0.8), (-0.6, -0.4)]
_LIKELIHOOD_SQL = f"""
WITH s AS (SELECT user_id, value - lag(value) OVER w AS d, row_number() OVER w AS t
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
l AS (SELECT user_id, list(d ORDER BY t) AS ds FROM s WHERE d IS NOT NULL GROUP BY 1),
p AS (SELECT * FROM l CROSS JOIN (VALUES {", ".join(f"({p}::DOUBLE, {q}::DOUBLE)" for p, q in _LIKELIHOOD_AT)}) v(phi, theta)),
f AS (SELECT user_id, phi, theta, len(ds) AS m,
             list_reduce(list_transform(range(0, len(ds) + 1), lambda i: {{'d': CASE WHEN i = 0 THEN 0.0 ELSE ds[i] END,
                                          'v': 0.0::DOUBLE, 'r': CASE WHEN i = 0 THEN 0.0 ELSE 1.0 END, 's': 0.0::DOUBLE, 'g': 0.0::DOUBLE}}),
               lambda b, c: {{'d': c.d,
                 'v': c.d - phi * b.d - CASE WHEN b.r = 0 THEN 0 ELSE theta * b.v / b.r END,
                 'r': CASE WHEN b.r = 0 THEN (1 + 2 * phi * theta + theta * theta) / (1 - phi * phi) ELSE 1 + theta * theta - theta * theta / b.r END,
                 's': b.s + power(c.d - phi * b.d - CASE WHEN b.r = 0 THEN 0 ELSE theta * b.v / b.r END, 2)
                      / CASE WHEN b.r = 0 THEN (1 + 2 * phi * theta + theta * theta) / (1 - phi * phi) ELSE 1 + theta * theta - theta * theta / b.r END,
                 'g': b.g + ln(CASE WHEN b.r = 0 THEN (1 + 2 * phi * theta + theta * theta) / (1 - phi * phi) ELSE 1 + theta * theta - theta * theta / b.r END)}}) AS z
      FROM p)
SELECT user_id, phi, theta, round(z.s / m, 3) + 0.0 AS sigma2, round(-0.5 * (m * (ln(2 * pi() * z.s / m) + 1) + z.g), 6) + 0.0 AS loglik FROM f"""


@register("parse_time", sql="SELECT event_id, ts FROM events")
def parse_time(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.col("ts").cast("string").alias("ts"))
    return fc.parse_time(ev, "ts")


@register("parse_time_text", sql="""
SELECT event_id, date_trunc('second', ts) AS a, date_trunc('day', ts) AS b, date_trunc('day', ts) AS c FROM events""")
def parse_time_text(spark, sf):
    """P9 from texts that are not ISO, no format given."""
    ev = table(spark, sf, "events").select("event_id", F.date_format("ts", "M/d/yyyy H:mm:ss").alias("a"),
                                           F.date_format("ts", "MMM d, yyyy").alias("b"), F.date_format("ts", "M/d/yyyy").alias("c"))
    return fc.parse_time(fc.parse_time(fc.parse_time(ev, "a"), "b"), "c")


@register("series_order_ties", sql="""
SELECT event_type, row_number() OVER w AS t, count(*) OVER (PARTITION BY event_type) AS n, ts, value AS y
FROM (SELECT event_type, date_trunc('day', ts) AS ts, floor(value) AS value FROM events UNION ALL
      SELECT event_type, date_trunc('day', ts) AS ts, floor(value) AS value FROM events) e
WINDOW w AS (PARTITION BY event_type ORDER BY ts, value)""")
def series_order_ties(spark, sf):
    """F1 without a tiebreak, over rows that occur many times."""
    ev = table(spark, sf, "events").select("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"),
                                           F.floor("value").cast("double").alias("value"))
    return fc.as_series(ev.unionAll(ev), "ts", "value", key="event_type")


@register("series_order", sql="""
SELECT user_id, row_number() OVER w AS t, count(*) OVER (PARTITION BY user_id) AS n, ts, value AS y
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def series_order(spark, sf):
    return _series(spark, sf)


@register("difference", sql="""
SELECT user_id, row_number() OVER w AS t, count(*) OVER (PARTITION BY user_id) AS n, ts, value AS y,
       round(value - lag(value) OVER w, 6) + 0.0 AS dy
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def difference(spark, sf):
    return rounded(fc.difference(_series(spark, sf), "user_id"))


@register("arima_fit", sql=f"""WITH RECURSIVE {_BASE}
SELECT user_id, round(phi, 6) + 0.0 AS phi, round(theta, 6) + 0.0 AS theta,
       round((yy + phi * phi * aa + theta * theta * ee - 2 * (phi * ya + theta * ye - phi * theta * ae)) / nullif(n2, 0), 6) + 0.0 AS sigma2,
       n, status FROM par""")
def arima_fit(spark, sf):
    return rounded(fc.arima_fit(_series(spark, sf), "user_id"))


@register("arima_forecast", headline=True, sql=_FORECAST_BODY + """
SELECT user_id, step::INTEGER AS step, ts, round(yhat, 6) + 0.0 AS yhat FROM ah""")
def arima_forecast(spark, sf):
    return rounded(fc.arima_forecast(_series(spark, sf), "user_id", 10))


@register("series_with_forecast", sql=_FORECAST_BODY + """
SELECT user_id, 'history' AS kind, t, ts, y FROM s
UNION ALL
SELECT user_id, 'forecast' AS kind, n + step AS t, ts, round(yhat, 6) + 0.0 AS y FROM ah""")
def series_with_forecast(spark, sf):
    return rounded(fc.series_with_forecast(_series(spark, sf), "user_id", 10))


@register("arima_refine")
def arima_refine(spark, sf):
    """exact maximum likelihood for every series (iterative; no SQL form,
    its likelihood has one: ``arima_likelihood``)."""
    return fc.arima_refine(_series(spark, sf), "user_id")


@register("arima_likelihood", sql=_LIKELIHOOD_SQL)
def arima_likelihood(spark, sf):
    """the exact likelihood at given parameters, by the parallel filter
    (small blocks, so that series cross them)."""
    out = likelihood.exact_log_likelihood(_series(spark, sf), _LIKELIHOOD_AT, "user_id", points=16)
    return rounded(out.withColumn("sigma2", F.round("sigma2", 3)))


@register("arima_forecast_refined")
def arima_forecast_refined(spark, sf):
    """F4 from F5's fit."""
    series = _series(spark, sf)
    return rounded(fc.arima_forecast(series, "user_id", 10, fit=fc.arima_refine(series, "user_id")))
