"""Registered queries: missing values and scaling (P3, P8, A2-A5, C1) on
events with a missing value on every 7th event id."""

from __future__ import annotations

from quarry.operators import clean
from quarry.plans.registry import EVENTS_WITH_NULLS_SQL, events_with_nulls, register, rounded

_E = f"WITH e AS ({EVENTS_WITH_NULLS_SQL})"


@register("drop_missing", sql=_E + """
SELECT * FROM e WHERE event_id IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL
  AND value IS NOT NULL""")
def drop_missing(spark, sf):
    return clean.drop_missing(events_with_nulls(spark, sf))


@register("missing_counts", sql=_E + """
SELECT * FROM (VALUES ('event_id', (SELECT count(*) FILTER (WHERE event_id IS NULL) FROM e)),
                      ('user_id', (SELECT count(*) FILTER (WHERE user_id IS NULL) FROM e)),
                      ('event_type', (SELECT count(*) FILTER (WHERE event_type IS NULL) FROM e)),
                      ('value', (SELECT count(*) FILTER (WHERE value IS NULL) FROM e))) t("column", n_missing)""")
def missing_counts(spark, sf):
    return clean.missing_counts(events_with_nulls(spark, sf))


@register("fill_mean", sql=_E + """
SELECT event_id, user_id, event_type,
       round(coalesce(value, (SELECT avg(value) FROM e)), 6) + 0.0 AS value FROM e""")
def fill_mean(spark, sf):
    return rounded(clean.fill_mean(events_with_nulls(spark, sf), ["value"]))


@register("standardize", sql=_E + """
SELECT event_id, event_type,
       round((user_id - s.mu) / s.su, 6) + 0.0 AS user_id,
       round((value - s.mv) / s.sv, 6) + 0.0 AS value
FROM e CROSS JOIN (SELECT avg(user_id) mu, stddev_samp(user_id) su, avg(value) mv, stddev_samp(value) sv FROM e) s""")
def standardize(spark, sf):
    return rounded(clean.standardize(events_with_nulls(spark, sf), ["user_id", "value"]))


@register("normalize", sql=_E + """
SELECT event_id, event_type,
       round((user_id - s.lu) / (s.hu - s.lu), 6) + 0.0 AS user_id,
       round((value - s.lv) / (s.hv - s.lv), 6) + 0.0 AS value
FROM e CROSS JOIN (SELECT min(user_id) lu, max(user_id) hu, min(value) lv, max(value) hv FROM e) s""")
def normalize(spark, sf):
    return rounded(clean.normalize(events_with_nulls(spark, sf), ["user_id", "value"]))


@register("standardize_by_group", sql=_E + """
SELECT event_id, event_type, user_id,
       round((value - s.mv) / s.sv, 6) + 0.0 AS value
FROM e JOIN (SELECT event_type AS k, avg(value) mv, stddev_samp(value) sv FROM e GROUP BY 1) s ON e.event_type = s.k""")
def standardize_by_group(spark, sf):
    return rounded(clean.standardize(events_with_nulls(spark, sf), ["value"], by=["event_type"]))


@register("preprocess", sql=_E + """,
f AS (SELECT event_id, user_id, event_type, coalesce(value, (SELECT avg(value) FROM e)) AS value FROM e)
SELECT event_id, event_type,
       round((user_id - s.mu) / s.su, 6) + 0.0 AS user_id,
       round((value - s.mv) / s.sv, 6) + 0.0 AS value
FROM f CROSS JOIN (SELECT avg(user_id) mu, stddev_samp(user_id) su, avg(value) mv, stddev_samp(value) sv FROM f) s""")
def preprocess(spark, sf):
    return rounded(clean.preprocess(events_with_nulls(spark, sf), missing="mean", scaling="standardize",
                                    cols=["user_id", "value"]))


@register("preprocess_drop_normalize", sql=_E + """,
f AS (SELECT * FROM e WHERE user_id IS NOT NULL AND value IS NOT NULL)
SELECT event_id, event_type,
       round((user_id - s.lu) / (s.hu - s.lu), 6) + 0.0 AS user_id,
       round((value - s.lv) / (s.hv - s.lv), 6) + 0.0 AS value
FROM f CROSS JOIN (SELECT min(user_id) lu, max(user_id) hu, min(value) lv, max(value) hv FROM f) s""")
def preprocess_drop_normalize(spark, sf):
    return rounded(clean.preprocess(events_with_nulls(spark, sf), missing="drop", scaling="normalize",
                                    cols=["user_id", "value"]))


@register("zscore_population", sql=_E + """
SELECT event_id, event_type, user_id,
       round(CASE WHEN value IS NULL THEN NULL ELSE coalesce((value - s.m) / nullif(s.sd, 0), 0.0) END, 6) + 0.0 AS value
FROM e CROSS JOIN (SELECT avg(value) m, stddev_pop(value) sd FROM e) s""")
def zscore_population(spark, sf):
    return rounded(clean.zscore_population(events_with_nulls(spark, sf), ["value"]))
