"""Every operator on the edge tables of SURVEY §5: no exception (ANSI
division, empty input...) and sane shapes."""

import datetime as dt

import pytest

from quarry.operators import (clean, correlate, explore, forecast, hypothesis, outliers, plotdata, rank,
                              regress, tree)

NAN = float("nan")
EDGE = {
    "empty": [],
    "one_row": [(1.0, 2.0)],
    "constant": [(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)],
    "all_null": [(None, 2.0), (None, 3.0), (None, 4.0)],
    "nan_and_null": [(1.0, 1.0), (NAN, 2.0), (None, 3.0), (3.0, 4.0)],
    "ties": [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 2.0), (3.0, 1.0)],
}


@pytest.fixture(params=sorted(EDGE))
def edge(request, spark):
    return request.param, spark.createDataFrame(EDGE[request.param], "x double, y double")


def _run(df):
    return df.collect()


def test_cleaning_and_explore(edge):
    name, df = edge
    for out in (clean.drop_missing(df), clean.fill_mean(df), clean.standardize(df), clean.normalize(df),
                clean.zscore_population(df), clean.preprocess(df, "mean", "standardize"),
                clean.missing_counts(df), explore.column_stats(df), explore.crosstab(df, "x", "y"),
                explore.profile_shape(df), explore.preview(df, 3), explore.sort_by(df, "x", False),
                explore.filter_any_text(df, "1")):
        _run(out)
    assert explore.profile_shape(df).first().n_rows == len(EDGE[name])


def test_statistics(edge):
    name, df = edge
    for out in (correlate.correlation(df, ["x", "y"]), correlate.correlation(df, ["x", "y"], "spearman"),
                rank.average_rank(df, "x"), explore.sort_position(df, "x"),
                hypothesis.ttest_ind(df, "x", "y"), hypothesis.chi_square(df, "x", "y"),
                hypothesis.expected_counts(df, "x", "y")):
        _run(out)


def test_models_and_charts(edge):
    name, df = edge
    fit = regress.ols(df, "x", "y")
    rows = _run(fit)
    assert len(rows) == 1 and rows[0].status in ("ok", "constant_x", "too_few_rows", "missing_values")
    for out in (regress.ols(df, "x", "y", outlier_threshold=3.0), regress.residuals(df, "x", "y", fit),
                regress.regression_line(df, "x", fit), regress.ols_multiple(df, ["x"], "y"),
                outliers.exclude_outliers(df, ["x", "y"]), outliers.outlier_count(df, ["x", "y"]),
                tree.full_tree_accuracy(df, ["x"], "y"), tree.accuracy(df, "x", "y"),
                plotdata.scatter_bins(df, ["x", "y"], 5), plotdata.analysis_report(df)):
        _run(out)


def test_forecast_edges(edge):
    name, df = edge
    t0 = dt.datetime(2024, 1, 1)
    timed = df.rdd.zipWithIndex().map(lambda r: (t0 + dt.timedelta(hours=r[1]), r[1], r[0][0])).toDF(
        "ts timestamp_ntz, id long, x double") if EDGE[name] else df.selectExpr(
        "CAST(NULL AS TIMESTAMP_NTZ) AS ts", "CAST(1 AS BIGINT) AS id", "x").limit(0)
    s = forecast.as_series(timed, "ts", "x", None, "id")
    _run(forecast.arima_forecast(s, None, 3))
    _run(forecast.series_with_forecast(s, None, 3))


def test_string_column_passes_through(spark):
    df = spark.createDataFrame([(1, "a", 1.0, True, dt.datetime(2024, 1, 1)),
                                (2, "b", 3.0, False, dt.datetime(2024, 1, 2))],
                               "id bigint, s string, x double, b boolean, t timestamp_ntz")
    out = clean.standardize(df).collect()
    assert [r.s for r in out] == ["a", "b"] and [r.t for r in out] == [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)]
    assert {r.b for r in out} == {-0.7071067811865475, 0.7071067811865475}
