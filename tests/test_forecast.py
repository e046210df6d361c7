import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import forecast as fc
from quarry.operators import likelihood


def _arima_series(phi, theta, n, seed):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n + 1)
    d = np.zeros(n + 1)
    for t in range(1, n + 1):
        d[t] = phi * d[t - 1] + e[t] + theta * e[t - 1]
    return np.cumsum(d[1:]) + 100.0


def _frame(spark, series: dict, gap_seconds=60):
    t0 = dt.datetime(2024, 1, 1)
    data = [(k, t0 + dt.timedelta(seconds=gap_seconds * i), i, float(v))
            for k, ys in series.items() for i, v in enumerate(ys)]
    return spark.createDataFrame(data, "key long, ts timestamp_ntz, id long, y double")


def test_positions_and_lags_with_small_blocks(spark):
    rng = np.random.default_rng(0)
    ys = rng.normal(size=57)
    df = _frame(spark, {1: ys, 2: ys[:9]}).sample(fraction=1.0, seed=1)  # input order scrambled
    s = fc.as_series(df, "ts", "y", key="key", tiebreak="id")
    lag = fc.with_lags(s, "key", 8, block_rows=10).where("key = 1").orderBy("t").collect()
    assert [r.t for r in lag] == list(range(1, 58)) and all(r.n == 57 for r in lag)
    for r in lag:
        for j in range(1, 9):
            want = ys[r.t - 1 - j] if r.t - 1 - j >= 0 else None
            got = getattr(r, f"y{j}")
            assert (got is None and want is None) or abs(got - want) < 1e-12


def test_fit_recovers_known_parameters(spark):
    df = _frame(spark, {1: _arima_series(0.6, 0.3, 4000, 11), 2: _arima_series(-0.4, 0.2, 4000, 12)})
    fit = {r.key: r for r in fc.arima_fit(fc.as_series(df, "ts", "y", "key", "id"), "key").collect()}
    assert abs(fit[1].phi - 0.6) < 0.06 and abs(fit[1].theta - 0.3) < 0.06 and fit[1].status == "ok"
    assert abs(fit[2].phi + 0.4) < 0.1 and abs(fit[2].theta - 0.2) < 0.1
    assert abs(fit[1].sigma2 - 1.0) < 0.1


def test_block_size_does_not_change_the_fit(spark):
    df = _frame(spark, {1: _arima_series(0.5, 0.4, 300, 3)})
    s = fc.as_series(df, "ts", "y", "key", "id")
    a = fc.arima_forecast(s, "key", 10).orderBy("step").collect()
    b = fc.arima_forecast(s, "key", 10, block_rows=17).orderBy("step").collect()
    assert all(abs(x.yhat - y.yhat) < 1e-9 for x, y in zip(a, b))


def test_forecast_matches_direct_recursion(spark):
    ys = _arima_series(0.5, 0.4, 300, 5)
    df = _frame(spark, {7: ys})
    s = fc.as_series(df, "ts", "y", "key", "id")
    fit = fc.arima_fit(s, "key").first()
    phi, theta = fit.phi, fit.theta
    d = np.diff(ys)
    e = 0.0
    for t in range(len(d)):
        e = d[t] - phi * (d[t - 1] if t else 0.0) - theta * e
    dn, yn, want = d[-1], ys[-1], []
    dprev, eprev = dn, e
    for h in range(10):
        dnext = phi * dprev + theta * eprev
        yn = yn + dnext
        want.append(yn)
        dprev, eprev = dnext, 0.0
    got = fc.arima_forecast(s, "key", 10).orderBy("step").collect()
    assert all(abs(g.yhat - w) < 1e-8 for g, w in zip(got, want))
    # regular gaps give forecast times
    assert got[0].ts == dt.datetime(2024, 1, 1) + dt.timedelta(seconds=60 * 300)


def test_short_or_constant_series(spark):
    df = _frame(spark, {1: [5.0] * 30, 2: [1.0, 2.0, 3.0]})
    fit = {r.key: r for r in fc.arima_fit(fc.as_series(df, "ts", "y", "key", "id"), "key").collect()}
    assert fit[1].status == "too_short_or_constant" and fit[1].phi == 0.0
    assert fit[2].status == "too_short_or_constant"
    fcst = fc.arima_forecast(fc.as_series(df, "ts", "y", "key", "id"), "key", 3).where("key = 2").collect()
    assert all(r.yhat == 3.0 for r in fcst)


def test_history_and_forecast_union(spark):
    df = _frame(spark, {1: _arima_series(0.3, 0.1, 50, 9)})
    out = fc.series_with_forecast(fc.as_series(df, "ts", "y", "key", "id"), "key", 10)
    kinds = {r.kind: 0 for r in out.collect()}
    assert set(kinds) == {"history", "forecast"} and out.count() == 60
    assert max(r.t for r in out.collect()) == 60


def test_parse_time_strict_and_lenient(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("bad",)], "s string")
    ok = fc.parse_time(df, "s", strict=False).collect()
    assert ok[0].s == dt.datetime(2024, 1, 2, 3, 4, 5) and ok[1].s is None
    with pytest.raises(Exception):
        fc.parse_time(df, "s").collect()


def _filter(d, phi, theta):
    """The Kalman filter a step at a time: log-likelihood and last shock."""
    r = (1 + 2 * phi * theta + theta * theta) / (1 - phi * phi)
    v = d[0]
    s, g = v * v / r, np.log(r)
    for t in range(1, len(d)):
        v = d[t] - phi * d[t - 1] - theta * v / r
        r = 1 + theta * theta - theta * theta / r
        s, g = s + v * v / r, g + np.log(r)
    m = len(d)
    return -0.5 * (m * (np.log(2 * np.pi * s / m) + 1) + g), v / r


@pytest.mark.parametrize("points", [3, 16, 4096])
def test_likelihood_equals_a_sequential_filter(spark, points):
    series = {1: _arima_series(0.5, 0.8, 300, 21), 2: _arima_series(-0.6, 0.3, 41, 22), 3: np.array([1.0, 4.0, 2.0])}
    s = fc.as_series(_frame(spark, series), "ts", "y", "key", "id")
    at = [(0.3, 0.2), (-0.9, 0.95), (0.0, 0.0), (0.7, -0.7), (0.99, -0.999)]
    got = likelihood.exact_log_likelihood(s, at, "key", points=points).collect()
    assert len(got) == 15
    for r in got:
        assert r.loglik == pytest.approx(_filter(np.diff(series[r.key]), r.phi, r.theta)[0], rel=1e-9, abs=1e-8)


def test_elements_compose_in_a_tree(spark):
    """More blocks than are combined at once."""
    ys = _arima_series(0.4, 0.5, 900, 7)
    s = fc.as_series(_frame(spark, {1: ys}), "ts", "y", "key", "id")
    blocks = likelihood.packed_blocks(s, ["key"], 5)
    at = blocks.select("key").distinct().withColumn("at", F.expr("array(struct(0.4d AS phi, 0.5d AS theta))"))
    parts = likelihood.elements(blocks, at, ["key"])
    few, many = (likelihood.combined(parts, ["key"], 179, fan).first()["e"][0] for fan in (4, 1024))
    assert list(few) == pytest.approx(list(many), rel=1e-9)


def test_refine_finds_the_maximum_whatever_the_blocks(spark):
    series = {1: _arima_series(0.5, 0.8, 1500, 21), 2: _arima_series(0.6, 0.3, 120, 22), 3: _arima_series(0.2, -0.5, 12, 5),
              4: np.array([3.0, 5.0, 4.0, 9.0]), 5: np.array([5.0] * 30), 6: np.array([1.0, 2.0]), 7: np.array([8.0])}
    s = fc.as_series(_frame(spark, series), "ts", "y", "key", "id", materialize=True)
    a = {r.key: r for r in fc.arima_refine(s, "key").collect()}
    b = {r.key: r for r in fc.arima_refine(s, "key", block_points=97).collect()}
    grid = [(p, q) for p in np.linspace(-.97, .97, 25) for q in np.linspace(-.97, .97, 25)]
    for k in (1, 2, 3, 4):
        d = np.diff(series[k])
        assert a[k].status == "ok" and a[k].converged and b[k].converged and a[k].rounds > 1
        assert a[k].loglik >= a[k].loglik_start
        loglik, shock = _filter(d, a[k].phi, a[k].theta)
        assert a[k].loglik == pytest.approx(loglik, abs=1e-7) and a[k].e_last == pytest.approx(shock, abs=1e-7)
        assert max(_filter(d, p, q)[0] for p, q in grid[:: 1 if k > 1 else 16]) <= a[k].loglik + 1e-7
        assert a[k].loglik == pytest.approx(b[k].loglik, abs=1e-6)
    assert abs(a[1].phi - b[1].phi) < 1e-4 and abs(a[1].theta - 0.8) < 0.08 and abs(a[1].phi - 0.5) < 0.08
    assert all(a[k].status == "too_short_or_constant" and a[k].phi == 0.0 for k in (5, 6, 7)) and set(a) == set(series)


def test_forecast_from_the_refined_fit(spark):
    ys = _arima_series(0.5, 0.4, 80, 5)
    s = fc.as_series(_frame(spark, {7: ys, 8: ys[:3], 9: [4.0] * 5}), "ts", "y", "key", "id", materialize=True)
    fit = fc.arima_refine(s, "key")
    r = fit.where("key = 7").first()
    step, want, last = r.phi * (ys[-1] - ys[-2]) + r.theta * _filter(np.diff(ys), r.phi, r.theta)[1], [], ys[-1]
    for _ in range(5):
        last += step
        want.append(last)
        step *= r.phi
    got = fc.arima_forecast(s, "key", 5, fit=fit).orderBy("key", "step").collect()
    assert [x.yhat for x in got if x.key == 7] == pytest.approx(want)
    assert [x.yhat for x in got if x.key == 9] == [4.0] * 5 and len(got) == 15
    alone = fc.as_series(_frame(spark, {7: ys}).drop("key"), "ts", "y", None, "id")
    got = fc.arima_forecast(alone, None, 5, fit=fc.arima_refine(alone)).orderBy("step").collect()
    assert [x.yhat for x in got] == pytest.approx(want)
    assert fc.series_with_forecast(s, "key", 5, fit=fit).count() == 88 + 15


def test_refine_with_missing_values_and_empty_table(spark):
    df = _frame(spark, {1: [1.0, float("nan"), 3.0, 2.0, 5.0]})
    assert fc.arima_refine(fc.as_series(df, "ts", "y", "key", "id"), "key").first().status == "missing_values"
    assert fc.arima_refine(fc.as_series(df.limit(0), "ts", "y", "key", "id"), "key").collect() == []


def test_single_series_without_key(spark):
    df = _frame(spark, {1: _arima_series(0.5, 0.2, 200, 8)})
    keyed = fc.arima_forecast(fc.as_series(df, "ts", "y", "key", "id"), "key", 5).orderBy("step").collect()
    alone = fc.arima_forecast(fc.as_series(df.drop("key"), "ts", "y", None, "id"), None, 5).orderBy("step").collect()
    assert [round(r.yhat, 9) for r in keyed] == [round(r.yhat, 9) for r in alone]


def test_difference_orders(spark):
    ys = [1.0, 4.0, 9.0, 16.0, 25.0, 36.0]
    df = _frame(spark, {1: ys})
    s = fc.as_series(df, "ts", "y", "key", "id")
    d1 = [r.dy for r in fc.difference(s, "key").orderBy("t").collect()]
    d2 = [r.dy for r in fc.difference(s, "key", d=2).orderBy("t").collect()]
    assert d1 == [None, 3.0, 5.0, 7.0, 9.0, 11.0] and d2 == [None, None, 2.0, 2.0, 2.0, 2.0]
