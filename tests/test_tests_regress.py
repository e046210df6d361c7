import math

import numpy as np
import pytest

from quarry.functions import pvalues
from quarry.operators import hypothesis, outliers, regress


def test_chi_square_2x2_yates_and_plain(spark):
    cells = [("a", "x", 10), ("a", "y", 5), ("b", "x", 3), ("b", "y", 12)]
    df = spark.createDataFrame([(p, q) for p, q, n in cells for _ in range(n)], "p string, q string")
    r = hypothesis.chi_square(df, "p", "q").first()
    assert abs(r.stat - 4.887) < 1e-3 and r.dof == 1 and abs(r.p - 0.02706) < 1e-4
    plain = hypothesis.chi_square(df, "p", "q", correction=False).first()
    assert abs(plain.stat - 6.652) < 1e-3


def test_chi_square_absent_cells_match_dense_formula(spark):
    counts = np.array([[5, 0, 7], [0, 9, 2], [4, 4, 0]])
    df = spark.createDataFrame([(i, j) for i in range(3) for j in range(3) for _ in range(counts[i, j])],
                               "p int, q int")
    r = hypothesis.chi_square(df, "p", "q").first()
    e = counts.sum(1, keepdims=True) * counts.sum(0, keepdims=True) / counts.sum()
    assert abs(r.stat - ((counts - e) ** 2 / e).sum()) < 1e-9 and r.dof == 4
    assert r.dof == 4 and abs(r.p - np.exp(-r.stat / 2) * (1 + r.stat / 2)) < 1e-12


def test_chi_square_single_category_has_zero_dof(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y")], "p string, q string")
    r = hypothesis.chi_square(df, "p", "q").first()
    assert (r.stat, r.dof, r.p) == (0.0, 0, 1.0)


def test_expected_counts(spark):
    df = spark.createDataFrame([("a", "x")] * 3 + [("b", "y")], "p string, q string")
    got = {(r.p, r.q): (r.observed, r.expected) for r in hypothesis.expected_counts(df, "p", "q").collect()}
    assert got[("a", "y")] == (0, 0.75) and got[("b", "y")] == (1, 0.25)


def test_ttest_two_samples(spark):
    v1, v2 = [1, 2, 3, 4, 4], [2, 3.5, 5, 9, 8]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(v1, v2)], "v1 double, v2 double")
    r = hypothesis.ttest_ind(df, "v1", "v2").first()
    assert abs(abs(r.t) - 1.8676) < 1e-4 and r.dof == 8 and abs(r.p - 0.0988) < 1e-4
    missing = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (2.0, 5.0)], "v1 double, v2 double")
    r = hypothesis.ttest_ind(missing, "v1", "v2").first()
    assert r.t is None and r.status == "missing_values"


def _p(spark, kind, cases):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, float(x), float(n)) for i, (x, n) in enumerate(cases)], "i int, x double, n double")
    out = df.select("i", getattr(pvalues, f"{kind}_pvalue")(F.col("x"), F.col("n")).alias("p"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    return [r.p for r in out.orderBy("i").collect()]


def test_pvalue_functions(spark):
    # closed forms: chi-square with even dof and dof 1, t with dof 1, 2 and 3
    term = total = 1.0
    for k in range(1, 30):
        term *= 30.0 / k
        total += term
    chi = [((3.0, 2), np.exp(-1.5)), ((60.0, 60), np.exp(-30.0) * total), ((3.84, 1), math.erfc(math.sqrt(1.92))),
           ((1e-6, 1), math.erfc(math.sqrt(5e-7))), ((90.0, 1), math.erfc(math.sqrt(45))), ((0.0, 3), 1.0), ((5.0, 0), 1.0), ((float("inf"), 2), 0.0),
           ((9.0, 4), np.exp(-4.5) * 5.5), ((1.5, 3), math.erfc(math.sqrt(.75)) + math.sqrt(3 / math.pi) * np.exp(-.75))]
    for got, (case, want) in zip(_p(spark, "chi2", [c for c, _ in chi]), chi, strict=True):
        assert got == pytest.approx(want, rel=1e-10, abs=1e-300), case
    t = [((12.0, 1), 2 * math.atan2(1, 12) / math.pi), ((1.0, 2), 1 - 1 / math.sqrt(3)), ((0.0, 5), 1.0), ((-0.3, 1), 1 - 2 * math.atan(0.3) / math.pi),
         ((1.7, 3), 1 - 2 / math.pi * (math.atan(1.7 / math.sqrt(3)) + 1.7 * math.sqrt(3) / (3 + 1.7 ** 2))), ((1e300, 5), 0.0), ((float("inf"), 4), 0.0)]
    for got, (case, want) in zip(_p(spark, "t", [c for c, _ in t]), t, strict=True):
        assert got == pytest.approx(want, rel=1e-10, abs=1e-200), case
    assert abs(_p(spark, "t", [(1.8676, 8)])[0] - 0.0988) < 1e-4
    # large dof: the normal limit with its skewness term
    large = (1e6, 1e8, 1e12)
    assert all(abs(1 - p - 0.8413447460685429) < 1e-6 for p in _p(spark, "chi2", [(d + math.sqrt(2 * d), d) for d in large]))
    assert all(abs(p - 0.05) < 3e-7 for p in _p(spark, "t", [(1.959963984540054, d) for d in large]))
    assert _p(spark, "chi2", [(1e5, 3)]) == [0.0] and math.isnan(_p(spark, "t", [(1.0, 0)])[0])


def test_ols_line4(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.5), (3.0, 5.0), (4.0, 9.0)], "x double, y double")
    r = regress.ols(df, "x", "y").first()
    assert abs(r.slope - 2.25) < 1e-12 and abs(r.intercept + 0.75) < 1e-12 and abs(r.r2 - 0.9310) < 1e-4
    assert r.status == "ok" and r.slope_p is not None and r.n == 4


def test_ols_constant_x_and_missing(spark):
    const = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "x double, y double")
    r = regress.ols(const, "x", "y").first()
    assert r.slope is None and r.status == "constant_x"
    miss = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 4.0), (4.0, 4.5)], "x double, y double")
    assert regress.ols(miss, "x", "y").first().status == "missing_values"
    assert regress.ols(miss, "x", "y", missing="drop").first().n == 3


def test_require_numeric(spark):
    df = spark.createDataFrame([(1.0, "a")], "x double, s string")
    with pytest.raises(TypeError):
        regress.ols(df, "x", "s")


def test_outlier_halves_partition_the_input(spark):
    vals = [float(v) for v in range(30)] + [1000.0, None]
    df = spark.createDataFrame([(i, v, v) for i, v in enumerate(vals)], "id long, x double, y double")
    kept = {r.id for r in outliers.exclude_outliers(df, ["x", "y"], 3.0).collect()}
    out = {r.id for r in outliers.outlier_rows(df, ["x", "y"], 3.0).collect()}
    assert kept | out == set(range(len(vals))) and not kept & out
    assert out == {30, 31}   # the outlier and the row whose z is missing
    assert outliers.outlier_count(df, ["x", "y"], 3.0).first().n_excluded == 2


def test_residuals_sum_to_zero_and_line(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=200)
    y = 3 * x + 1 + rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    fit = regress.ols(df, "x", "y")
    res = regress.residuals(df, "x", "y", fit)
    assert abs(sum(r.residual for r in res.collect())) < 1e-8
    line = regress.regression_line(df, "x", fit, 100).collect()
    assert len(line) == 100 and line[0].x == float(x.min()) and line[-1].x == float(x.max())


def test_ols_multiple_matches_lstsq_and_mllib(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(300, 3)) * [1, 100, 0.01]
    y = X @ [2.0, -0.5, 30.0] + 4 + rng.normal(size=300)
    df = spark.createDataFrame([tuple(map(float, list(r) + [t])) for r, t in zip(X, y)],
                               "a double, b double, c double, y double")
    m = {r.variable: r.coefficient for r in regress.ols_multiple(df, ["a", "b", "c"], "y").collect()}
    A = np.column_stack([np.ones(300), X])
    beta = np.linalg.lstsq(A, y, rcond=None)[0]
    assert abs(m["__intercept__"] - beta[0]) < 1e-8
    assert all(abs(m[k] - b) < 1e-8 for k, b in zip("abc", beta[1:]))
    ml = regress.ols_multiple_mllib(df, ["a", "b", "c"], "y")
    assert all(abs(m[k] - b) < 1e-6 for k, b in zip("abc", ml.coefficients))
    pred = regress.ols_predict(df, ["a", "b", "c"], regress.ols_multiple(df, ["a", "b", "c"], "y"))
    r2 = regress.r2_score(pred, "y", "y_hat").first().r2
    r2_model = regress.ols_multiple(df, ["a", "b", "c"], "y").first().r2
    assert abs(r2 - r2_model) < 1e-10


def test_ols_multiple_missing_and_singular(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 4.0, None), (3.0, 6.0, 7.0)], "a double, b double, y double")
    assert {r.status for r in regress.ols_multiple(df, ["a", "b"], "y").collect()} == {"missing_values"}
    sing = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 4.0, 5.0), (3.0, 6.0, 7.5), (4.0, 8.0, 9.0)],
                                 "a double, b double, y double")
    assert {r.status for r in regress.ols_multiple(sing, ["a", "b"], "y").collect()} == {"collinear"}


def test_ols_multiple_many_predictors(spark):
    rng = np.random.default_rng(9)
    k = 40
    X = rng.normal(size=(400, k))
    beta = rng.normal(size=k)
    y = X @ beta + 2.0 + 0.1 * rng.normal(size=400)
    cols = [f"x{i}" for i in range(k)]
    df = spark.createDataFrame([tuple(map(float, list(r) + [t])) for r, t in zip(X, y)],
                               ", ".join(f"{c} double" for c in cols) + ", y double")
    m = {r.variable: r.coefficient for r in regress.ols_multiple(df, cols, "y").collect()}
    want = np.linalg.lstsq(np.column_stack([np.ones(400), X]), y, rcond=None)[0]
    assert abs(m["__intercept__"] - want[0]) < 1e-6
    assert all(abs(m[c] - w) < 1e-6 for c, w in zip(cols, want[1:]))


def test_scales_and_collinear_predictors(spark):
    rng = np.random.default_rng(4)
    a, b, e = rng.normal(size=(3, 300))
    a, b = a * 1e9, b * 1e-3
    y = 3e-9 * a + 2e3 * b + 0.1 * e + 5
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, 2 * b, y)], "a double, b double, c double, y double")
    fit = {r.variable: r for r in regress.ols_multiple(df, ["a", "b"], "y").collect()}
    x = np.column_stack([np.ones(300), a / 1e9, b * 1e3])
    want = np.linalg.lstsq(x, y, rcond=None)[0]
    assert fit["a"].status == "ok" and abs(fit["a"].coefficient * 1e9 - want[1]) < 1e-8
    assert abs(fit["b"].coefficient / 1e3 - want[2]) < 1e-8 and abs(fit["__intercept__"].coefficient - want[0]) < 1e-8
    both = {r.variable: r for r in regress.ols_multiple(df, ["b", "c"], "y").collect()}
    one = {r.variable: r for r in regress.ols_multiple(df, ["b"], "y").collect()}
    assert both["b"].status == "collinear" and abs(both["b"].r2 - one["b"].r2) < 1e-9
    assert abs(both["c"].coefficient - 2 * both["b"].coefficient) < 1e-6        # least norm along (1, 2)
    assert abs(both["b"].coefficient * 5 - one["b"].coefficient) < 1e-6


def test_nearly_collinear_predictors(spark):
    """Two predictors that differ by one part in 10^7: the normal equations
    would lose them (their condition number is 10^14), QR does not."""
    from fractions import Fraction

    rng = np.random.default_rng(12)
    a = rng.integers(-1000, 1000, 400).astype(float)
    b = a + rng.integers(-50, 50, 400) * 2.0 ** -20
    y = 3 * a - 2 * b + 7
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, y)], "a double, b double, y double").repartition(7)
    fit = {r.variable: r for r in regress.ols_multiple(df, ["a", "b"], "y").collect()}
    assert fit["a"].status == "ok"
    assert abs(fit["a"].coefficient - 3) < 1e-6 and abs(fit["b"].coefficient + 2) < 1e-6 and abs(fit["__intercept__"].coefficient - 7) < 1e-6
    assert all(Fraction(v) == Fraction(3) * Fraction(p) - 2 * Fraction(q) + 7 for p, q, v in zip(a, b, y))


def test_factors_of_parts_are_the_factor_of_the_whole():
    from quarry.operators import _tsqr

    x = np.random.default_rng(2).normal(size=(100, 5))
    parts = np.vstack([_tsqr.factor(p) for p in np.split(x, [2, 3, 40, 77])])
    assert np.allclose(np.abs(_tsqr.factor(parts)), np.abs(_tsqr.factor(x)))


def test_ols_multiple_by_group_with_missing_and_empty(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(a), float(b), float(1.0 + a * (i + 1) - b)) for i, g in enumerate(["u", "v", None]) for a, b in rng.normal(size=(40, 2))]
    rows += [("gap", 1.0, 2.0, None), ("gap", 2.0, 1.0, 3.0), ("one", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double, y double").repartition(5)
    fit = {(r.g, r.variable): r for r in regress.ols_multiple(df, ["a", "b"], "y", by=["g"]).collect()}
    for i, g in enumerate(["u", "v", None]):
        assert abs(fit[g, "a"].coefficient - (i + 1)) < 1e-9 and abs(fit[g, "b"].coefficient + 1) < 1e-9 and abs(fit[g, "a"].r2 - 1) < 1e-12
    assert fit["gap", "a"].status == "missing_values" and fit["one", "a"].status == "too_few_rows" and fit["gap", "a"].n == 2
    assert {r.status for r in regress.ols_multiple(df.limit(0), ["a", "b"], "y").collect()} == {"too_few_rows"}
    assert regress.ols_multiple(df.limit(0), ["a", "b"], "y", by=["g"]).collect() == []


def test_many_columns(spark):
    import pandas as pd

    from quarry.operators import correlate

    x = np.random.default_rng(8).normal(size=(400, 100))
    x[::7, 3] = np.nan
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(100)])
    got = {(r.var_a, r.var_b): r.r for r in correlate.correlation(spark.createDataFrame(pdf), list(pdf.columns)).collect()}
    want = pdf.corr()
    assert max(abs(got[a, b] - want.loc[a, b]) for a in pdf.columns for b in pdf.columns) < 1e-9
    fit = regress.ols_multiple(spark.createDataFrame(pdf.drop(columns="c3")), [f"c{i}" for i in range(1, 100) if i != 3], "c0").collect()
    assert len(fit) == 99 and {r.status for r in fit} == {"ok"}
