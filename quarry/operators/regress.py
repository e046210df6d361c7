"""Linear regression: P7 (via require_numeric), R1-R7.

Single predictor (R1): one aggregation of Spark's ``regr_*`` functions gives
slope, intercept, R² and the sums of squares; the slope's standard error and
t statistic are arithmetic on that one row (per group with ``by``), and its
p-value is computed on the result row only.

Several predictors (R5): tall-skinny QR (``_tsqr``).  Every task reduces its
rows to a triangular factor, the factors are merged in a tree, and the fit is
solved from the last one, so one scan is all that is read and the condition
number of the data is not squared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import as_double, require_numeric, safe_div
from quarry.functions.pvalues import t_pvalue
from quarry.operators._stats import attach, grouped_agg
from quarry.operators._tsqr import factors, solve
from quarry.operators.outliers import KEEP, with_outlier_mask
from quarry.session import ship_package

SINGLE_COLUMNS = ["n", "r2", "intercept", "slope", "slope_se", "slope_t"]


def ols(df: DataFrame, x: str, y: str, by: list[str] | None = None,
        outlier_threshold: float | None = None, missing: str = "error",
        with_pvalue: bool = True) -> DataFrame:
    """y = intercept + slope·x.

    Returns ``(by..., n, n_excluded, r2, intercept, slope, slope_se, slope_t,
    slope_p, status)``.  ``status`` is ``ok``, ``constant_x``,
    ``too_few_rows`` or ``missing_values`` (a missing x or y with exclusion
    off and ``missing='error'``: estimates are then null, like the
    reference's NaN result).  With ``outlier_threshold`` the fit runs on the
    rows kept by P4 and ``n_excluded`` is P6.
    """
    require_numeric(df, [x, y])
    by = by or []
    fx, fy = as_double(df, x), as_double(df, y)
    if outlier_threshold is not None:
        data = with_outlier_mask(df, [x, y], outlier_threshold, by)
        keep = F.col(KEEP)
    else:
        data, keep = df, F.lit(True)
    xk, yk = F.when(keep, fx), F.when(keep, fy)
    aggs = [
        F.regr_count(yk, xk).cast("bigint").alias("n"),
        F.count_if(~keep).cast("bigint").alias("n_excluded"),
        F.count_if(keep & (fx.isNull() | fy.isNull())).cast("bigint").alias("__n_missing"),
        F.regr_slope(yk, xk).alias("__b"), F.regr_intercept(yk, xk).alias("__a"),
        F.regr_r2(yk, xk).alias("__r2"), F.regr_sxx(yk, xk).alias("__sxx"),
        F.regr_syy(yk, xk).alias("__syy"), F.regr_sxy(yk, xk).alias("__sxy"),
    ]
    fit = grouped_agg(data, by, aggs)
    n, b = F.col("n"), F.col("__b")
    resid_ss = F.greatest(F.col("__syy") - b * F.col("__sxy"), F.lit(0.0))
    se = F.sqrt(safe_div(safe_div(resid_ss, (n - 2).cast("double")), F.col("__sxx")))
    se = F.when(n > 2, se)
    blocked = (F.col("__n_missing") > 0) & F.lit(missing == "error" and outlier_threshold is None)
    status = (F.when(blocked, "missing_values").when(n < 3, "too_few_rows")
              .when(b.isNull() | (F.col("__sxx") == 0), "constant_x").otherwise("ok"))
    out = fit.select(
        *by, "n", "n_excluded",
        F.when(~blocked, F.col("__r2")).alias("r2"),
        F.when(~blocked, F.col("__a")).alias("intercept"),
        F.when(~blocked, b).alias("slope"),
        F.when(~blocked, se).alias("slope_se"),
        F.when(~blocked, safe_div(b, se)).alias("slope_t"),
        status.alias("status"))
    if with_pvalue:
        ship_package(df.sparkSession)
        out = out.withColumn("slope_p", t_pvalue(F.col("slope_t"), (F.col("n") - 2)))
    return out


def _one_row(model: DataFrame, cols: list[str]) -> list:
    """The values of a one-row fitted model (a proven bound: one row).  A
    fitted model is applied like an MLlib transformer: its few numbers are
    read once and become literals, so the data plan does not carry the fit."""
    rows = model.select(*cols).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"expected a one-row model, got {len(rows)} rows")
    return list(rows[0])


def regression_line(df: DataFrame, x: str, model: DataFrame, n_points: int = 100,
                    by: list[str] | None = None) -> DataFrame:
    """``n_points`` evenly spaced x from min to max of the *full* data
    (not only the fitted rows), with the fitted y: ``(by..., i, x, y_hat)``."""
    by = by or []
    span = grouped_agg(df, by, [F.min(as_double(df, x)).alias("__lo"), F.max(as_double(df, x)).alias("__hi")])
    coef = model.select(*by, "intercept", "slope")
    if by:
        both = span.join(coef, by, "inner")
    else:
        a, b = _one_row(coef, ["intercept", "slope"])
        both = span.select("*", F.lit(a).cast("double").alias("intercept"), F.lit(b).cast("double").alias("slope"))
    i = F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))).alias("i")
    pts = both.select(*by, "__lo", "__hi", "intercept", "slope", i)
    step = safe_div(F.col("__hi") - F.col("__lo"), F.lit(float(max(n_points - 1, 1))))
    xv = F.when(F.col("i") == n_points - 1, F.col("__hi")).otherwise(F.col("__lo") + F.col("i") * step)
    return pts.select(*by, F.col("i").cast("int").alias("i"), xv.alias("x"),
                      (F.col("intercept") + F.col("slope") * xv).alias("y_hat"))


def residuals(df: DataFrame, x: str, y: str, model: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``df`` plus ``y_hat`` and ``residual`` for each row, from a fitted
    single-predictor model (one row, or one per group)."""
    by = by or []
    coef = model.select(*by, "intercept", "slope")
    if by:
        frame, stat = attach(df, coef, by)
    else:
        vals = dict(zip(["intercept", "slope"], _one_row(coef, ["intercept", "slope"])))
        frame, stat = df, (lambda name: F.lit(vals[name]).cast("double"))
    yhat = stat("intercept") + stat("slope") * as_double(df, x)
    return frame.select(*df.columns, yhat.alias("y_hat"), (as_double(df, y) - yhat).alias("residual"))


# ---------------------------------------------------------------- several x

def ols_multiple(df: DataFrame, xs: list[str], y: str, by: list[str] | None = None) -> DataFrame:
    """Fit y on k ≥ 1 predictors with an intercept.

    Returns long rows ``(by..., variable, coefficient, r2, n, status)``; the
    intercept is the row whose variable is ``__intercept__``.  A missing value
    in any selected column gives ``status='missing_values'`` and null
    estimates (the reference refuses to fit).  ``collinear``: the predictors
    depend on each other and the least-norm coefficients are given.

    One scan: triangular factors of all tasks, merged in a tree (``_tsqr``),
    which keep what nearly dependent predictors still say; the groups are solved
    in batches, one row per group.
    """
    if not xs:
        raise ValueError("select at least one predictor")
    require_numeric(df, xs + [y])
    by = by or []
    k = len(xs)
    groups = factors(df, [as_double(df, c) for c in [*xs, y]], by)
    if not by:                                        # a table without rows has a result too
        groups = groups.agg(F.sum("__n").alias("__n"), F.sum("__missing").alias("__missing"), F.first("__r").alias("__r"))
    names = ["__intercept__", *xs]

    def run(batches):
        for b in batches:
            out = {c: [] for c in ("which", "variable", "coefficient", "r2", "n", "status")}
            for g, (n, missing, raw) in enumerate(zip(*[b.column(c).to_pylist() for c in ("__n", "__missing", "__r")], strict=True)):
                fit = (None, [None] * k, None, "missing_values" if missing else "too_few_rows")
                if not missing and (n or 0) >= 2:
                    fit = solve(np.frombuffer(raw).reshape(k + 2, k + 2), n)
                r2 = None if fit[2] is None or np.isnan(fit[2]) else fit[2]
                for name, value in zip(names, [fit[0], *fit[1]], strict=True):
                    for col, v in zip(out, (g, name, value, r2, n or 0, fit[3]), strict=True):
                        out[col].append(v)
            which = pa.array(out["which"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c).take(which) for c in by], pa.array(out["variable"], pa.string()),
                 pa.array([None if v is None else float(v) for v in out["coefficient"]], pa.float64()),
                 pa.array(out["r2"], pa.float64()), pa.array(out["n"], pa.int64()), pa.array(out["status"], pa.string())],
                names=[*by, "variable", "coefficient", "r2", "n", "status"])

    keys = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    return groups.mapInArrow(run, keys + "variable string, coefficient double, r2 double, n bigint, status string")


def coefficients_wide(model: DataFrame, xs: list[str], by: list[str] | None = None) -> DataFrame:
    """The long R5 model as one row per group: ``(by..., intercept, b_0.., r2)``."""
    by = by or []
    aggs = [F.max(F.when(F.col("variable") == "__intercept__", F.col("coefficient"))).alias("intercept")]
    aggs += [F.max(F.when(F.col("variable") == c, F.col("coefficient"))).alias(f"b_{j}") for j, c in enumerate(xs)]
    aggs += [F.max("r2").alias("r2")]
    return grouped_agg(model, by, aggs)


def ols_predict(df: DataFrame, xs: list[str], model: DataFrame, by: list[str] | None = None,
                out: str = "y_hat") -> DataFrame:
    """Fitted values over the table from an R5 model."""
    by = by or []
    wide = coefficients_wide(model, xs, by)
    if by:
        frame, stat = attach(df, wide, by)
    else:
        names = ["intercept"] + [f"b_{j}" for j in range(len(xs))]
        vals = dict(zip(names, _one_row(wide, names)))
        frame, stat = df, (lambda name: F.lit(vals[name]).cast("double"))
    yhat = stat("intercept")
    for j, c in enumerate(xs):
        yhat = yhat + stat(f"b_{j}") * as_double(df, c)
    return frame.select(*df.columns, yhat.alias(out))


def r2_score(df: DataFrame, y: str, y_hat: str, by: list[str] | None = None) -> DataFrame:
    """1 − SSE / SST, ``(by..., r2)``; null when y is constant."""
    yy, yh = as_double(df, y), as_double(df, y_hat)
    sse = F.sum(F.pow(yy - yh, 2))
    sst = F.var_pop(yy) * F.count(yy)
    return grouped_agg(df, by, [(F.lit(1.0) - safe_div(sse, sst)).alias("r2")])


def ols_multiple_mllib(df: DataFrame, xs: list[str], y: str):
    """Cross-check of R5 with MLlib's normal-equation solver (eager fit).
    Returns the fitted ``LinearRegressionModel``."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    data = df.select(*[as_double(df, c).alias(c) for c in xs + [y]]).dropna()
    vec = VectorAssembler(inputCols=xs, outputCol="__features").transform(data)
    lr = LinearRegression(featuresCol="__features", labelCol=y, solver="normal", regParam=0.0)
    return lr.fit(vec)
