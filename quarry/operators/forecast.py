"""Time series: P9 (parse time), F1 (series order), F2 (difference),
F3 (ARIMA(1,1,1) fit), F4 (forecast), F6 (history + forecast).

Many series are fitted at once, one per key, and nothing needs a whole
series in one task:

* Positions.  Each row's place in its series, ordered by (time, tiebreak),
  comes from the distributed rank of A8 (bucketed by quantiles of time,
  with the series length attached), not from a window over the series.
* Lags.  Positions are cut into blocks of ``block_rows``; the last
  ``LAGS`` rows of each block are copied into the next one, so ``lag``
  over (key, block) windows sees every predecessor while no window holds
  more than ``block_rows + LAGS`` rows, however long a series is.
* Fit.  Hannan–Rissanen: an AR(6) fitted by Levinson–Durbin on the
  differenced series gives residuals ê; then d_t is regressed on
  (d_{t−1}, ê_{t−1}) for φ, θ (no constant).  ê is linear in the lags of d,
  so every quantity the two stages need is a quadratic form of the lag
  cross-products Σ d_{t−i}·d_{t−k}: one grouped aggregation per key, then
  arithmetic on one row per key.  The same arithmetic, written once as SQL
  text, runs in Spark and in the DuckDB oracle.
* Last shock.  e_n = Σ_t (−θ)^(n−t)·(d_t − φ·d_{t−1}); with |θ| ≤ 0.99 the
  terms older than ``TAIL`` points are below double precision, so only
  each series' last ``TAIL`` rows (a bounded number per key) are joined to
  the fitted parameters.

These estimates are least-squares ones.  F5 (``likelihood``) maximises the
exact likelihood from them, for series of any length, and F4 and F6 forecast
from either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.columns import as_double, require_columns
from quarry.operators._lookup import lookup_join
from quarry.operators.rank import _default_buckets, value_counts, value_ranks

# Forms of date and time besides ISO that are tried in turn.
TIME_FORMATS = ["M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "yyyy/M/d", "yyyy/M/d H:mm:ss", "d-MMM-yyyy",
                "d MMM yyyy", "MMM d, yyyy", "yyyyMMdd"]
# Fixed method constants.
AR_ORDER = 6            # order of the long autoregression (first stage)
LAGS = AR_ORDER + 2     # y lags needed for d_t .. d_{t-7}
CLIP = 0.99             # |phi|, |theta| bound
MIN_POINTS = LAGS + 3   # F3 regresses rows with all their lags on two others; F5 fits shorter series too
TAIL = 4000             # 0.99 ** 4000 < 1e-17
BLOCK_ROWS = 100_000


def _keys(key) -> list[str]:
    if key is None:
        return []
    return [key] if isinstance(key, str) else list(key)


def parse_time(df: DataFrame, col: str, fmt: str | None = None, strict: bool = True,
               out: str | None = None) -> DataFrame:
    """The column as ``timestamp_ntz``.  Strict parsing raises on a bad
    value (ANSI); ``strict=False`` turns it into null.  Without ``fmt`` a text
    may be in ISO form or one of ``TIME_FORMATS``, the month first."""
    require_columns(df, [col])
    dt = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dt, T.TimestampNTZType):
        parsed = c
    elif isinstance(dt, (T.TimestampType, T.DateType)):
        parsed = c.cast("timestamp_ntz")
    else:
        s = c.cast("string")
        if fmt:
            parsed = F.try_to_timestamp(s, F.lit(fmt)).cast("timestamp_ntz")
        else:
            parsed = F.coalesce(s.try_cast("timestamp_ntz"), *[
                F.try_to_timestamp(F.trim(s), F.lit(f)).cast("timestamp_ntz") for f in TIME_FORMATS])
        if strict:
            bad = F.raise_error(F.concat(F.lit(f"{col}: not a time: "), s)).cast("timestamp_ntz")
            parsed = F.when(s.isNotNull() & parsed.isNull(), bad).otherwise(parsed)
    return df.withColumn(out or col, parsed)


def as_series(df: DataFrame, time: str, value: str, key=None, tiebreak: str | None = None,
              buckets: int | None = None, materialize: bool = False) -> DataFrame:
    """``(keys..., t, n, ts, y)``: position ``t`` (1..n) of each row in its
    series ordered by (time, tiebreak), series length ``n``.  Rows with a
    missing time are left out; equal rows take consecutive positions.  Without ``tiebreak``, rows with equal key and
    time are ordered by value.  ``materialize`` writes the result to the
    shared checkpoint folder (worth it when several operators read it)."""
    keys = _keys(key)
    require_columns(df, keys + [time, value] + ([tiebreak] if tiebreak else []))
    timed = parse_time(df, time)
    base = timed.select(*keys, F.col(time).alias("ts"), as_double(timed, value).alias("y"),
                        (F.col(tiebreak) if tiebreak else F.lit(None).cast("long")).alias("__tb"))
    then = [F.col("__tb"), F.col("y")]
    counts = value_counts(base, F.col("ts"), keys, then)
    ranks = value_ranks(counts, keys, buckets or _default_buckets(df))
    # a series row is fully described by its distinct values, so copies are
    # counted out of the rank table instead of joining it back to the rows
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__cnt").cast("long")))
    out = ranks.select("*", copy.alias("__copy")).select(
        *keys, (F.col("__before") + F.col("__copy")).cast("long").alias("t"), F.col("__total").cast("long").alias("n"),
        F.col("__v").alias("ts"), F.col("__o1").alias("y"))
    if materialize:
        # fit, forecast and history all read the series: write it once to
        # the shared checkpoint folder instead of recomputing the positions
        from quarry.session import cut_lineage

        out = cut_lineage(out)
    return out


def with_lags(series: DataFrame, key=None, lags: int = LAGS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Series rows plus ``y1..y{lags}`` (values 1..lags positions earlier) and
    ``ts1`` (previous time), computed in bounded blocks (see module doc)."""
    keys = _keys(key)
    blk = F.floor((F.col("t") - 1) / F.lit(block_rows)).cast("long")
    carry = ((F.col("t") - 1) % block_rows) >= block_rows - lags
    offset = F.explode(F.when(carry, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    spread = series.select("*", offset.alias("__off")).withColumn("__blk", blk + F.col("__off"))
    w = Window.partitionBy(*keys, "__blk").orderBy("t")
    lagged = spread.select(*series.columns, "__off",
                           *[F.lag("y", j).over(w).alias(f"y{j}") for j in range(1, lags + 1)],
                           F.lag("ts", 1).over(w).alias("ts1"))
    return lagged.where(F.col("__off") == 0).drop("__off")


def difference(series: DataFrame, key=None, d: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """difference of order ``d`` (the middle term of ARIMA's order),
    ``dy = Σ_k (−1)^k C(d, k) y_{t−k}``; null for the first ``d`` points."""
    from math import comb

    if d < 1:
        raise ValueError("d must be at least 1")
    lagged = with_lags(series, key, d, block_rows)
    terms = [F.col("y")] + [F.col(f"y{k}") for k in range(1, d + 1)]
    dy = sum(((-1) ** k * comb(d, k)) * t for k, t in enumerate(terms))
    return lagged.select(*series.columns, dy.alias("dy"))


# ------------------------------------------------- shared SQL arithmetic

def div(a: str, b: str, dialect: str) -> str:
    """Division that gives null on a zero divisor, in either dialect."""
    if dialect == "spark":
        return f"try_divide({a}, {b})"
    return f"(({a}) / NULLIF(({b}), 0))"


def diff_columns() -> list[tuple[str, str]]:
    """d0..d7 from y, y1..y8."""
    ys = ["y"] + [f"y{j}" for j in range(1, LAGS + 1)]
    return [(f"d{k}", f"{ys[k]} - {ys[k + 1]}") for k in range(LAGS)]


def moment_aggregates() -> list[str]:
    """Per-key sums (SQL text, valid in Spark SQL and DuckDB)."""
    last = LAGS - 1
    out = ["count(*) AS n", "count(d0) AS nd"]
    out += [f"sum(d0 * d{j}) AS g{j}" for j in range(AR_ORDER + 1)]
    out += [f"count(d{last}) AS n2"]
    out += [f"sum(CASE WHEN d{last} IS NOT NULL THEN d{i} * d{k} END) AS q{i}_{k}"
            for i in range(LAGS) for k in range(i, LAGS)]
    out += ["max_by(y, t) AS y_last", "max_by(d0, t) AS d_last", "max_by(ts, t) AS ts_last"]
    return out


def _q(i: int, k: int) -> str:
    return f"coalesce(q{min(i, k)}_{max(i, k)}, 0.0)"


def fit_steps(dialect: str) -> list[tuple[str, str]]:
    """Per-key arithmetic, in order: each step may use the previous ones."""
    m = AR_ORDER
    steps = [(f"r{j}", div(f"g{j}", "nd", dialect)) for j in range(m + 1)]
    # Levinson–Durbin
    steps += [("a1_1", div("r1", "r0", dialect)), ("e1", "r0 * (1 - a1_1 * a1_1)")]
    for k in range(2, m + 1):
        acc = " - ".join([f"r{k}"] + [f"a{k - 1}_{j} * r{k - j}" for j in range(1, k)])
        steps.append((f"lam{k}", div(acc, f"e{k - 1}", dialect)))
        for j in range(1, k):
            steps.append((f"a{k}_{j}", f"a{k - 1}_{j} - lam{k} * a{k - 1}_{k - j}"))
        steps.append((f"a{k}_{k}", f"lam{k}"))
        steps.append((f"e{k}", f"e{k - 1} * (1 - lam{k} * lam{k})"))
    # residual weights on lags 1..m+1 of d: e_hat_{t-1} = d1 - sum a_j d_{1+j}
    coef = {1: "1.0"} | {1 + j: f"(-a{m}_{j})" for j in range(1, m + 1)}
    see = " + ".join(f"{coef[p]} * {coef[q]} * {_q(p, q)}" for p in coef for q in coef)
    s0e = " + ".join(f"{coef[p]} * {_q(0, p)}" for p in coef)
    s1e = " + ".join(f"{coef[p]} * {_q(1, p)}" for p in coef)
    steps += [("see", see), ("s0e", s0e), ("s1e", s1e),
              ("det", f"{_q(1, 1)} * see - s1e * s1e"),
              ("phi_raw", div(f"see * {_q(0, 1)} - s1e * s0e", "det", dialect)),
              ("theta_raw", div(f"{_q(1, 1)} * s0e - s1e * {_q(0, 1)}", "det", dialect)),
              ("fit_ok", f"n >= {MIN_POINTS} AND phi_raw IS NOT NULL AND theta_raw IS NOT NULL"
                         " AND isnan(phi_raw) = false AND isnan(theta_raw) = false"),
              ("phi", f"CASE WHEN fit_ok THEN greatest(-{CLIP}, least({CLIP}, phi_raw)) ELSE 0.0 END"),
              ("theta", f"CASE WHEN fit_ok THEN greatest(-{CLIP}, least({CLIP}, theta_raw)) ELSE 0.0 END"),
              ("status", "CASE WHEN fit_ok THEN 'ok' ELSE 'too_short_or_constant' END"),
              ("sigma2", div(f"{_q(0, 0)} - 2 * phi * {_q(0, 1)} - 2 * theta * s0e + phi * phi * {_q(1, 1)}"
                             " + 2 * phi * theta * s1e + theta * theta * see", "n2", dialect))]
    return steps


FIT_COLUMNS = ["phi", "theta", "sigma2", "n", "status"]


def _apply_steps(df: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    """All steps in one projection: each step may name earlier ones (lateral
    column aliases), so the plan is analysed once, not once per step."""
    return df.selectExpr("*", *[f"{expr} AS {name}" for name, expr in steps])


def _fit_state(series: DataFrame, key=None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    keys = _keys(key)
    if not keys:
        # a single series: a constant key keeps every step a keyed join
        return _fit_state(series.withColumn("__one", F.lit(0)), ["__one"], block_rows).drop("__one")
    lagged = with_lags(series, keys, LAGS, block_rows)
    gaps = F.timestamp_diff("MICROSECOND", F.col("ts1"), F.col("ts"))
    rows = lagged.select(*keys, "t", "n", "ts", "y", gaps.alias("gap"),
                         *[F.expr(e).alias(n) for n, e in diff_columns()])
    aggs = [F.expr(a) for a in moment_aggregates()] + [F.min("gap").alias("gap_min"), F.max("gap").alias("gap_max")]
    sums = rows.groupBy(*keys).agg(*aggs)
    fitted = _apply_steps(sums, fit_steps("spark"))
    params = fitted.select(*keys, *FIT_COLUMNS, "y_last", "d_last", "ts_last", "gap_min", "gap_max")
    # last shock from each series' tail only (at most TAIL rows per key)
    tail = rows.where((F.col("n") - F.col("t") < TAIL) & F.col("d0").isNotNull()).select(
        *keys, "t", "n", "d0", "d1")
    coef = params.select(*keys, F.col("phi").alias("__phi"), F.col("theta").alias("__theta"))
    tail = tail.join(coef, keys, "inner")
    w = F.pow(-F.col("__theta"), (F.col("n") - F.col("t")).cast("double"))
    shock_term = w * (F.col("d0") - F.col("__phi") * F.coalesce(F.col("d1"), F.lit(0.0)))
    shocks = tail.groupBy(*keys).agg(F.sum(shock_term).alias("e_last"))
    return params.join(shocks, keys, "left")


def _ends(series: DataFrame, keys: list[str]) -> DataFrame:
    """Per series its last value, difference and time, and its least and largest gap."""
    rows = with_lags(series, keys, 1).select(*keys, "t", "ts", "y", (F.col("y") - F.col("y1")).alias("d0"),
                                             F.timestamp_diff("MICROSECOND", F.col("ts1"), F.col("ts")).alias("gap"))
    return rows.groupBy(*keys).agg(F.max_by("y", "t").alias("y_last"), F.max_by("d0", "t").alias("d_last"), F.max_by("ts", "t").alias("ts_last"),
                                   F.min("gap").alias("gap_min"), F.max("gap").alias("gap_max"))


def arima_fit(series: DataFrame, key=None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(keys..., phi, theta, sigma2, n, status)`` per series."""
    keys = _keys(key)
    return _fit_state(series, keys, block_rows).select(*keys, *FIT_COLUMNS)


def forecast_steps(dialect: str, steps_col: str = "step") -> list[tuple[str, str]]:
    g = "(phi * coalesce(d_last, 0.0) + theta * coalesce(e_last, 0.0))"
    return [("yhat", f"y_last + {g} * " + div(f"1 - power(phi, {steps_col})", "1 - phi", dialect))]


def arima_forecast(series: DataFrame, key=None, steps: int = 10, block_rows: int = BLOCK_ROWS,
                   fit: DataFrame | None = None) -> DataFrame:
    """``(keys..., step, ts, yhat)``, steps 1..``steps`` ahead.  ``ts`` is
    last time + step × gap when the series' gaps are all equal, else null.
    ``fit``: a result of ``arima_refine`` to forecast from instead of F3's."""
    keys = _keys(key)
    if fit is not None and not keys:
        return arima_forecast(series.withColumn("__one", F.lit(0)), ["__one"], steps, block_rows, fit.withColumn("__one", F.lit(0))).drop("__one")
    state = _fit_state(series, keys, block_rows) if fit is None else lookup_join(
        _ends(series, keys), fit.select(*keys, "phi", "theta", "e_last"), keys)
    ahead = state.select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    out = _apply_steps(ahead, forecast_steps("spark"))
    regular = (F.col("gap_min") == F.col("gap_max")) & (F.col("gap_min") > 0)
    ts = F.when(regular, F.timestamp_add("MICROSECOND", F.col("step") * F.col("gap_min"), F.col("ts_last")))
    return out.select(*keys, F.col("step").cast("int").alias("step"), ts.alias("ts"), "yhat")


def series_with_forecast(series: DataFrame, key=None, steps: int = 10, block_rows: int = BLOCK_ROWS,
                         fit: DataFrame | None = None) -> DataFrame:
    """history and forecast in one result: ``(keys..., kind, t, ts, y)``
    with kind ``history`` or ``forecast`` (t continues past n); ``fit`` as in F4."""
    keys = _keys(key)
    hist = series.select(*keys, F.lit("history").alias("kind"), "t", "ts", "y")
    fc = arima_forecast(series, keys, steps, block_rows, fit)
    n = series.groupBy(*keys).agg(F.max("n").alias("__n")) if keys else None
    if keys:
        fc = fc.join(n, keys, "left")
    else:
        fc = fc.withColumn("__n", series.agg(F.max("n")).scalar())
    fut = fc.select(*keys, F.lit("forecast").alias("kind"), (F.col("__n") + F.col("step")).alias("t"),
                    "ts", F.col("yhat").alias("y"))
    return hist.unionByName(fut)


# ------------------------------------------------------------------ F5 refine

def arima_refine(series: DataFrame, key=None, start: DataFrame | None = None, tol: float = 1e-6,
                 block_points: int | None = None) -> DataFrame:
    """φ, θ by exact maximum likelihood, started from F3 and a grid:
    ``(keys..., phi, theta, sigma2, n, status, converged, rounds, loglik_start,
    loglik, e_last)``, a row per series of three points or more and one with
    status ``too_short_or_constant`` for the others.  Rounds go on until no
    series moves (see ``likelihood``); ``converged`` tells whether the last
    Newton step was below ``tol`` or had nothing left to gain."""
    from quarry.operators import likelihood

    keys = _keys(key)
    if not keys:
        one = start.withColumn("__one", F.lit(0)) if start is not None else None
        return arima_refine(series.withColumn("__one", F.lit(0)), ["__one"], one, tol, block_points).drop("__one")
    init = start if start is not None else arima_fit(series, keys)
    return likelihood.maximise(series, init, keys, points=block_points or likelihood.BLOCK_POINTS, tol=tol)
