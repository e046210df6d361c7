"""Upper-tail probabilities of the t and chi-square distributions, as
column expressions (no Python runs on the workers).

Spark SQL has neither distribution.  Both densities are rewritten so that
nothing cancels for large degrees of freedom: with t = a·e^v, a = dof/2, the
chi-square (gamma) density is

    C(a) · exp(−a · (e^v − 1 − v)) dv,   C(a) = a^a e^−a / Γ(a),

and with t = √ν · sinh w the t density is

    K(ν) · cosh(w)^−ν dw,   K(ν) = Γ((ν+1)/2) / (√π · Γ(ν/2)).

The smaller tail of either is integrated from its edge to where the integrand
has fallen by e^−60 (found by bisection) with Gauss-Legendre panels, whose sums
are folds over literal arrays.  Two numbers of panels must agree to 1e-9, else
the expression raises an error instead of giving an answer.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(24)
#: exp(-_GONE) is nothing beside 1 in double precision.
_GONE = 60.0
_TOLERANCE = 1e-9
_HALVINGS, _PANELS = 60, (24, 48)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _tail(log_f: Callable[[Column], Column], start: Column, direction: Column, most: Column) -> Column:
    """ln of the integral of exp(log_f) from ``start`` on; log_f falls by more
    than ``_GONE`` within ``most``."""
    top = log_f(start)

    def halve(s: Column, _: Column) -> Column:
        middle = (s["lo"] + s["hi"]) / 2
        above = log_f(start + direction * middle) > top - _GONE
        return F.struct(F.when(above, middle).otherwise(s["lo"]).alias("lo"), F.when(above, s["hi"]).otherwise(middle).alias("hi"))

    reach = F.aggregate(F.sequence(F.lit(1), F.lit(_HALVINGS)), F.struct(F.lit(0.0).alias("lo"), most.alias("hi")), halve)["hi"]
    nodes = F.array(*[F.struct(F.lit(float((x + 1) / 2)).alias("x"), F.lit(float(w / 2)).alias("w")) for x, w in zip(_NODES, _WEIGHTS, strict=True)])

    def panels(n: int, r: Column) -> Column:
        def one(acc: Column, i: Column) -> Column:
            return acc + F.aggregate(nodes, F.lit(0.0), lambda a, p: a + p["w"] * F.exp(log_f(start + direction * (r * ((i + p["x"]) / n))) - top))

        return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), one) * r / n

    def checked(r: Column) -> Column:
        def both(x: Column) -> Column:
            agree = F.abs(x["coarse"] - x["fine"]) <= _TOLERANCE * x["fine"]
            return F.when(agree, top + F.log(x["fine"])).otherwise(F.raise_error(F.lit("a tail integral did not converge")).cast("double"))

        return _let(F.struct(panels(_PANELS[0], r).alias("coarse"), panels(_PANELS[1], r).alias("fine")), both)

    return _let(reach, checked)


def _excess(v: Column) -> Column:
    """e^v − 1 − v without cancellation near 0."""
    series = F.lit(1.0)
    for k in (8, 7, 6, 5, 4, 3):
        series = 1 + v / k * series
    return F.when(F.abs(v) < 0.05, v * v / 2 * series).otherwise(F.expm1(v) - v)


def _log_cosh(w: Column) -> Column:
    s = F.sinh(F.least(w, F.lit(1.0)))
    return F.when(w < 1, 0.5 * F.log1p(s * s)).otherwise(w + F.log1p(F.exp(-2 * w)) - math.log(2))


def _log_gamma(z: Column) -> Column:
    """ln Γ(z): Stirling's series at z + 10, and back by the product."""
    shifted = z + 10
    product = F.lit(0.0)
    for k in range(10):
        product = product + F.log(z + k)
    u = 1 / (shifted * shifted)
    series = (1 / 12 - u * (1 / 360 - u * (1 / 1260 - u * (1 / 1680 - u / 1188)))) / shifted
    return (shifted - 0.5) * F.log(shifted) - shifted + 0.5 * math.log(2 * math.pi) + series - product


def _log_c(a: Column) -> Column:
    """ln(a^a e^−a / Γ(a)), by Stirling's series where ln Γ would cancel."""
    large = 0.5 * F.log(a / (2 * math.pi)) - (1 / 12 - (1 / 360 - 1 / (1260 * a * a)) / (a * a)) / a
    return F.when(a < 50, a * F.log(a) - a - _log_gamma(a)).otherwise(large)


def _log_k(dof: Column) -> Column:
    """ln(Γ((ν+1)/2) / (√π Γ(ν/2))); for large ν by the asymptotic series of
    the ratio of gamma functions."""
    z = dof / 2
    ratio = 1 - 1 / (8 * z) + 1 / (128 * z * z) + 5 / (1024 * z * z * z) - 21 / (32768 * z * z * z * z)
    return F.when(z < 50, _log_gamma(z + 0.5) - _log_gamma(z) - 0.5 * math.log(math.pi)).otherwise(
        0.5 * F.log(z / math.pi) + F.log(ratio))


def _within(scale: Column) -> Column:
    """A distance within which the integrands have fallen by more than _GONE."""
    return F.sqrt(250 / scale) + 250 / scale


def chi2_pvalue(stat: Column, dof: Column) -> Column:
    """Upper-tail p of a chi-square statistic; dof 0 gives 1."""
    def tail(s: Column) -> Column:
        a, half = s["dof"] / 2, s["x"] / 2
        mean = (half - a) / a
        start = F.when((half > a / 2) & (half < 2 * a), F.log1p(mean)).otherwise(F.log(half / a))

        def of(v: Column) -> Column:
            upper = v >= 0                             # the smaller tail
            p = F.exp(F.least(F.lit(0.0), _tail(lambda x: -a * _excess(x), v, F.when(upper, 1.0).otherwise(-1.0), _within(a)) + _log_c(a)))
            return F.when(upper, p).otherwise(1 - p)

        return (F.when(F.isnan(s["x"]) | F.isnan(s["dof"]), F.lit(float("nan"))).when((s["dof"] <= 0) | (s["x"] <= 0), 1.0)
                .when(s["x"] == float("inf"), 0.0).otherwise(_let(start, of)))

    x, n = stat.cast("double"), dof.cast("double")
    return F.when(x.isNotNull() & n.isNotNull(), _let(F.struct(x.alias("x"), n.alias("dof")), tail))


def t_pvalue(t: Column, dof: Column) -> Column:
    """Two-sided p of a t statistic (null when t or dof is null)."""
    def tail(s: Column) -> Column:
        n = s["dof"]
        start = F.asinh(s["t"] / F.sqrt(n))
        p = _let(start, lambda w: F.exp(F.least(
            F.lit(0.0), _tail(lambda x: -n * _log_cosh(x), w, F.lit(1.0), _within(n)) + _log_k(n) + math.log(2))))
        return (F.when(F.isnan(s["t"]) | F.isnan(n) | (n <= 0), F.lit(float("nan"))).when(s["t"] == 0, 1.0)
                .when(s["t"] == float("inf"), 0.0).otherwise(p))

    value, n = F.abs(t.cast("double")), dof.cast("double")
    return F.when(value.isNotNull() & n.isNotNull(), _let(F.struct(value.alias("t"), n.alias("dof")), tail))
