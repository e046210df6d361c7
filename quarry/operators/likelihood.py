"""ARIMA(1,1,1) by exact maximum likelihood, for many series of any length.

The differences d_t of a series follow d_t = φ·d_{t−1} + ε_t + θ·ε_{t−1}.  The
Kalman filter of that model has innovations v_t with variances σ²·R_t,

    R_{t+1} = 1 + θ² − θ²/R_t,      R_1 = (1 + 2φθ + θ²)/(1 − φ²),
    v_t = d_t − φ·d_{t−1} − θ·v_{t−1}/R_{t−1}.

R_t is a ratio u_t/u_{t−1} with u_t = a + b·θ^{2t}, so every variance has a closed
form, Σ log R_t = log u_m, and z_t = u_{t−1}·v_t obeys z_t = u_{t−1}·x_t − θ·z_{t−1}.
A filter step is thus an affine map of z, and the sum of squares is a quadratic
form of the z that enters.  Both compose, so the filter runs as an associative
scan: each block of positions is reduced to one *element* (map and form), inside
a block by doubling, and the elements of a series are combined in a tree
(``FAN`` at a time), whatever its length.

The two parameters are found by Newton steps on the concentrated likelihood,
many series at once.  A round is one pass over the packed blocks of the series
that still move; it evaluates a difference stencil round the next point,
shorter steps on the way to it and steps straight downhill.  A point is only taken if the likelihood rises,
and rounds go on until no series moves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators._lookup import lookup_join
from quarry.session import cut_lineage, cuts_of, drop_cuts, ship_package

#: Points of a block; elements that one task combines.
BLOCK_POINTS, FAN = 4096, 1024
#: Largest |phi| and |theta| tried.
EDGE = 0.9995
#: Width of the difference stencil, in atanh of the parameters.
WIDTH = 1e-4
_GRID = [(p, q) for p in (-.9, -.6, -.3, 0., .3, .6, .9) for q in (-.9, -.6, -.3, 0., .3, .6, .9)]
_STENCIL = np.array([(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)], float) * WIDTH
_SHORTER = 0.25 ** np.arange(1, 9)
_ELEMENT = "struct<z:double,g:double,ll:double,lg:double,gg:double>"


def packed_blocks(series: DataFrame, keys: list[str], points: int = BLOCK_POINTS) -> DataFrame:
    """``keys..., blk, first, prev, d array<double>``: the differences of every
    series in blocks of ``points`` positions; ``first`` counts from 1, ``prev``
    is the difference before the block (null before the first).  Written to the
    shared checkpoint folder."""
    from quarry.operators.forecast import with_lags

    lagged = with_lags(series, keys, 2).where(F.col("y1").isNotNull())
    rows = lagged.select(*keys, (F.col("t") - 1).alias("t"), (F.col("y") - F.col("y1")).alias("d"), (F.col("y1") - F.col("y2")).alias("before"))
    blocks = rows.groupBy(*keys, F.expr(f"(t - 1) div {points}").alias("blk")).agg(
        F.min("t").alias("first"), F.min_by("before", "t").alias("prev"),
        F.transform(F.sort_array(F.collect_list(F.struct("t", "d"))), lambda x: x["d"]).alias("d"))
    return cut_lineage(blocks)


def variance_scale(phi, theta):
    """a and b of u_t = a + b·θ^(2t)."""
    b = -((theta + phi) ** 2) / ((1 - phi * phi) * (1 - theta * theta))
    return 1 - b, b


def block_elements(d: np.ndarray, sizes: np.ndarray, first: np.ndarray, prev: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Elements (z, g, ll, lg, gg) of blocks that lie one after another in
    ``d``, for one (phi, theta) per block."""
    starts = np.cumsum(sizes) - sizes
    pos = np.arange(len(d)) - np.repeat(starts, sizes)
    p, q = np.repeat(phi, sizes), np.repeat(theta, sizes)
    before = np.empty_like(d)
    before[1:] = d[:-1]
    before[starts] = prev                              # 0 before the first difference
    a, b = variance_scale(p, q)
    t = np.repeat(first, sizes) + pos
    upper = a + b * np.abs(q) ** (2 * t)               # u_t
    lower = a + b * np.abs(q) ** (2 * (t - 1))         # u_{t-1}
    z = lower * (d - p * before)
    power, shift, most = -q, 1, int(sizes.max())
    while shift < most and np.abs(power).max() > 1e-30:
        more = np.where(pos[shift:] >= shift, power[shift:] * z[:-shift], 0.0)
        z[shift:] += more                              # of the values before this round: more is a copy
        power, shift = power * power, 2 * shift
    g = (-q) ** (pos + 1)
    weight = 1 / (lower * upper)
    ends = starts + sizes - 1
    return np.stack([z[ends], g[ends], *(np.add.reduceat(x, starts) for x in (z * z * weight, z * g * weight, g * g * weight))], axis=1)


def evaluate(d: np.ndarray, sizes: np.ndarray, first: np.ndarray, prev: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Elements (blocks, points, 5) of blocks at their own points (phi, theta)."""
    return np.stack([block_elements(d, sizes, first, prev, points[:, k, 0], points[:, k, 1]) for k in range(points.shape[1])], axis=1)


def _block_arrays(b: pa.RecordBatch):
    """d, sizes, first, prev of the blocks of a batch."""
    d = b.column("d")
    return (d.flatten().to_numpy(zero_copy_only=False), np.diff(d.offsets.to_numpy()).astype(np.int64),
            b.column("first").to_numpy(zero_copy_only=False), np.nan_to_num(b.column("prev").to_numpy(zero_copy_only=False)))


def _points(b: pa.RecordBatch) -> np.ndarray:
    flat = b.column("at").flatten()
    return np.stack([flat.field(c).to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in ("phi", "theta")], axis=2)


def elements(blocks: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., blk, e array<element>``: an element for each of the key's
    points ``at array<struct<phi,theta>>``."""
    # only series that have points take part
    joined = lookup_join(blocks, points.select(*keys, "at"), keys).where("at is not null")
    names = [f"__k{i}" for i in range(len(keys))]
    types = [blocks.schema[k].dataType.simpleString() for k in keys]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            with np.errstate(all="ignore"):
                out = evaluate(*_block_arrays(b), _points(b))
            offsets = pa.array((np.arange(b.num_rows + 1) * out.shape[1]).astype(np.int32))
            out = out.reshape(-1, 5)
            e = pa.StructArray.from_arrays([pa.array(out[:, c]) for c in range(5)], names=["z", "g", "ll", "lg", "gg"])
            yield pa.RecordBatch.from_arrays(
                [*[b.column(n) for n in names], b.column("blk"), pa.ListArray.from_arrays(offsets, e)],
                names=[*names, "blk", "e"])

    src = joined.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], "blk", "first", "prev", "d", "at")
    schema = ", ".join([f"{n} {t}" for n, t in zip(names, types, strict=True)] + ["blk long", f"e array<{_ELEMENT}>"])
    return src.mapInArrow(run, schema).withColumnsRenamed(dict(zip(names, keys, strict=True)))


def compose(one: Column, two: Column) -> Column:
    """The element of two pieces in a row."""
    z, g = one["z"], one["g"]
    return F.struct((two["z"] + two["g"] * z).alias("z"), (g * two["g"]).alias("g"),
                    (one["ll"] + two["ll"] + 2 * z * two["lg"] + z * z * two["gg"]).alias("ll"),
                    (one["lg"] + g * two["lg"] + g * z * two["gg"]).alias("lg"),
                    (one["gg"] + g * g * two["gg"]).alias("gg"))


def combined(parts: DataFrame, keys: list[str], last_block: int, fan: int = FAN) -> DataFrame:
    """``keys..., e``: the elements of whole series, combined ``fan`` at a time."""
    while True:
        rows = F.sort_array(F.collect_list(F.struct("blk", "e"))).alias("rows")
        grouped = parts.groupBy(*keys, F.expr(f"blk div {fan}").alias("up")).agg(rows)
        whole = F.aggregate(F.slice("rows", F.lit(2), F.size("rows")), F.col("rows")[0]["e"],
                            lambda acc, r: F.zip_with(acc, r["e"], compose))
        parts = grouped.select(*keys, F.col("up").alias("blk"), whole.alias("e"))
        if last_block < fan:
            return parts.drop("blk")
        last_block //= fan


def mean_objective(ll: np.ndarray, m: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """What the likelihood is a falling function of: log of the mean square
    and of the variances, for each observation."""
    a, b = variance_scale(phi, theta)
    f = np.log(ll / m) + np.log(a + b * np.abs(theta) ** (2 * m)) / m
    return np.where(np.isfinite(f), f, np.inf)


def log_likelihood(f, m):
    return -0.5 * m * (f + 1 + np.log(2 * np.pi))


def exact_log_likelihood(series: DataFrame, at: list[tuple[float, float]], key=None, points: int = BLOCK_POINTS) -> DataFrame:
    """``keys..., phi, theta, sigma2, loglik``: every series' exact likelihood
    at given parameters, with the best variance for them."""
    from quarry.operators.forecast import _keys

    ship_package(series.sparkSession)
    keys = _keys(key)
    blocks = packed_blocks(series, keys, points)
    given = F.array(*[F.struct(F.lit(float(p)).alias("phi"), F.lit(float(q)).alias("theta")) for p, q in at])
    totals = blocks.groupBy(*keys).agg(F.sum(F.size("d")).alias("m"))
    last = blocks.agg(F.max("blk")).first()[0] or 0
    whole = combined(elements(blocks, totals.withColumn("at", given), keys), keys, last)
    rows = lookup_join(whole, totals, keys).select(*keys, "m", F.explode(F.arrays_zip(F.col("e.ll").alias("ll"), given.alias("at"))).alias("x"))
    phi, theta, ll, m = F.col("x.at.phi"), F.col("x.at.theta"), F.col("x.ll"), F.col("m")
    b = -F.pow(theta + phi, F.lit(2)) / ((1 - phi * phi) * (1 - theta * theta))
    spread = F.log(1 - b + b * F.pow(theta * theta, m))
    return rows.select(*keys, phi.alias("phi"), theta.alias("theta"), (ll / m).alias("sigma2"),
                       (-0.5 * (m * (F.log(2 * F.lit(np.pi) * ll / m) + 1) + spread)).alias("loglik"))


def _newton(f: np.ndarray, at: np.ndarray, edge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Step, steepest descent (length 1) and expected fall out of stencil values round ``at``, one row per
    series.  A direction in which the surface is not convex is walked downhill;
    a parameter that would leave the edge it is on stays, the other goes alone."""
    g = np.stack([f[:, 1] - f[:, 2], f[:, 3] - f[:, 4]], axis=1) / (2 * WIDTH)
    h = np.empty((len(f), 2, 2))
    h[:, 0, 0] = (f[:, 1] + f[:, 2] - 2 * f[:, 0]) / WIDTH ** 2
    h[:, 1, 1] = (f[:, 3] + f[:, 4] - 2 * f[:, 0]) / WIDTH ** 2
    h[:, 0, 1] = h[:, 1, 0] = (f[:, 5] - f[:, 6] - f[:, 7] + f[:, 8]) / (4 * WIDTH ** 2)
    ok = np.isfinite(h).all(axis=(1, 2)) & np.isfinite(g).all(axis=1)
    h[~ok], g[~ok] = np.eye(2), 0
    values, vectors = np.linalg.eigh(h)
    along = np.einsum("nij,ni->nj", vectors, g)
    step = -np.einsum("nij,nj->ni", vectors, along / np.maximum(np.abs(values), 1e-6))
    stays = (np.abs(at) >= edge * (1 - 1e-9)) & (step * at > 0)
    alone = -g / np.maximum(np.abs(h[:, [0, 1], [0, 1]]), 1e-6)
    step = np.where(stays, 0.0, np.where(stays[:, ::-1], alone, step))
    length = np.maximum(np.abs(step).max(axis=1), 1e-300)
    step *= np.minimum(1, 1.5 / length)[:, None]
    down = np.where((np.abs(at) >= edge * (1 - 1e-9)) & (g * at < 0), 0.0, -g)
    down /= np.maximum(np.linalg.norm(down, axis=1), 1e-300)[:, None]
    return step, down, -0.5 * np.einsum("ni,ni->n", step, g)


def next_points(s: dict[str, np.ndarray], points: np.ndarray, e: np.ndarray, tol: float) -> dict[str, np.ndarray]:
    """One round for a batch of series.  ``s``: their state; ``points`` (series,
    points, 2) in atanh; ``e`` their elements.  The first nine points are a
    stencil round a centre, but in the first round."""
    phi, theta = np.tanh(points[..., 0]), np.tanh(points[..., 1])
    m = s["m"][:, None].astype(float)
    f = mean_objective(e[..., 2], m, phi, theta)
    rows = np.arange(len(f))
    first = s["round"] == 0
    # off-centre points of a stencil are for derivatives only
    own = f.copy()
    own[~first, 1:9] = np.inf
    at = own.argmin(axis=1)
    low = own[rows, at]
    moved = low < s["f"] - 1e-13 * (1 + np.where(np.isfinite(s["f"]), np.abs(s["f"]), 0))
    out = {k: v.copy() for k, v in s.items()}
    out["f_start"] = np.where(first, f[:, 0], s["f_start"])
    for k, v in (("f", low), ("a", points[rows, at, 0]), ("b", points[rows, at, 1]), ("ll", e[rows, at, 2]), ("z", e[rows, at, 0])):
        out[k] = np.where(moved, v, s[k])
    # ``fresh``: the centre is the best point itself, looked at for its derivatives
    centre = ~first & (at == 0) & (moved | s["fresh"])
    best = np.stack([out["a"], out["b"]], axis=1)
    edge = np.arctanh(EDGE)
    step, down, fall = _newton(f[:, :9], best, edge)
    goal = np.clip(best + step, -edge, edge)
    small = np.abs(goal - best).max(axis=1) < tol
    still = ~moved & ~first & ~centre                  # nothing on the way is better: as low as it gets
    out["fall"] = np.where(centre, fall, s["fall"])
    out["done"] = still | (centre & small) | ~np.isfinite(out["f"])
    out["converged"] = np.isfinite(out["f"]) & ((centre & small) | (still & (s["fall"] < 1e-9)))
    out["round"], out["fresh"] = s["round"] + 1, ~centre
    base = np.where(centre[:, None], goal, best)
    ways = np.where(centre[:, None, None], np.stack([goal - best, 0.5 * down], axis=1), 0.0)
    on_the_way = (best[:, None, None] + ways[:, :, None] * _SHORTER[None, None, :, None]).reshape(len(best), -1, 2)
    out["points"] = np.concatenate([base[:, None] + _STENCIL, np.clip(on_the_way, -edge, edge)], axis=1)
    return out


_STATE = ["m", "round", "f", "a", "b", "ll", "z", "fall", "f_start", "fresh", "done", "converged"]
_FLAGS = ("fresh", "done", "converged")


def _step(state: DataFrame, sums: DataFrame, keys: list[str], tol: float) -> DataFrame:
    joined = lookup_join(state.where("not done"), sums, keys)
    names = [f"__k{i}" for i in range(len(keys))]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            s = {k: b.column(k).to_numpy(zero_copy_only=False) for k in _STATE}
            s = {k: v.astype(bool) if k in _FLAGS else v for k, v in s.items()}
            e = b.column("e").flatten()
            values = np.stack([e.field(c).to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in range(5)], axis=2)
            with np.errstate(all="ignore"):
                new = next_points(s, np.arctanh(_points(b)), values, tol)
            p = np.tanh(new.pop("points"))
            at = pa.StructArray.from_arrays([pa.array(p[..., c].ravel()) for c in (0, 1)], names=["phi", "theta"])
            offsets = pa.array((np.arange(b.num_rows + 1) * p.shape[1]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], *[pa.array(new[k]) for k in _STATE], pa.ListArray.from_arrays(offsets, at)],
                                             names=[*names, *_STATE, "at"])

    src = joined.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], *_STATE, "at", "e")
    schema = _state_schema(names, keys, state, ", at array<struct<phi:double,theta:double>>")
    return src.mapInArrow(run, schema).withColumnsRenamed(dict(zip(names, keys, strict=True)))


def _state_schema(names: list[str], keys: list[str], state: DataFrame, more: str = "") -> str:
    types = {"m": "long", "round": "long"} | dict.fromkeys(_FLAGS, "boolean")
    return ", ".join([f"{n} {state.schema[k].dataType.simpleString()}" for k, n in zip(keys, names, strict=True)]
                     + [f"{k} {types.get(k, 'double')}" for k in _STATE]) + more


def _in_tasks(state: DataFrame, blocks: DataFrame, keys: list[str], tol: float) -> DataFrame:
    """All rounds of series that lie in one block, inside the task that has it."""
    names = [f"__k{i}" for i in range(len(keys))]
    joined = lookup_join(blocks, state.select(*keys, *_STATE, "at"), keys).where("m is not null")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            s = {k: b.column(k).to_numpy(zero_copy_only=False) for k in _STATE}
            s = {k: v.astype(bool) if k in _FLAGS else v for k, v in s.items()}
            d, sizes, first, prev = _block_arrays(b)
            points, going = np.arctanh(_points(b)), np.arange(b.num_rows)
            final = {k: v.copy() for k, v in s.items()}
            with np.errstate(all="ignore"):
                while len(going):
                    keep = np.repeat(np.isin(np.arange(b.num_rows), going), sizes)
                    e = evaluate(d[keep], sizes[going], first[going], prev[going], np.tanh(points))
                    s = next_points({k: v[going] for k, v in final.items()}, points, e, tol)
                    points = s.pop("points")
                    for k, v in s.items():
                        final[k][going] = v
                    going, points = going[~s["done"]], points[~s["done"]]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], *[pa.array(final[k]) for k in _STATE]], names=[*names, *_STATE])

    src = joined.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], "first", "prev", "d", *_STATE, "at")
    return src.mapInArrow(run, _state_schema(names, keys, state)).withColumnsRenamed(dict(zip(names, keys, strict=True)))


def maximise(series: DataFrame, start: DataFrame, keys: list[str], *, points: int = BLOCK_POINTS, tol: float = 1e-6) -> DataFrame:
    """``keys..., phi, theta, sigma2, n, status, converged, rounds, loglik_start,
    loglik, e_last`` for every row of ``start`` (``keys..., phi, theta, n``).

    ``status`` is ``ok``, ``too_short_or_constant`` (fewer than two
    differences, or all 0) or ``missing_values``; parameters of the latter two
    are 0.  ``e_last`` is the last shock, for forecasts."""
    spark = series.sparkSession
    ship_package(spark)
    before = cuts_of(spark)
    blocks = packed_blocks(series, keys, points)
    info = blocks.groupBy(*keys).agg(
        F.sum(F.size("d")).cast("long").alias("m"), F.max("blk").alias("last_blk"), F.max(F.array_max(F.transform("d", F.abs))).alias("largest"),
        F.max(F.exists("d", lambda x: x.isNull() | F.isnan(x))).alias("gaps"))
    begin = lookup_join(start.select(*keys, "phi", "theta", "n"), info, keys)
    status = (F.when(F.col("gaps"), "missing_values").when((F.coalesce("m", F.lit(0)) < 2) | (F.coalesce("largest", F.lit(0.0)) == 0), "too_short_or_constant")
              .otherwise("ok"))
    begin = cut_lineage(begin.withColumn("status", status))
    none = F.lit(float("inf"))
    grid = F.array(F.struct(F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), F.col("phi"))).alias("phi"),
                            F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), F.col("theta"))).alias("theta")),
                   *[F.struct(F.lit(p).alias("phi"), F.lit(q).alias("theta")) for p, q in _GRID])
    zero = F.lit(0.0)
    state = begin.where("status = 'ok'").select(
        *keys, "last_blk", "m", F.lit(0).cast("long").alias("round"), none.alias("f"), zero.alias("a"), zero.alias("b"), zero.alias("ll"), zero.alias("z"),
        none.alias("fall"), none.alias("f_start"), F.lit(False).alias("fresh"), F.lit(False).alias("done"), F.lit(False).alias("converged"), grid.alias("at"))
    finished = _in_tasks(state.where("last_blk = 0"), blocks, keys, tol)
    last = blocks.agg(F.max("blk")).first()[0] or 0
    state = state.where("last_blk > 0").drop("last_blk")
    while last:                                        # some series is longer than a block
        sums = combined(elements(blocks, state, keys), keys, last)
        fresh = cut_lineage(_step(state, sums, keys, tol))
        finished = finished.unionByName(fresh.where("done").drop("at"))
        state = fresh.where("not done")
        if state.isEmpty():
            break
    fitted = cut_lineage(finished)
    kept = set(cuts_of(spark)[-1:])
    out = lookup_join(cut_lineage(begin), fitted.select(*keys, "round", "f", "a", "b", "ll", "z", "f_start", "converged"), keys)
    kept |= set(cuts_of(spark)[-1:])
    drop_cuts(spark, [p for p in cuts_of(spark) if p not in before and p not in kept])
    ok = F.col("status") == "ok"
    m = F.col("m")
    phi, theta = F.when(ok, F.tanh("a")).otherwise(0.0), F.when(ok, F.tanh("b")).otherwise(0.0)
    tail = F.pow(F.col("theta") * F.col("theta"), m.cast("double"))
    b = -F.pow(F.col("theta") + F.col("phi"), F.lit(2)) / ((1 - F.col("phi") * F.col("phi")) * (1 - F.col("theta") * F.col("theta")))

    def loglik(f: str) -> Column:
        return F.when(ok & (F.abs(F.col(f)) != float("inf")), -0.5 * m * (F.col(f) + 1 + F.log(F.lit(2 * np.pi))))

    out = out.withColumns({"phi": phi, "theta": theta})
    return out.select(*keys, "phi", "theta", F.when(ok, F.col("ll") / m).alias("sigma2"), "n", "status",
                      F.coalesce("converged", F.lit(False)).alias("converged"), F.coalesce("round", F.lit(0)).cast("long").alias("rounds"),
                      loglik("f_start").alias("loglik_start"), loglik("f").alias("loglik"),
                      F.when(ok, F.col("z") / (1 - b + b * tail)).otherwise(0.0).alias("e_last"))
