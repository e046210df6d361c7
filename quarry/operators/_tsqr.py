"""Least squares by tall-skinny QR.

Every task turns its rows [1, x_1 .. x_k, y] into the triangular factor R of
their QR decomposition, batch by batch: the factor of a stack of rows is the
factor of the stacked factors.  Factors of tasks are merged the same way, in
two levels, so one row per task and group is all that travels, and one scan of
the data is all that is read.  R has the condition number of the data; the sums
of squares and products that normal equations start from have its square.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import ship_package

#: Groups of factors that are merged side by side before the last merge.
FAN = 64
#: Factors of groups that a task holds before it hands them on.
HELD = 4096
#: Singular values under this share of the largest count as none.
RANK_TOLERANCE = 1e-11


def factor(rows: np.ndarray) -> np.ndarray:
    """R of ``rows``, square whatever their number."""
    r = np.linalg.qr(rows, mode="r")
    out = np.zeros((rows.shape[1],) * 2)
    out[: len(r)] = r
    return out


def solve(r: np.ndarray, n: int) -> tuple[float, np.ndarray, float, str]:
    """Intercept, coefficients, R² and status from the factor of n rows.  The
    predictors are brought to unit spread first; where they depend on each other
    (``collinear``) the coefficients with the least norm are returned."""
    k = len(r) - 2
    a, b, rest = r[1 : k + 1, 1 : k + 1], r[1 : k + 1, k + 1], r[k + 1, k + 1]
    # what rounding leaves of a constant column is none of its spread
    level = np.sqrt((r[: k + 1, 1 : k + 1] ** 2).sum(axis=0))
    size = np.sqrt((a ** 2).sum(axis=0))
    live = size > 1e-14 * level
    unit = np.where(live, size, 1.0)
    u, s, vt = np.linalg.svd(np.where(live, a, 0.0) / unit)
    used = s > max(s.max(initial=0.0), 1e-300) * RANK_TOLERANCE
    beta = vt[used].T @ ((u[:, used].T @ b) / s[used]) / unit
    status = "ok"
    if not used.all():
        status = "collinear"
        free, _ = np.linalg.qr(vt[~used].T / unit[:, None])
        beta = beta - free @ (free.T @ beta)
    left = b - a @ beta
    total = b @ b + rest * rest
    spread = np.sqrt(total) > 1e-14 * np.sqrt(total + r[0, k + 1] ** 2)
    r2 = float(1 - (left @ left + rest * rest) / total) if spread else float("nan")
    return float((r[0, k + 1] - r[0, 1 : k + 1] @ beta) / r[0, 0]), beta, r2, status


def factors(df: DataFrame, values: list[Column], by: list[str]) -> DataFrame:
    """``by..., __n, __missing, __r binary``: per group the rows, those with a missing
    value (which take no part), and R."""
    ship_package(df.sparkSession)
    k = len(values)
    names = [f"__x{i}" for i in range(k)]
    base = df.select(*by, *[v.cast("double").alias(c) for v, c in zip(values, names, strict=True)])
    keys = "".join(f"`{c}` {base.schema[c].dataType.simpleString()}, " for c in by)

    def rows(found: dict, schema: pa.Schema, lane: int):
        columns = [pa.array([g[c] for g in found], schema.field(name).type) for c, name in enumerate(by)]
        columns += [pa.array([lane] * len(found), pa.int32()), pa.array([v[0] for v in found.values()], pa.int64()),
                    pa.array([v[1] for v in found.values()], pa.int64()), pa.array([v[2].tobytes() for v in found.values()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[*by, "__lane", "__n", "__missing", "__r"])

    def run(batches):
        lane = TaskContext.get().partitionId() % FAN
        found: dict = {}
        schema = None
        for b in batches:
            schema = b.schema
            x = np.column_stack([np.ones(b.num_rows), *[b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names]])
            groups = [((), slice(None))]
            if by and b.num_rows:
                number: dict = {}
                code = np.array([number.setdefault(g, len(number)) for g in zip(*[b.column(c).to_pylist() for c in by], strict=True)], np.int64)
                order = np.argsort(code, kind="stable")
                groups = list(zip(number, np.split(order, np.cumsum(np.bincount(code))[:-1]), strict=True))
            for g, own in groups if b.num_rows else ():
                part = x[own]
                whole = ~np.isnan(part).any(axis=1)
                n, missing, r = found.get(g, (0, 0, np.zeros((0, k + 1))))
                found[g] = (n + len(part), missing + int((~whole).sum()), factor(np.vstack([r, part[whole]])))
            if len(found) > HELD:
                yield rows(found, schema, lane)
                found = {}
        if found:
            yield rows(found, schema, lane)

    def merge(table: pa.Table) -> pa.Table:
        stack = np.frombuffer(b"".join(table.column("__r").to_pylist())).reshape(-1, k + 1)
        lane = table.slice(0, 1)
        out = {name: lane.column(name) for name in [*by, "__lane"]}
        sums = {c: [sum(table.column(c).to_pylist())] for c in ("__n", "__missing")}
        return pa.table(out | {c: pa.array(v, pa.int64()) for c, v in sums.items()} | {"__r": pa.array([factor(stack).tobytes()], pa.binary())})

    schema = f"{keys}__lane int, __n bigint, __missing bigint, __r binary"
    per_task = base.mapInArrow(run, schema)
    lanes = per_task.groupBy(*by, "__lane").applyInArrow(merge, schema)
    last = lanes.withColumn("__lane", F.lit(0)).groupBy(*by, "__lane").applyInArrow(merge, schema)
    return last.drop("__lane")
