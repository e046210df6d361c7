"""Second moments of many columns at once, inside the engine.

The columns' means come first (``attach``: one aggregation, read as a scalar
subquery or joined per group).  Then one aggregation over the centred values
sums each pair over the rows in which both of its values are present.  Up to
``DIRECT`` columns every pair has its own sums in one aggregate, few enough for
compiled code.  More columns are cut into tiles of ``TILE``: a row is exploded
to its pairs of tiles, and every (tile, tile) group sums its small product,
combined map-side, so the number of expressions does not grow with the columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators._stats import attach, grouped_agg

#: Columns whose pairs fit one compiled aggregate; columns of a tile.
DIRECT, TILE = 4, 3


def _pair_sums(i: Column, j: Column, x: Column, y: Column, same: bool) -> Column:
    """Sums of one pair over the rows with both values, as a struct."""
    def where(v: Column, other: Column) -> Column:
        return v if same else F.when(other.isNotNull(), v)

    a, b = where(x, y), where(y, x)
    first = [F.count(a).alias("n"), F.sum(a).alias("sx"), F.sum(a * a).alias("sxx"), F.min(a).alias("lo_i"), F.max(a).alias("hi_i")]
    if same:
        n, s, ss, lo, hi = first
        rest = [s.alias("sy"), ss.alias("syy"), ss.alias("sxy"), lo.alias("lo_j"), hi.alias("hi_j")]
    else:
        rest = [F.sum(b).alias("sy"), F.sum(b * b).alias("syy"), F.sum(x * y).alias("sxy"), F.min(b).alias("lo_j"), F.max(b).alias("hi_j")]
    return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), *first, *rest)


def _sums(centred: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """``by..., i, j`` (i <= j) and the pair's sums."""
    k = len(names)
    if k <= DIRECT:
        pairs = F.array(*[_pair_sums(F.lit(i), F.lit(j), F.col(names[i]), F.col(names[j]), i == j) for i in range(k) for j in range(i, k)])
        return grouped_agg(centred, by, [pairs.alias("pairs")]).select(*by, F.inline("pairs"))
    tiles = -(-k // TILE)
    index = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(tiles) for b in range(a, tiles)])
    rows = centred.select(*by, F.array(*names).alias("x"), F.explode(index).alias("t"))
    cells = rows.select(*by, "t.a", "t.b", *[F.get("x", F.col(f"t.{s}") * TILE + c).alias(f"{s}{c}") for s in "ab" for c in range(TILE)])
    pairs = F.array(*[_pair_sums(F.lit(p), F.lit(q), F.col(f"a{p}"), F.col(f"b{q}"), False) for p in range(TILE) for q in range(TILE)])
    found = cells.groupBy(*by, "a", "b").agg(pairs.alias("pairs")).select(*by, "a", "b", F.inline("pairs"))
    return (found.withColumns({"i": (F.col("a") * TILE + F.col("i")).cast("int"), "j": (F.col("b") * TILE + F.col("j")).cast("int")})
            .drop("a", "b").where((F.col("i") <= F.col("j")) & (F.col("j") < k)))


def pair_moments(df: DataFrame, values: list[Column], by: list[str] | None = None) -> DataFrame:
    """``(by..., i, j, n, mean_i, mean_j, sii, sjj, sij, flat_i, flat_j)`` for
    i <= j: over the rows in which both values are present, their number,
    means and centred sums of squares and products; flat: all values equal."""
    by = by or []
    k = len(values)
    names = [f"__x{i}" for i in range(k)]
    base = df.select(*by, *[v.cast("double").alias(n) for v, n in zip(values, names, strict=True)])
    means = grouped_agg(base, by, [F.avg(n).alias(f"__m{i}") for i, n in enumerate(names)])
    frame, stat = attach(base, means, by)
    centred = frame.select(*by, *[(F.col(n) - stat(f"__m{i}")).alias(n) for i, n in enumerate(names)])
    out, mean = attach(_sums(centred, names, by), means, by)
    n = F.col("n")
    some = n > 0

    def mean_of(index: str, s: str) -> Column:
        all_means = F.array(*[mean(f"__m{c}") for c in range(k)])
        return F.when(some, F.get(all_means, F.col(index)) + F.col(s) / n)

    def spread(a: str, b: str, product: str) -> Column:
        return F.when(some, F.col(product) - F.col(a) * F.col(b) / n)

    return out.select(*by, "i", "j", n.cast("bigint").alias("n"), mean_of("i", "sx").alias("mean_i"),
                      mean_of("j", "sy").alias("mean_j"), spread("sx", "sx", "sxx").alias("sii"),
                      spread("sy", "sy", "syy").alias("sjj"), spread("sx", "sy", "sxy").alias("sij"),
                      F.coalesce(F.col("lo_i") == F.col("hi_i"), F.lit(True)).alias("flat_i"),
                      F.coalesce(F.col("lo_j") == F.col("hi_j"), F.lit(True)).alias("flat_j"))
