import numpy as np
import pandas as pd
import pytest

from quarry.operators import correlate, rank


def _avg_rank(values):
    return pd.Series(values, dtype="float64").rank(method="average").tolist()


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_average_rank_matches_brute_force(spark, buckets):
    rng = np.random.default_rng(7)
    vals = rng.integers(0, 40, 500).astype(float).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, x double")
    got = {r.id: r.rank for r in rank.average_rank(df, "x", buckets=buckets).collect()}
    want = _avg_rank(vals)
    assert all(abs(got[i] - want[i]) < 1e-9 for i in range(len(vals)))


def test_hot_value(spark):
    # one value holds a third of the rows
    vals = [5.0] * 300 + [float(i) for i in range(600)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, x double")
    out = rank.attach_ranks(df, df["x"], rank.value_ranks(rank.value_counts(df, df["x"]), None, 8), "r")
    got = {r.id: r.r for r in out.collect()}
    want = _avg_rank(vals)
    assert len(got) == len(vals)
    assert all(abs(got[i] - want[i]) < 1e-9 for i in range(len(vals)))


def test_descending_any_type(spark):
    rows = [("b", 9007199254740992, "2024-01-02 00:00:00"), ("a", 9007199254740993, "2024-01-01 00:00:00"),
            ("b", 3, "2024-01-03 00:00:00"), (None, None, None)]
    df = spark.createDataFrame(rows, "s string, n long, t string").selectExpr("s", "n", "cast(t as timestamp) as t")
    for col, want in (("s", [1.5, 3.0, 1.5, None]), ("n", [2.0, 1.0, 3.0, None]), ("t", [2.0, 3.0, 1.0, None])):
        got = {(r.s, r.n): r.rank for r in rank.average_rank(df, col, ascending=False).collect()}
        assert [got[r[0], r[1]] for r in rows] == want, col


def test_rank_by_group_and_nulls(spark):
    data = [("a", 3.0), ("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", None), ("b", 1.0)]
    df = spark.createDataFrame(data, "g string, x double")
    got = sorted((r.g, r.x, r.rank) for r in rank.average_rank(df, "x", by=["g"]).collect()
                 if r.x is not None)
    assert got == [("a", 1.0, 1.0), ("a", 3.0, 2.5), ("a", 3.0, 2.5), ("b", 1.0, 1.0), ("b", 2.0, 2.0)]
    assert [r.rank for r in rank.average_rank(df, "x", by=["g"]).collect() if r.x is None] == [None]


def _matrix(df):
    return {(r.var_a, r.var_b): r.r for r in df.collect()}


def test_pearson_symmetric_unit_diagonal_and_constant(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=200)
    b = a * 0.5 + rng.normal(size=200)
    df = spark.createDataFrame([(float(x), float(y), 1.0) for x, y in zip(a, b)], "a double, b double, c double")
    m = _matrix(correlate.correlation(df, ["a", "b", "c"]))
    assert abs(m[("a", "b")] - np.corrcoef(a, b)[0, 1]) < 1e-10
    assert m[("a", "b")] == m[("b", "a")] and m[("a", "a")] == 1.0
    assert m[("a", "c")] is None and m[("c", "c")] is None


def test_spearman_pairwise_complete_matches_pandas(spark):
    rng = np.random.default_rng(3)
    n = 300
    a = rng.integers(0, 20, n).astype(float)
    b = rng.normal(size=n).round(1)
    c = a * 2 + rng.integers(0, 3, n)
    a[rng.random(n) < 0.1] = np.nan
    b[rng.random(n) < 0.15] = np.nan
    pdf = pd.DataFrame({"a": a, "b": b, "c": c})
    df = spark.createDataFrame(pdf)
    m = _matrix(correlate.correlation(df, ["a", "b", "c"], "spearman"))
    want = pdf.corr(method="spearman")
    for x in "abc":
        for y in "abc":
            assert abs(m[(x, y)] - want.loc[x, y]) < 1e-9, (x, y)


def test_spearman_by_group_with_missing_hot_and_constant_columns(spark):
    rng = np.random.default_rng(13)
    n = 400
    pdf = pd.DataFrame({"g": rng.choice(["u", "v"], n), "a": rng.integers(0, 5, n).astype(float), "b": rng.normal(size=n), "c": 1.0,
                        "d": rng.integers(0, 3, n).astype(float), "e": np.nan})
    for c, share in (("a", .4), ("b", .1), ("d", .2)):
        pdf.loc[rng.random(n) < share, c] = np.nan
    cols = ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame(pdf).repartition(6)
    got = {(r.g, r.var_a, r.var_b): r.r for r in correlate.correlation(df, cols, "spearman", by=["g"]).collect()}
    assert len(got) == 2 * 25
    for g, part in pdf.groupby("g"):
        want = part[cols].corr(method="spearman")
        for x in cols:
            for y in cols:
                w = want.loc[x, y]
                assert got[g, x, y] is None if np.isnan(w) else abs(got[g, x, y] - w) < 1e-9, (g, x, y)


def test_running_sums_cross_partitions(spark):
    from pyspark.sql import functions as F

    from quarry.operators.carried import running_sums

    rows = [(g, i, i % 7) for g, n in (("hot", 3000), ("x", 5), (None, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(9)
    for inclusive in (True, False):
        got = {(r.g, r.o): r.s for r in running_sums(df, ["g"], ["o"], {"s": F.col("v")}, inclusive).collect()}
        assert len(got) == len(rows)
        for g in ("hot", "x", None):
            own = np.array([v for k, _, v in rows if k == g])
            want = np.cumsum(own) - (0 if inclusive else own)
            assert [got[g, o] for o in range(len(own))] == want.tolist()


def test_spearman_invariant_under_monotone_map(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=100)
    b = a + rng.normal(size=100)
    df = spark.createDataFrame([(float(x), float(y), float(np.exp(x))) for x, y in zip(a, b)],
                               "a double, b double, ea double")
    m = _matrix(correlate.correlation(df, ["a", "b", "ea"], "spearman"))
    assert abs(m[("a", "b")] - m[("ea", "b")]) < 1e-12 and abs(m[("a", "ea")] - 1.0) < 1e-12


def test_correlation_needs_two_columns(spark):
    df = spark.createDataFrame([(1.0,)], "a double")
    with pytest.raises(ValueError):
        correlate.correlation(df, ["a"])


def test_lookup_join_with_a_hot_and_a_null_group(spark):
    from pyspark.sql import functions as F

    from quarry.operators._lookup import lookup_join

    data = spark.createDataFrame([("hot" if i % 3 else f"k{i % 50}", i) for i in range(3000)] + [(None, -1)],
                                 "g string, v long")
    table = data.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    out = lookup_join(data, table, ["g"])
    sums, n = {}, {}
    for g, v in data.collect():
        sums[g], n[g] = sums.get(g, 0) + v, n.get(g, 0) + 1
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        ((g, v, n[g], sums[g]) for g, v in data.collect()), key=str)
