import datetime as dt

from pyspark.sql import functions as F

from quarry.functions.columns import render_text
from quarry.operators import explore


def test_filter_any_text_literal_and_case(spark):
    df = spark.createDataFrame([(1, "Alpha.Beta", 1.5), (2, "gamma", None), (3, "AxB", 10000000.0)],
                               "id long, s string, v double")
    assert [r.id for r in explore.filter_any_text(df, "a.b").collect()] == [1]   # '.' is literal
    assert sorted(r.id for r in explore.filter_any_text(df, "GAMMA").collect()) == [2]
    assert explore.filter_any_text(df, "").count() == 3
    # numbers render like Python's str: 10000000.0, not 1.0E7
    assert [r.id for r in explore.filter_any_text(df, "10000000.0").collect()] == [3]


def test_render_text_matches_python_str(spark):
    vals = [0.1, 1e7, 1e-4, 123.456, 2.0, -955.91, 1e16, -2.5e20, 1.5e-05, 1.234e-07,
            0.00012345678901234567, 123456789.123, 0.0, -0.0, 9999999999999998.0, float("inf")]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(render_text(df, "x")).collect()]
    assert got == [str(v) for v in vals]
    b = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    assert [r[0] for r in b.select(render_text(b, "b")).collect()] == ["True", "False", None]


def test_sort_missing_last_both_ways(spark):
    df = spark.createDataFrame([(2.0,), (None,), (float("nan"),), (1.0,), (3.0,)], "x double")
    asc = [r.x for r in explore.sort_by(df, "x", True).collect()]
    desc = [r.x for r in explore.sort_by(df, "x", False).collect()]
    assert asc[:3] == [1.0, 2.0, 3.0] and desc[:3] == [3.0, 2.0, 1.0]


def test_sort_position_ties_and_nulls(spark):
    df = spark.createDataFrame([(5.0,), (1.0,), (5.0,), (None,), (3.0,)], "x double")
    got = sorted((r.x if r.x is not None else 99.0, r.pos) for r in explore.sort_position(df, "x", False).collect())
    assert got == [(1.0, 4), (3.0, 3), (5.0, 1), (5.0, 1), (99.0, 5)]


def test_next_direction_toggles():
    asc, st = explore.next_direction({}, "a")
    assert asc is True
    asc, st = explore.next_direction(st, "a")
    assert asc is False
    asc, _ = explore.next_direction(st, "b")
    assert asc is True


def test_shape_and_columns(spark):
    df = spark.createDataFrame([(1, "a", 1.0, True, dt.datetime(2024, 1, 1))],
                               "id bigint, s string, x double, b boolean, t timestamp_ntz")
    assert tuple(explore.profile_shape(df).first()) == (1, 5)
    cols = explore.list_columns(df).collect()
    assert [(r.name, r.is_numeric) for r in cols] == [("id", True), ("s", False), ("x", True), ("b", True),
                                                      ("t", False)]


def test_preview_bounded_and_marks_missing(spark):
    df = spark.createDataFrame([(i, None if i % 2 else float(i)) for i in range(10)], "k long, v double")
    out = explore.preview(df, 3, ["k"]).collect()
    assert [(r.k, r.v) for r in out] == [("0", "0.0"), ("1", "NaN"), ("2", "2.0")]


def test_column_stats(spark):
    df = spark.createDataFrame([(1.0, 2), (3.0, 4), (None, 6)], "x double, k int")
    st = {r.column: r for r in explore.column_stats(df).collect()}
    assert st["x"]["count"] == 2 and st["x"]["mean"] == 2.0 and st["x"]["min"] == 1.0
    assert abs(st["k"]["std"] - 2.0) < 1e-12


def test_crosstab_sparse_and_dense(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), (None, "x")], "p string, q string")
    sparse = sorted(tuple(r) for r in explore.crosstab(df, "p", "q").collect())
    assert sparse == [("a", "x", 2), ("b", "y", 1)]
    dense = sorted(tuple(r) for r in explore.crosstab(df, "p", "q", dense=True).collect())
    assert dense == [("a", "x", 2), ("a", "y", 0), ("b", "x", 0), ("b", "y", 1)]


def test_select_prunes_scan(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = explore.select_columns(li.where(F.col("l_quantity") > 10), ["l_orderkey"])._jdf.queryExecution() \
        .executedPlan().toString()
    assert "l_quantity" in plan and "PushedFilters" in plan and "l_comment" not in plan


def test_dense_crosstab_over_many_chunks(spark, monkeypatch):
    """More keys than a chunk holds; an empty table."""
    monkeypatch.setattr(explore, "CHUNK_KEYS", 3)
    df = spark.createDataFrame([(i % 5, f"k{i % 23}") for i in range(60)], "p long, q string")
    dense = {(r.p, r.q): r.n for r in explore.crosstab(df, "p", "q", dense=True).collect()}
    assert len(dense) == 5 * 23 and sum(dense.values()) == 60
    assert all(dense[p, q] == sum(1 for i in range(60) if i % 5 == p and f"k{i % 23}" == q) for p, q in dense)
    assert explore.crosstab(df.limit(0), "p", "q", dense=True).collect() == []
