import math

import pytest
from pyspark.sql import functions as F

from quarry.operators import clean

XY = "x double, y double"


def test_drop_missing_counts_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0, 1.0), (float("nan"), 2.0), (None, 3.0), (3.0, None), (4.0, 4.0)], XY)
    assert sorted(r.x for r in clean.drop_missing(df).collect()) == [1.0, 4.0]
    assert sorted(r.y for r in clean.drop_missing(df, ["x"]).collect() if r.y is not None) == [1.0, 4.0]


def test_missing_counts(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "c")], "x double, s string")
    got = {r["column"]: r["n_missing"] for r in clean.missing_counts(df).collect()}
    assert got == {"x": 2, "s": 1}


def test_fill_mean_skips_missing_and_keeps_all_missing(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (None, None), (3.0, None)], XY)
    out = clean.fill_mean(df).collect()
    assert sorted(r.x for r in out) == [1.0, 2.0, 2.0, 3.0]
    assert all(r.y is None for r in out)


def test_fill_mean_casts_ints_to_double(spark):
    df = spark.createDataFrame([(1,), (None,), (4,)], "k int")
    assert sorted(r.k for r in clean.fill_mean(df).collect()) == [1.0, 2.5, 4.0]


def test_standardize_properties(spark):
    vals = [1.0, 2.0, 4.0, 8.0, 16.0]
    df = spark.createDataFrame([(v, "s") for v in vals], "x double, label string")
    out = clean.standardize(df)
    assert out.schema["label"].dataType.simpleString() == "string"  # strings pass through
    st = out.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).first()
    assert abs(st.m) < 1e-12 and abs(st.s - 1.0) < 1e-12


def test_normalize_range(spark):
    df = spark.createDataFrame([(v,) for v in [3.0, -2.0, 7.5, 0.0]], "x double")
    xs = [r.x for r in clean.normalize(df).collect()]
    assert min(xs) == 0.0 and max(xs) == 1.0


def test_constant_column_scales_to_null_not_error(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], XY)
    assert all(r.x is None for r in clean.standardize(df).collect())
    assert all(r.x is None for r in clean.normalize(df).collect())
    assert all(r.x == 0.0 for r in clean.zscore_population(df).collect())


def test_one_row_and_empty(spark):
    one = spark.createDataFrame([(1.0, 2.0)], XY)
    assert clean.standardize(one).first().x is None   # sample std of one row is missing
    empty = spark.createDataFrame([], XY)
    assert clean.standardize(empty).count() == 0
    assert clean.fill_mean(empty).count() == 0


def test_zscore_population_uses_population_std(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    assert sorted(r.x for r in clean.zscore_population(df).collect()) == [-1.0, 1.0]


def test_preprocess_uses_statistics_after_null_step(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    out = sorted(r.x for r in clean.preprocess(df, "mean", "standardize").collect())
    # after the fill: 1, 2, 3 → sample std 1
    assert out == [-1.0, 0.0, 1.0]
    out = sorted(r.x for r in clean.preprocess(df, "drop", "normalize").collect())
    assert out == [0.0, 1.0]
    with pytest.raises(ValueError):
        clean.preprocess(df, "bogus")


def test_by_group_scaling(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0), ("b", 30.0), (None, 5.0), (None, 7.0)],
                               "g string, x double")
    out = {(r.g, r.x) for r in clean.normalize(df, ["x"], by=["g"]).collect()}
    assert out == {("a", 0.0), ("a", 1.0), ("b", 0.0), ("b", 1.0), (None, 0.0), (None, 1.0)}


def test_nan_propagation_rule(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    out = [r.x for r in clean.fill_mean(df).collect()]
    assert sorted(out) == [1.0, 2.0, 3.0] and not any(math.isnan(v) for v in out)
