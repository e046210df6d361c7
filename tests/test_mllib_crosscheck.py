"""Second opinions from MLlib on numbers our SQL-form operators compute."""

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Correlation
from pyspark.sql import functions as F

from quarry.operators import correlate, hypothesis, regress

from conftest import SF_MID


def test_spearman_equals_mllib_on_complete_data(spark):
    li = spark.read.parquet(f"{SF_MID}/lineitem.parquet")
    cols = ["l_quantity", "l_discount", "l_tax"]
    ours = {(r.var_a, r.var_b): r.r for r in correlate.correlation(li, cols, "spearman").collect()}
    vec = VectorAssembler(inputCols=cols, outputCol="v").transform(li).select("v")
    m = Correlation.corr(vec, "v", "spearman").first()[0].toArray()
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            assert abs(ours[(a, b)] - m[i, j]) < 1e-9


def test_ols_standard_error_and_p_equal_mllib(spark):
    part = spark.read.parquet(f"{SF_MID}/part.parquet")
    ours = regress.ols(part, "p_partkey", "p_retailprice").first()
    vec = VectorAssembler(inputCols=["p_partkey"], outputCol="v").transform(part)
    s = LinearRegression(featuresCol="v", labelCol="p_retailprice", solver="normal").fit(vec).summary
    assert abs(ours.slope_se - s.coefficientStandardErrors[0]) < 1e-9 * max(1.0, ours.slope_se)
    assert abs(ours.slope_t - s.tValues[0]) < 1e-6 * max(1.0, abs(ours.slope_t))
    assert abs(ours.slope_p - s.pValues[0]) < 1e-9


def test_pooled_t_equals_regression_on_group_indicator(spark):
    li = spark.read.parquet(f"{SF_MID}/lineitem.parquet").where(F.col("l_returnflag").isin("A", "R"))
    ours = hypothesis.ttest_groups(li, "l_quantity", "l_returnflag", "R", "A").first()
    g = li.withColumn("g", (F.col("l_returnflag") == "R").cast("double"))
    vec = VectorAssembler(inputCols=["g"], outputCol="v").transform(g)
    s = LinearRegression(featuresCol="v", labelCol="l_quantity", solver="normal").fit(vec).summary
    assert abs(ours.t - s.tValues[0]) < 1e-6 and abs(ours.p - s.pValues[0]) < 1e-9


def test_results_unchanged_by_partitioning(spark):
    li = spark.read.parquet(f"{SF_MID}/lineitem.parquet").select("l_quantity", "l_extendedprice", "l_discount")
    a = regress.ols(li, "l_quantity", "l_extendedprice").first()
    b = regress.ols(li.repartition(13), "l_quantity", "l_extendedprice").first()
    assert abs(a.slope - b.slope) < 1e-9 and a.n == b.n
    ra = {(r.var_a, r.var_b): r.r for r in correlate.correlation(li, li.columns, "spearman").collect()}
    rb = {(r.var_a, r.var_b): r.r for r in correlate.correlation(li.repartition(5), li.columns, "spearman").collect()}
    assert all(abs(ra[k] - rb[k]) < 1e-12 for k in ra)
    assert np.isfinite(list(ra.values())).all()
