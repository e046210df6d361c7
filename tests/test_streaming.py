import pytest
from pyspark.sql import functions as F

from quarry.operators import explore
from quarry.streaming import incremental as inc

from conftest import SF_SMALL, rows


def _run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


@pytest.fixture(scope="module")
def events_stream(spark, tmp_path_factory):
    batch = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    folder = str(tmp_path_factory.mktemp("stream") / "events")
    batch.repartition(4).write.parquet(folder)      # a folder of files: the stream source
    return batch, inc.read_stream(spark, folder, batch.schema, max_files_per_trigger=1)


def test_running_stats_equal_batch(spark, events_stream):
    batch, stream = events_stream
    got = _run(inc.running_column_stats(stream, ["value"], by=["event_type"]), "rs", "complete")
    want = explore.column_stats(batch, ["value"], by=["event_type"])
    g = {r.event_type: (r.value_count, round(r.value_mean, 9)) for r in got.collect()}
    w = {r.event_type: (r["count"], round(r.mean, 9)) for r in want.collect()}
    assert g == w


def test_running_crosstab_equals_batch(spark, events_stream):
    batch, stream = events_stream
    with_bucket = stream.withColumn("big", F.col("value") > 50)
    got = _run(inc.running_crosstab(with_bucket, "event_type", "big"), "ct", "complete")
    want = explore.crosstab(batch.withColumn("big", F.col("value") > 50), "event_type", "big")
    assert rows(got) == rows(want)


def test_windowed_series(spark, events_stream):
    batch, stream = events_stream
    got = _run(inc.windowed_line_series(stream, "ts", "value", "1 day", "1 day"), "ws", "append")
    # windows still open at the end of the input are not emitted in append mode
    assert 0 < sum(r.n for r in got.collect()) <= batch.count()


def test_frozen_operators_on_stream(spark, events_stream):
    batch, stream = events_stream
    stats = inc.frozen_statistics(batch, ["value", "user_id"])
    scaled = _run(inc.apply_scaling(stream.select("event_id", "value"), {"value": stats["value"]}), "sc", "append")
    assert abs(scaled.agg(F.avg("value")).first()[0]) < 1e-9
    masked = _run(inc.apply_outlier_mask(stream, {"value": stats["value"]}, 3.0), "om", "append")
    assert masked.where("keep").count() <= batch.count()
    cl = _run(inc.apply_cluster_centres(stream, ["value", "user_id"], [[-1, 0], [1, 0]], stats), "cc", "append")
    assert set(r.cluster for r in cl.collect()) <= {0, 1}
    lm = _run(inc.apply_linear_model(stream, 1.0, {"value": 2.0}), "lm", "append")
    assert lm.where(F.abs(F.col("y_hat") - (1 + 2 * F.col("value"))) > 1e-9).count() == 0


def test_running_ols_equals_batch(spark, events_stream):
    from quarry.operators import regress

    batch, stream = events_stream
    got = {r.event_type: r for r in _run(inc.running_ols(stream, "user_id", "value", ["event_type"]),
                                         "rols", "complete").collect()}
    want = {r.event_type: r for r in regress.ols(batch, "user_id", "value", by=["event_type"]).collect()}
    assert set(got) == set(want)
    for k in got:
        assert got[k].n == want[k].n and abs(got[k].slope - want[k].slope) < 1e-9
