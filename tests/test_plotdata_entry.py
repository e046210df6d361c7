import numpy as np

from quarry.operators import plotdata

from conftest import SF_SMALL


def test_bins_cover_every_row(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rng.normal(size=(500, 2))] + [(None, 1.0)],
                               "x double, y double")
    b = plotdata.scatter_bins(df, ["x", "y"], 10).collect()
    assert sum(r.n for r in b) == 500
    assert all(0 <= r.b0 < 10 and 0 <= r.b1 < 10 and r.lo0 <= r.hi0 for r in b)


def test_line_series_and_report(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    ls = plotdata.line_series(ev, "ts", "value", "day")
    assert sum(r.n for r in ls.collect()) == ev.count()
    rep = {(r.section, r.name, r.metric): r.value for r in plotdata.analysis_report(ev).collect()}
    assert rep[("shape", "table", "n_rows")] == ev.count() and rep[("missing", "props", "n_missing")] == 0


def test_entry_contract(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.count() == 1 and "slope" in out.columns
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 70


def test_report_written_as_parquet_and_csv(spark):
    from quarry.sources.files import read_csv, scratch_path

    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    rep = plotdata.analysis_report(ev, ["value", "event_type"])
    p = plotdata.write_report(rep, scratch_path(spark, "report"))
    assert spark.read.parquet(p).count() == rep.count()
    c = plotdata.write_report(rep, scratch_path(spark, "report_csv"), "csv")
    back = {(r.section, r.name, r.metric): r.value for r in read_csv(spark, c).collect()}
    assert back[("shape", "table", "n_rows")] == ev.count()


def test_report_reads_once_and_holds_results(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    fit = spark.createDataFrame([("a", "u", 1.5, 3, True), (None, "v", None, 4, False)], "g string, h string, slope double, n long, ok boolean")
    rep = plotdata.analysis_report(ev, ["value", "event_type"])
    assert rep._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {(r.section, r.name, r.metric): r.value for r in plotdata.analysis_report(ev, ["value"], {"fit": fit}).collect()}
    assert got["fit", "a u", "slope"] == 1.5 and got["fit", " v", "n"] == 4.0 and got["fit", "a u", "ok"] == 1.0
    assert got["fit", " v", "slope"] is None and got["shape", "table", "n_cols"] == 1.0


def test_report_of_rows_that_pass(spark, tmp_path):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").selectExpr("event_id", "if(event_id % 7 = 0, null, value) AS value", "event_type")
    frame, report = plotdata.observed_report(ev)
    frame.write.parquet(f"{tmp_path}/out")
    seen = {tuple(r)[:3]: r.value for r in report().collect()}
    want = {tuple(r)[:3]: r.value for r in plotdata.analysis_report(ev).collect()}
    assert set(seen) == set(want) and all(abs(seen[k] - want[k]) < 1e-9 * (1 + abs(want[k])) for k in want)
