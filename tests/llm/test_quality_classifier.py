"""The boosted-tree classifier: held-out accuracy, plain traversal, edges."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import quality_classifier as qc

from .fixtures import empty, messy, messy_rows

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def out(docs, labels, **options):
    return {r["doc_id"]: tuple(r)[1:] for r in qc.classify(docs, labels, **options).collect()}


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = out(docs, labels)
    held = [r for r in labels.collect() if got[r["doc_id"]][0]]
    right = sum(got[r["doc_id"]][2] == r["quality"] for r in held)
    good = [got[r["doc_id"]][1] for r in held if r["quality"]]
    bad = [got[r["doc_id"]][1] for r in held if not r["quality"]]
    assert len(held) > 50 and right / len(held) >= 0.95
    assert np.mean([[a > b for b in bad] for a in good]) >= 0.99        # area under the curve
    assert np.mean([s >= 0.3 for s in good]) >= 0.98                    # clean documents stay
    assert len(got) == docs.count()


def test_held_out_labels_are_never_learnt(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert out(docs, labels) == out(docs, turned)
    others = docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("x")})
    assert out(docs, labels) == out(others, labels)
    got = out(docs, labels)
    assert all(v[0] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, v in got.items())


def test_forest_against_plain_walk():
    r = np.random.default_rng(3)
    x = r.normal(size=(900, len(qc.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = qc.fit(x[:600], y[:600])
    assert ((forest.scores(x[600:]) > 0.5) == y[600:]).mean() > 0.9
    for row, s in zip(x[600:640], forest.scores(x[600:640]), strict=True):
        total = forest.prior
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += leaf[node - len(f)]
        assert s == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-12)


def test_splits_of_a_histogram_are_the_best_ones():
    """One stump on few values against every split tried."""
    r = np.random.default_rng(4)
    x = r.integers(0, 6, size=(200, len(qc.FEATURES))).astype(float)
    y = (r.random(200) < 0.2 + 0.1 * x[:, 2]).astype(float)
    forest = qc.fit(x, y, trees=1, depth=1)
    share = (y.sum() + 0.5) / 201
    g, h = y - share, np.full(200, share * (1 - share))

    def gain(f, t):
        left = x[:, f] <= t
        if min(h[left].sum(), h[~left].sum()) < qc.LEAST_CURVATURE:
            return -1
        return sum(g[m].sum() ** 2 / (h[m].sum() + qc.RIDGE) for m in (left, ~left))

    best = max(gain(f, t) for f in range(x.shape[1]) for t in range(6))
    assert gain(forest.feature[0, 0], forest.threshold[0, 0]) == pytest.approx(best)


def test_statistics():
    row = dict(zip(qc.FEATURES, qc.statistics("Ab ab ab, x1!\nab ab\n\nab ab".encode()), strict=True))
    assert row["log_words"] == pytest.approx(np.log(9)) and row["distinct_words"] == 4 / 8
    assert row["same_as_previous"] == 3 / 8 and row["distinct_pairs"] == 5 / 7 and row["repeated_lines"] == 1 / 3
    assert row["top_word"] == 5 / 8 and row["upper"] == 1 / 18 and row["digit"] == 1 / 18 and row["bang"] == 1 / 18
    assert qc.statistics(b"") == [0.0] * len(qc.FEATURES)


def test_long_texts_go_by_slices(monkeypatch):
    text = ("one two three four five.\n" * 4_000).encode()
    whole = qc.statistics(text)
    monkeypatch.setattr(qc, "SLICE", 2_500)
    sliced = dict(zip(qc.FEATURES, qc.statistics(text), strict=True))
    for k in ("log_words", "mean_word", "lower", "stop", "top_word"):
        assert sliced[k] == pytest.approx(whole[qc.FEATURES.index(k)], rel=1e-9)


def test_messy_rows_and_labels(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, 1, 0), (3, 0, None), (None, 1, 0), (7, None, 0), (9999, 1, 0)], LABELS)
    rows = qc.classify(messy(spark), labels).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in rows) == sorted((r[0] is not None, r[0] or 0) for r in messy_rows())
    assert all(0 < r["score"] < 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] for r in rows if r["doc_id"] is None)
    same = {r["score"] for r in rows if r["doc_id"] in (100, 101)}
    assert len(same) == 1                                              # null and empty texts
    assert qc.classify(empty(spark), labels).collect() == []


def test_without_labels_or_with_one_kind(spark):
    none = spark.createDataFrame([], LABELS)
    assert {v[1] for v in out(messy(spark), none).values()} == {0.5}
    ones = spark.createDataFrame([(i, 1, 0) for i in range(30)], LABELS)
    scores = {v[1] for v in out(messy(spark), ones).values()}
    assert len(scores) == 1 and min(scores) > 0.9


def test_sample_bound(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    stats = qc.with_statistics(docs).cache()
    small = qc.fit_on_labels(stats, labels, sample=150)
    got = {r["doc_id"]: r["predicted"] for r in qc.score(stats, small).collect()}
    assert np.mean([got[r["doc_id"]] == r["quality"] for r in labels.collect()]) > 0.9
