import numpy as np
import pytest

from quarry.operators import cluster, tree


def test_kmeans_planted_clusters_and_canonical_labels(spark):
    rng = np.random.default_rng(0)
    centres = [(0, 0), (10, 10), (20, 0)]
    data = [(i, float(cx + rng.normal()), float(cy + rng.normal()))
            for i, (cx, cy) in enumerate(centres * 100)]
    df = spark.createDataFrame(data, "id long, a double, b double")
    res = cluster.kmeans(df, ["a", "b"], k=3, seed=42)
    labels = {r.id: r.cluster for r in res.labels.collect()}
    # each planted group maps to one cluster, numbered by first coordinate
    for g in range(3):
        assert {labels[i] for i in range(g, 300, 3)} == {g}
    assert res.centres == sorted(res.centres)
    k2 = cluster.kmeans(df, ["a", "b"], k=2, seed=42)
    assert res.cost < k2.cost


def test_kmeans_refuses_missing_and_one_feature(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 3.0)], "a double, b double")
    with pytest.raises(ValueError):
        cluster.kmeans(df, ["a", "b"])
    with pytest.raises(ValueError):
        cluster.kmeans(df, ["a"])


def test_cluster_assign_nearest_centre(spark):
    df = spark.createDataFrame([(0.1, 0.2), (9.0, 9.5), (None, 1.0)], "a double, b double")
    out = [r.cluster for r in cluster.cluster_assign(df, ["a", "b"], [[0, 0], [10, 10]]).collect()]
    assert out == [0, 1, None]


@pytest.mark.parametrize("small", [1, 1000])
def test_xor_needs_a_split_without_gain(spark, small):
    xor = [(0.0, 0.0, 0.0), (0.0, 1.0, 1.0), (1.0, 0.0, 1.0), (1.0, 1.0, 0.0)] * 25
    df = spark.createDataFrame(xor, "a double, b double, y double")
    assert tree.full_tree_accuracy(df, ["a", "b"], "y").first().accuracy == 1.0
    pred, nodes = tree.decision_tree(df, ["a", "b"], "y", small=small)
    assert tree.accuracy(pred, "y", "prediction").first().accuracy == 1.0
    assert nodes.count() == 7 and pred.schema["prediction"].dataType.simpleString() == "double"


def _plain_tree(rows, depth=0, most=None):
    """Every split tried in exact fractions; returns a function of a vector."""
    from collections import Counter
    from fractions import Fraction

    counts = Counter(y for _, y in rows)
    label = min(counts, key=lambda y: (-counts[y], y))
    best = None
    if len(counts) > 1 and (most is None or depth < most):
        for f in range(len(rows[0][0])):
            values = sorted({x[f] for x, _ in rows})
            for low, high in zip(values, values[1:]):
                sides = [Counter(y for x, y in rows if (x[f] <= low) == left) for left in (True, False)]
                score = sum(Fraction(sum(n * n for n in s.values()), sum(s.values())) for s in sides)
                if best is None or score > best[0]:
                    best = (score, f, (low + high) / 2)
    if best is None:
        return lambda x: label
    _, f, cut = best
    left, right = (_plain_tree([r for r in rows if (r[0][f] <= cut) == side], depth + 1, most) for side in (True, False))
    return lambda x: (left if x[f] <= cut else right)(x)


@pytest.mark.parametrize("most", [None, 3])
def test_tree_against_every_split_tried(spark, most):
    """The same tree whether a task finishes it or the distributed search grows it."""
    rng = np.random.default_rng(6)
    rows = [((float(a), float(b) / 4, float(c)), "xyz"[int(k)]) for a, b, c, k in rng.integers(0, [9, 7, 3, 3], size=(150, 4))]
    want = _plain_tree(rows, most=most)
    df = spark.createDataFrame([(*x, y) for x, y in rows], "a double, b double, c double, y string").repartition(5)
    frames = {}
    for small in (70, 10_000):
        pred, nodes = tree.decision_tree(df, ["a", "b", "c"], "y", max_depth=most, small=small)
        assert all(r.prediction == want((r.a, r.b, r.c)) for r in pred.collect()), small
        frames[small] = sorted((r.depth, r.feature or "", r.threshold or 0, r.n, r.prediction) for r in nodes.collect())
        assert {r.parent for r in nodes.collect()} - {None} <= {r.node for r in nodes.collect()}
    assert frames[70] == frames[10_000]
    if most is None:
        exact = tree.full_tree_accuracy(df, ["a", "b", "c"], "y").first().accuracy
        assert tree.accuracy(pred, "y", "prediction").first().accuracy == exact


def test_tree_deeper_than_thirty_and_missing_values(spark):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(200)] + [(None, 1), (3.5, None), (float("nan"), 0)], "x double, y int")
    pred, nodes = tree.decision_tree(df, ["x"], "y", small=197)
    got = pred.collect()
    assert len(got) == 200 and all(r.y == r.prediction for r in got)
    assert nodes.count() == 399 and nodes.agg({"depth": "max"}).first()[0] > 30
    empty, nodes = tree.decision_tree(df.limit(0), ["x"], "y")
    assert empty.collect() == [] == nodes.collect()


def test_tree_learns_separable_target_and_rejects_continuous(spark):
    rng = np.random.default_rng(1)
    data = [(float(x), "hi" if x > 0.3 else "lo") for x in rng.random(200)]
    df = spark.createDataFrame(data, "x double, y string")
    pred, _ = tree.decision_tree(df, ["x"], "y")
    assert tree.accuracy(pred, "y", "prediction").first().accuracy > 0.97
    cont = spark.createDataFrame([(1.0, 0.5), (2.0, 1.5)], "x double, y double")
    with pytest.raises(TypeError):
        tree.decision_tree(cont, ["x"], "y")


def test_full_tree_accuracy_duplicates(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (1.0, "b"), (2.0, "b")], "x double, y string")
    r = tree.full_tree_accuracy(df, ["x"], "y").first()
    assert r.accuracy == 0.75 and r.n_vectors == 2


def test_tree_holdout_scores_unseen_rows(spark):
    rng = np.random.default_rng(2)
    data = [(i, float(x), "hi" if x > 0.5 else "lo") for i, x in enumerate(rng.random(400))]
    df = spark.createDataFrame(data, "id long, x double, y string")
    pred, _ = tree.decision_tree(df, ["x"], "y", holdout=0.3, seed=7)
    n = pred.count()
    assert 60 < n < 180                       # only the held-out share is scored
    assert tree.accuracy(pred, "y", "prediction").first().accuracy > 0.9
