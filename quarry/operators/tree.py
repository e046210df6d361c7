"""Classification: M1 (decision tree), M2 (accuracy), M3 (exact training
accuracy of an unlimited tree).

M1 grows an exact Gini tree: no bins, no limit of depth, and a node that still
mixes classes is split as long as its rows differ in any feature, also where no
split lowers the impurity at once.  Equal rows are one weighted *cell*, and only
cells take part in the growth.

A node with more than ``SMALL`` cells is split by a distributed search, all
such nodes of a level together: each feature's values are put in order, and
running sums (``carried``) over that order give, at every value, the weight on
the left, the sum of its squared class counts and of its products with the
node's class counts, which is all the Gini index of both sides needs.  A node
that has become small is finished by one task with the same arithmetic on the
same whole numbers, so the tree does not depend on where that border lies.

Among equal splits the first feature's smallest value wins, among equal classes
the smallest label.  Features are compared as 32-bit floats, as single-machine
trees do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.columns import as_double, clean_value, require_columns, require_numeric
from quarry.operators._lookup import lookup_join
from quarry.operators._stats import grouped_agg
from quarry.operators.carried import running_sums
from quarry.session import cut_lineage, cuts_of, drop_cuts, ship_package

#: Cells of a node that one task may finish on its own.
SMALL = 20_000


def _check_target(df: DataFrame, y: str) -> None:
    dt = df.schema[y].dataType
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        bad = df.where(F.col(y).isNotNull() & (F.col(y) != F.floor(F.col(y)))).limit(1).count()
        if bad:
            raise TypeError(f"target {y} is continuous: a classifier needs class labels")


def best_split(x: np.ndarray, c: np.ndarray, w: np.ndarray) -> tuple[int, float, float] | None:
    """(feature, largest value on the left, smallest on the right) of the best
    split of cells with classes ``c`` and weights ``w``."""
    total = np.bincount(c, w)
    square, n = float(total @ total), w.sum()
    best, found = -np.inf, None
    for f in range(x.shape[1]):
        by_class = np.lexsort((x[:, f], c))
        cw, cc = w[by_class], c[by_class]
        left = np.cumsum(cw) - cw
        starts = np.nonzero(np.append(True, cc[1:] != cc[:-1]))[0]
        left -= np.repeat(left[starts], np.diff(np.append(starts, len(cc))))       # the class's weight before
        order = np.argsort(x[by_class, f], kind="stable")
        v = x[by_class, f][order]
        at = np.nonzero(np.append(True, v[1:] != v[:-1]))[0]
        if len(at) < 2:
            continue
        nl, ll, tl = (np.add.reduceat(a[order], at).cumsum()[:-1] for a in (cw, cw * (2 * left + cw), cw * total[cc]))
        score = ll / nl + (square - 2 * tl + ll) / (n - nl)
        k = int(score.argmax())
        if score[k] > best:
            best, found = score[k], (f, float(v[at[k]]), float(v[at[k + 1]]))
    return found


def grow(x: np.ndarray, c: np.ndarray, w: np.ndarray, depth: int, max_depth: int | None):
    """The subtree over a node's cells (class -1, weight 0: only routed).
    Returns the class of every cell and the nodes as (number, parent, depth,
    feature, threshold, class, weight)."""
    out, nodes = np.zeros(len(x), np.int64), []
    todo = [(np.arange(len(x)), -1, depth)]
    while todo:
        own, parent, at = todo.pop()
        real = own[w[own] > 0]
        counts = np.bincount(c[real], w[real])
        number, label = len(nodes), int(counts.argmax())
        split = None
        if np.count_nonzero(counts) > 1 and (max_depth is None or at < max_depth):
            split = best_split(x[real], c[real], w[real])
        f, low, high = split or (None, None, None)
        nodes.append((number, parent, at, f, None if f is None else (low + high) / 2, label, float(counts.sum())))
        if f is None:
            out[own] = label
        else:
            side = x[own, f] <= (low + high) / 2
            todo += [(own[~side], number, at + 1), (own[side], number, at + 1)]
    return out, nodes


def _search(rows: DataFrame, names: list[str]) -> DataFrame:
    """``node, f, low``: the best split of every node of ``rows``, all at once."""
    real = rows.where("w > 0")
    totals = real.groupBy("node", "y").agg(F.sum("w").alias("all_w"))
    values = F.posexplode(F.array(*names)).alias("f", "v")
    counts = real.select("node", "y", "w", values).groupBy("node", "f", "v", "y").agg(F.sum("w").alias("w"))
    counts = running_sums(lookup_join(counts, totals, ["node", "y"]), ["node", "f", "y"], ["v"], {"before": F.col("w")}, inclusive=False)
    w = F.col("w")
    per_value = counts.groupBy("node", "f", "v").agg(
        F.sum(w).alias("n"), F.sum(w * (2 * F.col("before") + w)).alias("ll"), F.sum(w * F.col("all_w")).alias("tl"))
    left = running_sums(per_value, ["node", "f"], ["v"], {"nl": F.col("n"), "sl": F.col("ll"), "st": F.col("tl")})
    whole = totals.groupBy("node").agg(F.sum("all_w").alias("all_n"), F.sum(F.col("all_w") * F.col("all_w")).alias("square"))
    nl, sl, st = F.col("nl"), F.col("sl"), F.col("st")
    scored = lookup_join(left, whole, ["node"]).where(nl < F.col("all_n")).select(
        "node", F.struct((sl / nl + (F.col("square") - 2 * st + sl) / (F.col("all_n") - nl)).alias("score"),
                         (-F.col("f")).alias("f"), (-F.col("v")).alias("v")).alias("s"))
    best = scored.groupBy("node").agg(F.max("s").alias("s")).select("node", (-F.col("s.f")).alias("f"), (-F.col("s.v")).alias("low"))
    # the threshold lies half way to the next value
    here = F.get(F.array(*names), F.col("f"))
    high = lookup_join(real, best, ["node"]).where(here > F.col("low")).groupBy("node").agg(F.min(here).alias("high"))
    return cut_lineage(lookup_join(best, high, ["node"]))


def _finish(rows: DataFrame, names: list[str], label_type: str, max_depth: int | None) -> DataFrame:
    """Nodes and cells of all small nodes of ``rows``, a task at a time."""
    ship_package(rows.sparkSession)
    fields = ", ".join(f"{n} double" for n in names)

    def run(table: pa.Table) -> pa.Table:
        y = table.column("y").combine_chunks()
        kinds = pc.unique(y.drop_null())
        kinds = kinds.take(pc.sort_indices(kinds))
        c = pc.fill_null(pc.index_in(y, kinds), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        x = np.column_stack([table.column(n).to_numpy() for n in names])
        path = table.column("node")[0].as_py()
        labels, nodes = grow(x, c, table.column("w").to_numpy(), len(path), max_depth)

        def name(k: int) -> str | None:
            return (path[:-1] if path else None) if k < 0 else path if k == 0 else f"{path}:{k}"

        n, m = len(nodes), len(x)
        number, parent, depth, feature, threshold, label, weight = zip(*nodes, strict=True)
        text, none = pa.string(), [None] * m
        return pa.table({
            "node": pa.array([name(k) for k in number] + none, text), "parent": pa.array([name(k) for k in parent] + none, text),
            "depth": pa.array([*depth, *none], pa.int32()), "f": pa.array([*feature, *none], pa.int32()),
            "threshold": pa.array([*threshold, *none], pa.float64()), "n": pa.array([*weight, *none], pa.float64()),
            "prediction": kinds.take(pa.array(np.concatenate([np.array(label, np.int64), labels]))),
            **{c: pa.array(np.concatenate([np.full(n, np.nan), x[:, k]])) for k, c in enumerate(names)}})

    return rows.groupBy("node").applyInArrow(
        run, f"node string, parent string, depth int, f int, threshold double, n double, prediction {label_type}, {fields}")


def decision_tree(df: DataFrame, xs: list[str], y: str, max_depth: int | None = None, holdout: float = 0.0, seed: int = 42,
                  out: str = "prediction", small: int = SMALL):
    """M1: fit a Gini decision tree of ``y`` on ``xs``; returns
    ``(predictions, nodes)``.  Predictions are the input rows (or the held-out
    rows when ``holdout`` > 0) plus ``out`` in the label's own values; nodes are
    ``(node, parent, depth, feature, threshold, n, prediction)``, without
    feature in a leaf.  Rows with a missing feature or label are left out."""
    if not xs:
        raise ValueError("select at least one feature")
    require_numeric(df, xs)
    require_columns(df, [y])
    _check_target(df, y)
    spark = df.sparkSession
    label_type = df.schema[y].dataType.simpleString()
    names = [f"__x{i}" for i in range(len(xs))]
    data = df.select("*", *[(as_double(df, c).cast("float").cast("double") + F.lit(0.0)).alias(n) for c, n in zip(xs, names, strict=True)],
                     clean_value(df, y).alias("__y")).dropna(subset=[*names, "__y"])
    test = data
    train = data
    if holdout > 0:
        marked = data.withColumn("__test", F.rand(seed) < holdout)
        train, test = marked.where(~F.col("__test")), marked.where("__test").drop("__test")
    before = cuts_of(spark)
    rows = train.groupBy(*names, F.col("__y").alias("y")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    if holdout > 0:                                   # held-out cells are routed along
        rows = rows.unionByName(test.select(*names).distinct().select("*", F.lit(None).cast(label_type).alias("y"), F.lit(0.0).alias("w")))
    rows = cut_lineage(rows.withColumn("node", F.lit("")))
    real = F.when(F.col("w") > 0, F.lit(True))
    finished = []
    while True:
        differ = F.lit(False)
        for c in names:
            differ = differ | (F.min(F.when(real, F.col(c))) < F.max(F.when(real, F.col(c))))
        stats = rows.groupBy("node").agg(
            F.count(F.lit(1)).alias("cells"), (F.min("y") < F.max("y")).alias("mixed"), differ.alias("differ"))
        deep = F.lit(False) if max_depth is None else F.length("node") >= max_depth
        kind = (F.when(F.col("cells") <= small, "small").when(F.col("mixed") & F.col("differ") & ~deep, "large").otherwise("leaf"))
        tagged = cut_lineage(lookup_join(rows, stats.select("node", kind.alias("kind")), ["node"]))
        finished.append(_finish(tagged.where("kind = 'small'"), names, label_type, max_depth))
        leaves = tagged.where("kind = 'leaf'")
        votes = leaves.where("w > 0").groupBy("node", "y").agg(F.sum("w").alias("w")).groupBy("node").agg(
            F.min_by("y", F.struct(-F.col("w"), F.col("y"))).alias("prediction"), F.sum("w").alias("n"))
        finished.append(lookup_join(leaves.select("node", *names).distinct(), votes.drop("n"), ["node"]).select("prediction", *names))
        finished.append(votes.select("node", *_place(), "n", "prediction"))
        large = tagged.where("kind = 'large'").drop("kind")
        if large.isEmpty():
            break
        best = _search(large, names)
        votes = large.where("w > 0").groupBy("node", "y").agg(F.sum("w").alias("w")).groupBy("node").agg(
            F.min_by("y", F.struct(-F.col("w"), F.col("y"))).alias("prediction"), F.sum("w").alias("n"))
        finished.append(lookup_join(votes, best, ["node"]).select(
            "node", *_place(), F.col("f").cast("int").alias("f"), ((F.col("low") + F.col("high")) / 2).alias("threshold"), "n", "prediction"))
        side = F.when(F.get(F.array(*names), F.col("f")) <= F.col("low"), "L").otherwise("R")
        rows = cut_lineage(lookup_join(large, best, ["node"]).withColumn("node", F.concat("node", side)).drop("f", "low", "high"))
    whole = finished[0]
    for part in finished[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    whole = cut_lineage(whole)
    drop_cuts(spark, [p for p in cuts_of(spark)[:-1] if p not in before])
    labels = whole.where("node is null").select(*names, F.col("prediction").alias("__label")).dropDuplicates(names)
    keep = [F.col(c) for c in df.columns]
    predictions = lookup_join(test, labels, names).select(*keep, F.col("__label").alias(out))
    feature = F.get(F.array(*[F.lit(c) for c in xs]), F.col("f"))
    nodes = whole.where("node is not null").select("node", "parent", "depth", feature.alias("feature"), "threshold", F.col("n").cast("bigint").alias("n"), "prediction")
    return predictions, nodes


def _place():
    """A node's parent and depth, from its path."""
    path = F.col("node")
    return F.when(path != "", F.expr("substring(node, 1, length(node) - 1)")).alias("parent"), F.length(path).cast("int").alias("depth")


def accuracy(df: DataFrame, label: str, prediction: str, by: list[str] | None = None) -> DataFrame:
    """M2: share of rows whose prediction equals the label, ``(by..., accuracy, n)``."""
    require_columns(df, [label, prediction])
    hit = F.coalesce((F.col(label) == F.col(prediction)), F.lit(False)).cast("double")
    return grouped_agg(df, by, [F.avg(hit).alias("accuracy"), F.count(F.lit(1)).cast("bigint").alias("n")])


def full_tree_accuracy(df: DataFrame, xs: list[str], y: str) -> DataFrame:
    """M3: training accuracy of an unlimited tree without a model, ``(accuracy,
    n, n_vectors)``: such a tree separates all distinct feature vectors, so it
    is the sum of each vector's largest class count, divided by n.  Features
    are compared as float32, as single-machine trees do."""
    require_numeric(df, xs)
    require_columns(df, [y])
    feats = [as_double(df, c).cast("float").alias(f"__x{i}") for i, c in enumerate(xs)]
    names = [f"__x{i}" for i in range(len(xs))]
    base = df.select(*feats, clean_value(df, y).alias("__y")).dropna()
    per_class = base.groupBy(*names, "__y").agg(F.count(F.lit(1)).alias("__c"))
    per_vector = per_class.groupBy(*names).agg(F.max("__c").alias("__best"), F.sum("__c").alias("__n"))
    return per_vector.agg((F.sum("__best") / F.sum("__n")).alias("accuracy"),
                          F.sum("__n").cast("bigint").alias("n"),
                          F.count(F.lit(1)).cast("bigint").alias("n_vectors"))
