"""Clustering: C1 (population z-score, in ``clean``), C2 (K-Means), C3
(scatter data), C4 (nearest-centre assignment).

K-Means runs on MLlib (k-means‖ initialisation, distributed Lloyd
iterations); the assembled input is persisted for the iterations and
released afterwards.  Labels are arbitrary in any K-Means, so they are
renumbered canonically: by ascending first centre coordinate (then the
next coordinates).  C4 assigns rows to *given* centres with plain Catalyst
expressions (k distance expressions and a minimum), so it is exactly
reproducible and checked against SQL.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add, and_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import as_double, require_numeric
from quarry.operators.clean import assert_complete, zscore_population
from quarry.session import cut_lineage


@dataclass
class KMeansResult:
    labels: DataFrame          # input rows + scaled features + ``cluster``
    centres: list[list[float]]  # canonical order: index = cluster label
    cost: float
    features: list[str]


def _canonical(centres: list[list[float]]) -> list[int]:
    """old label → new label, ordering centres by their coordinates."""
    order = sorted(range(len(centres)), key=lambda i: tuple(centres[i]))
    return {old: new for new, old in enumerate(order)}


def assign_expr(features: list[Column], centres: list[list[float]]) -> Column:
    """Index of the nearest centre (squared Euclidean; ties to the lower
    index) as a Catalyst expression."""
    dists = []
    for i, c in enumerate(centres):
        d = None
        for f, v in zip(features, c):
            term = F.pow(f - F.lit(float(v)), 2)
            d = term if d is None else d + term
        dists.append(F.struct(d.alias("d"), F.lit(i).alias("i")))
    return F.array_min(F.array(*dists))["i"]


def cluster_assign(df: DataFrame, cols: list[str], centres: list[list[float]],
                   out: str = "cluster") -> DataFrame:
    """C4: label each row with its nearest given centre (rows with a missing
    feature get null)."""
    require_numeric(df, cols)
    feats = [as_double(df, c) for c in cols]
    present = None
    for f in feats:
        present = f.isNotNull() if present is None else present & f.isNotNull()
    return df.withColumn(out, F.when(present, assign_expr(feats, centres)))


def cluster_assign_table(df: DataFrame, cols: list[str], centres: DataFrame, id_col: str = "cluster",
                         out: str = "cluster") -> DataFrame:
    """C4 with centres given as a DataFrame ``(id_col, cols...)``: one array of
    them, read as a scalar subquery; ties go to the lower id."""
    require_numeric(df, cols)
    point = F.struct(F.col(id_col).alias("id"), *[as_double(centres, c).alias(f"c{i}") for i, c in enumerate(cols)])
    all_centres = centres.agg(F.sort_array(F.collect_list(point))).scalar()
    feats = [as_double(df, c) for c in cols]
    present = reduce(and_, [f.isNotNull() for f in feats])

    def distance(centre: Column) -> Column:
        return reduce(add, [F.pow(f - centre[f"c{i}"], 2) for i, f in enumerate(feats)])

    near = F.array_min(F.transform(F.col("__centres"), lambda x: F.struct(distance(x).alias("d"), x["id"].alias("id"))))["id"]
    return df.withColumn("__centres", all_centres).select(*df.columns, F.when(present, near).alias(out))


def lloyd_steps(df: DataFrame, cols: list[str], centres: DataFrame, steps: int, id_col: str = "cluster") -> DataFrame:
    """C2 from given centres ``(id_col, cols...)``: after ``steps`` rounds of
    assignment and averaging, the centres as ``(id_col, cols...)``.  A centre
    without rows stays where it is."""
    for _ in range(steps):
        near = cluster_assign_table(df.select(*cols), cols, centres, id_col, "__near").filter(F.col("__near").isNotNull())
        moved = near.groupBy(F.col("__near").alias(id_col)).agg(*[F.avg(as_double(df, c)).alias(f"__n_{c}") for c in cols])
        centres = cut_lineage(centres.join(moved, id_col, "left").select(
            id_col, *[F.coalesce(F.col(f"__n_{c}"), F.col(c)).alias(c) for c in cols]))
    return centres


def kmeans(df: DataFrame, cols: list[str] | None = None, k: int = 3, seed: int = 42, n_init: int = 1,
           max_iter: int = 300, scale: bool = True, vector_col: str | None = None,
           tol: float = 1e-4) -> KMeansResult:
    """K-Means on ``cols`` (at least two numeric columns), or on an array
    column ``vector_col``.  Features are z-scored with the population std
    (C1) first when ``scale``.  Refuses missing values.  ``n_init`` runs with
    seeds seed, seed+1, ... and keeps the lowest cost."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    if vector_col is None:
        if not cols or len(cols) < 2:
            raise ValueError("select at least two features")
        require_numeric(df, cols)
        assert_complete(df, cols)
        data = zscore_population(df, cols) if scale else df
        feats = data.select("*", *[as_double(data, c).alias(f"__f{i}") for i, c in enumerate(cols)])
        vec = VectorAssembler(inputCols=[f"__f{i}" for i in range(len(cols))], outputCol="__vec").transform(feats)
        names = list(cols)
    else:
        data = df
        vec = df.withColumn("__vec", array_to_vector(F.col(vector_col)))
        names = [vector_col]
    vec = vec.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        best = None
        for run in range(max(1, n_init)):
            model = KMeans(k=k, seed=seed + run, maxIter=max_iter, tol=tol, featuresCol="__vec",
                           predictionCol="__pred").fit(vec)
            cost = model.summary.trainingCost
            if best is None or cost < best[1]:
                best = (model, cost)
        model, cost = best
        centres = [list(map(float, c)) for c in model.clusterCenters()]
    finally:
        vec.unpersist()
    mapping = _canonical(centres)
    ordered = [None] * len(centres)
    for old, new in mapping.items():
        ordered[new] = centres[old]
    remap = F.create_map(*[x for old, new in mapping.items() for x in (F.lit(old), F.lit(new))])
    labelled = model.transform(vec.drop("__pred")).withColumn("cluster", remap[F.col("__pred")])
    keep = [c for c in labelled.columns if not c.startswith("__")]
    return KMeansResult(labelled.select(*keep), ordered, float(cost), names)


def cluster_scatter(result: KMeansResult) -> DataFrame:
    """The scaled features and the label as text, ready for a scatter."""
    cols = [c for c in result.features]
    return result.labels.select(*cols, F.col("cluster").cast("string").alias("cluster"))


def centres_frame(result: KMeansResult, spark) -> DataFrame:
    """The fitted centres as a DataFrame ``(cluster, features...)``."""
    rows = [(i, *c) for i, c in enumerate(result.centres)]
    names = result.features if len(result.features) == len(result.centres[0]) else [
        f"c{j}" for j in range(len(result.centres[0]))]
    return spark.createDataFrame(rows, ["cluster", *names])
