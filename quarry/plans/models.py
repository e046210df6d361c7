"""Registered queries: clustering (C2-C4) and classification (M1-M3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import clean, cluster, tree
from quarry.plans.registry import register, rounded, table

_CUST = ["c_acctbal", "c_nationkey"]
_SEGMENTS_SQL = """
WITH s AS (SELECT avg(c_acctbal) ma, stddev_pop(c_acctbal) sa, avg(c_nationkey) mn, stddev_pop(c_nationkey) sn FROM customer),
z AS (SELECT c_custkey, c_mktsegment, (c_acctbal - ma) / sa AS za, (c_nationkey - mn) / sn AS zn FROM customer CROSS JOIN s),
c AS (SELECT c_mktsegment AS seg, avg(za) AS ca, avg(zn) AS cn FROM z GROUP BY 1)
SELECT c_custkey, arg_min(seg, power(za - ca, 2) + power(zn - cn, 2)) AS cluster
FROM z CROSS JOIN c GROUP BY c_custkey"""


@register("cluster_assign", sql=_SEGMENTS_SQL)
def cluster_assign(spark, sf):
    """C4 with centres derived from the data: the mean of the scaled features
    of each market segment; each customer gets the nearest segment centre."""
    z = clean.zscore_population(table(spark, sf, "customer"), _CUST)
    centres = z.groupBy(F.col("c_mktsegment").alias("cluster")).agg(
        *[F.avg(c).alias(c) for c in _CUST])
    return cluster.cluster_assign_table(z, _CUST, centres).select("c_custkey", "cluster")


def _lloyd_sql(steps: int) -> str:
    """The same rounds in SQL, from the segment means."""
    ctes, prev = [], "c0"
    for k in range(1, steps + 1):
        ctes.append(f"""
a{k} AS (SELECT any_value(za) AS za, any_value(zn) AS zn, arg_min(seg, power(za - ca, 2) + power(zn - cn, 2)) AS seg
        FROM z CROSS JOIN {prev} GROUP BY c_custkey),
m{k} AS (SELECT seg, avg(za) AS ca, avg(zn) AS cn FROM a{k} GROUP BY 1),
c{k} AS (SELECT o.seg, coalesce(m.ca, o.ca) AS ca, coalesce(m.cn, o.cn) AS cn FROM {prev} o LEFT JOIN m{k} m USING (seg))""")
        prev = f"c{k}"
    return f"""
WITH s AS (SELECT avg(c_acctbal) ma, stddev_pop(c_acctbal) sa, avg(c_nationkey) mn, stddev_pop(c_nationkey) sn FROM customer),
z AS (SELECT c_custkey, c_mktsegment, (c_acctbal - ma) / sa AS za, (c_nationkey - mn) / sn AS zn FROM customer CROSS JOIN s),
c0 AS (SELECT c_mktsegment AS seg, avg(za) AS ca, avg(zn) AS cn FROM z GROUP BY 1),{",".join(ctes)}
SELECT seg AS cluster, round(ca, 6) + 0.0 AS c_acctbal, round(cn, 6) + 0.0 AS c_nationkey FROM {prev}"""


@register("kmeans_lloyd", sql=_lloyd_sql(4))
def kmeans_lloyd(spark, sf):
    """C2 from fixed start centres, the scaled segment means: four rounds."""
    z = clean.zscore_population(table(spark, sf, "customer"), _CUST)
    start = z.groupBy(F.col("c_mktsegment").alias("cluster")).agg(*[F.avg(c).alias(c) for c in _CUST])
    return rounded(cluster.lloyd_steps(z, _CUST, start, 4))


@register("kmeans")
def kmeans(spark, sf):
    res = cluster.kmeans(table(spark, sf, "customer"), _CUST, k=3, seed=42)
    return res.labels.select("c_custkey", "cluster")


@register("kmeans_embeddings")
def kmeans_embeddings(spark, sf):
    """K-Means on the embedding vectors, k = number of planted labels."""
    emb = table(spark, sf, "embeddings")
    res = cluster.kmeans(emb, vector_col="embedding", k=10, seed=42, scale=False)
    return res.labels.select("vec_id", "label", "cluster")


@register("cluster_scatter")
def cluster_scatter(spark, sf):
    return cluster.cluster_scatter(cluster.kmeans(table(spark, sf, "customer"), _CUST, k=3, seed=42))


# An unlimited tree gives every distinct vector its most frequent label, the
# smallest one of several.
_TREE_SQL = """
WITH c AS (SELECT CAST(l_quantity AS FLOAT) AS a, CAST(l_discount AS FLOAT) AS b, l_returnflag AS y, count(*) AS n FROM lineitem GROUP BY ALL),
v AS (SELECT a, b, arg_min(y, (-n, y)) AS prediction FROM c GROUP BY a, b),
p AS (SELECT l_orderkey, l_linenumber, l_returnflag, prediction FROM lineitem JOIN v ON a = CAST(l_quantity AS FLOAT) AND b = CAST(l_discount AS FLOAT))"""


@register("decision_tree", headline=True, sql=_TREE_SQL + "SELECT * FROM p")
def decision_tree(spark, sf):
    pred, _ = tree.decision_tree(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_returnflag")
    return pred.select("l_orderkey", "l_linenumber", "l_returnflag", "prediction")


@register("decision_tree_accuracy", sql=_TREE_SQL + """
SELECT round(avg(CASE WHEN l_returnflag = prediction THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS accuracy, count(*)::BIGINT AS n FROM p""")
def decision_tree_accuracy(spark, sf):
    pred, _ = tree.decision_tree(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_returnflag")
    return rounded(tree.accuracy(pred, "l_returnflag", "prediction"))


@register("decision_tree_rule", sql="""
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_quantity <= 24 THEN 'low' WHEN l_discount <= 0.05 THEN 'mid' WHEN l_tax <= 0.03 THEN 'up' ELSE 'high' END AS prediction
FROM lineitem""")
def decision_tree_rule(spark, sf):
    """M1 on a label that three splits separate, by the distributed search."""
    li = table(spark, sf, "lineitem").withColumn("label", F.when(F.col("l_quantity") <= 24, "low").when(
        F.col("l_discount") <= 0.05, "mid").when(F.col("l_tax") <= 0.03, "up").otherwise("high"))
    pred, _ = tree.decision_tree(li, ["l_quantity", "l_discount", "l_tax"], "label", small=500)
    return pred.select("l_orderkey", "l_linenumber", "prediction")


@register("decision_tree_stump", sql="""
WITH u AS (SELECT l_returnflag AS y, unnest([{'f': 'l_quantity', 'v': l_quantity}, {'f': 'l_discount', 'v': l_discount}], recursive := true) FROM lineitem),
c AS (SELECT f, v, y, count(*) AS n FROM u GROUP BY ALL),
g AS (SELECT x.f, x.v, c.y, sum(CASE WHEN c.v <= x.v THEN n ELSE 0 END) AS l, sum(CASE WHEN c.v > x.v THEN n ELSE 0 END) AS r
      FROM (SELECT DISTINCT f, v FROM c) x JOIN c ON c.f = x.f GROUP BY ALL),
s AS (SELECT f, v, sum(l * l) / sum(l) + sum(r * r) / sum(r) AS score FROM g GROUP BY ALL HAVING sum(r) > 0),
b AS (SELECT f AS feature, v FROM s ORDER BY round(score, 9) DESC, f DESC, v LIMIT 1)
SELECT feature, round((b.v + (SELECT min(c.v) FROM c WHERE c.f = b.feature AND c.v > b.v)) / 2, 6) + 0.0 AS threshold FROM b""")
def decision_tree_stump(spark, sf):
    """M1: the root's split, found by the distributed search, against every split tried."""
    _, nodes = tree.decision_tree(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_returnflag", max_depth=1, small=1)
    return rounded(nodes.where("depth = 0").select("feature", "threshold"))


@register("accuracy", sql="""
SELECT round(avg(CASE WHEN l_returnflag = (CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'A' END) THEN 1.0 ELSE 0.0 END), 6)
       + 0.0 AS accuracy, count(*)::BIGINT AS n FROM lineitem""")
def accuracy(spark, sf):
    li = table(spark, sf, "lineitem").withColumn(
        "rule", F.when(F.col("l_linestatus") == "O", "N").otherwise("A"))
    return rounded(tree.accuracy(li, "l_returnflag", "rule"))


@register("full_tree_accuracy", sql="""
WITH c AS (SELECT CAST(l_quantity AS FLOAT) AS a, CAST(l_discount AS FLOAT) AS b, l_returnflag AS y, count(*) AS n
           FROM lineitem GROUP BY ALL),
v AS (SELECT a, b, max(n) AS best, sum(n) AS n FROM c GROUP BY a, b)
SELECT round(sum(best) / sum(n), 6) + 0.0 AS accuracy, sum(n)::BIGINT AS n, count(*)::BIGINT AS n_vectors FROM v""")
def full_tree_accuracy(spark, sf):
    return rounded(tree.full_tree_accuracy(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"],
                                           "l_returnflag"))
