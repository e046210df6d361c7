"""Running sums over an order, without a window that one task has to hold.

The rows are range-partitioned by (group, order) and written once.  Sums inside
a partition come from a window per (group, partition); a group that began in an
earlier partition is carried on.  Only the first group of a partition can have
begun before, so the carries are one number per partition and sum, whatever the
number of groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import cut_lineage


def running_sums(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column], inclusive: bool = True) -> DataFrame:
    """``df`` plus, for each name, the running sum of its column within the
    group, in the order given (which has to be unique in a group), the row's
    own value counted or not."""
    width = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    keys = [F.col(c) for c in [*group, *order]]
    placed = cut_lineage(df.repartitionByRange(width, *keys).sortWithinPartitions(*keys)
                         .withColumn("__seq", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__seq", 33))
    here = Window.partitionBy(*group, "__part").orderBy("__seq").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    zero = F.lit(0)
    local = placed.withColumns({f"__run_{k}": F.coalesce(F.sum(v).over(here), zero) for k, v in sums.items()})
    # a group's totals per partition, but for groups that lie in one partition
    totals = placed.groupBy(*group, "__part").agg(*[F.sum(v).alias(f"__sum_{k}") for k, v in sums.items()])
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*group, "__part", *[F.sum(f"__sum_{k}").over(before).alias(f"__car_{k}") for k in sums])
    # at most one row per partition is left
    some = carried.where(F.coalesce(*[F.col(f"__car_{k}") for k in sums]).isNotNull()).withColumnsRenamed({c: f"__g_{c}" for c in group} | {"__part": "__p"})
    match = [local["__part"] == some["__p"]] + [local[c].eqNullSafe(some[f"__g_{c}"]) for c in group]
    joined = local.join(F.broadcast(some), match, "left")
    return joined.select(*df.columns, *[(F.col(f"__run_{k}") + F.coalesce(f"__car_{k}", zero)).alias(k) for k in sums])
