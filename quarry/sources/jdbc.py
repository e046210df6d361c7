"""S3: the whole result of a table or SQL query over JDBC, read in
parallel.

``partition_column`` with bounds splits the read into ``num_partitions``
range queries, one per task; filters and column selections on the result
are pushed into the remote query by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_jdbc(spark: SparkSession, url: str, table_or_query: str, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, num_partitions: int | None = None,
              properties: dict | None = None, fetch_size: int = 10_000) -> DataFrame:
    props = dict(properties or {})
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch_size)
    for k, v in props.items():
        reader = reader.option(k, v)
    text = table_or_query.strip()
    if text.lower().startswith("select"):
        if partition_column:
            # a query must be wrapped as a derived table to be split by ranges
            reader = reader.option("dbtable", f"({text}) q")
        else:
            reader = reader.option("query", text)
    else:
        reader = reader.option("dbtable", text)
    if partition_column:
        if lower is None or upper is None or not num_partitions:
            raise ValueError("a partitioned read needs lower, upper and num_partitions")
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", lower)
                  .option("upperBound", upper).option("numPartitions", num_partitions))
    return reader.load()
