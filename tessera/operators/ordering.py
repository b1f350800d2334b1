"""Places in a total order without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.session import checkpointed


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with each row's place in the order, from 1.

    Rows are spread by ranges of the order, written once, counted by range and numbered within
    their range; what is joined is one row a range. Rows that the order does not tell apart are
    numbered in some order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = checkpointed(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sizes = spread.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(W.orderBy("_part")) - F.col("count")).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return spread.withColumn("_in", inside).join(F.broadcast(before), "_part").select(*df.columns, (F.col("_in") + F.col("_before")).alias(name))
