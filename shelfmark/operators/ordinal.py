"""The natural order of an inventory, and row numbers in it without a single-partition sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.session import written

ORDER = ("file", "line", "seq")


def with_ordinal(df: DataFrame, *order: str, name: str = "ord") -> DataFrame:
    """Adds the 0-based place of each row in the given order (file, line, seq).

    Rows are range-partitioned and written once; each partition is numbered by itself, from where the
    partitions before it end. Only their sizes are added up in one place.
    """
    keys = order or ORDER
    parts = df.repartitionByRange(*[F.col(k) for k in keys]).withColumn("_part", F.spark_partition_id())
    held = written(parts, "ordinal")
    sizes = held.groupBy("_part").agg(F.count("*").alias("_size"))
    first = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return held.join(first, "_part").withColumn(name, place + F.col("_first") - 1).drop("_part", "_first")
