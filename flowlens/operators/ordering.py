"""Global order without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import ensure_checkpoint_dir


def number_rows(df: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """Add the row number (from 1) in the global `order`.

    Rows are range-partitioned and written to the shared checkpoint folder, so
    that each row's partition is fixed; partitions number their own rows after
    the count of those before them.  The offsets are one row per partition.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    keys = [F.col(f"_o{i}") for i in range(len(order))]
    parts = (df.select("*", *cols).repartitionByRange(n, *keys)
             .withColumn("_part", F.spark_partition_id()).checkpoint(eager=True))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_part").alias("_p"), "_size").withColumn(
        "_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    inside = Window.partitionBy("_part").orderBy(*keys)
    return (parts.withColumn("_in", F.row_number().over(inside))
            .join(F.broadcast(offsets), F.col("_part") == F.col("_p"))
            .withColumn(name, (F.col("_in") + F.col("_before")).cast("long"))
            .drop("_part", "_p", "_before", "_in", *[f"_o{i}" for i in range(len(order))]))
