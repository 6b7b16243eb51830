"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.session import ensure_checkpoint_dir

#: Rows of one Arrow batch. Texts may be long, so batches stay small.
BATCH_ROWS = 256
#: Words are runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the rows an Arrow batch carries, so memory follows row size only."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def with_columns(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns; an input column of the same name (any case) gives way."""
    taken = {c.lower() for c in cols}
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*keep, *[c.alias(n) for n, c in cols.items()])


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(n)


def sampled(wanted: int, rows: Column, *key: Column) -> Column:
    """Whether a row is in a sample of about `wanted` out of `rows`, by the hash of its key; all are if there are no more.

    The hash is compared in 63 bits, so the share may be as small as any table makes it.
    """
    at = F.shiftrightunsigned(F.xxhash64(*key), 1)
    share = F.least(F.lit(float(wanted)) / F.greatest(rows, F.lit(1)), F.lit(1.0))
    return (rows <= wanted) | (at < (share * F.lit(2.0 ** 63 - 1024)).cast("long"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared checkpoint folder, as a URI that tasks can write to."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    if folder.startswith("file:") and not folder.startswith("file://"):
        folder = f"file://{folder[5:]}"
    elif "://" not in folder:
        folder = f"file://{os.path.abspath(folder)}"
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    return folder


def write_whole(folder: str, name: str, data: bytes) -> None:
    """Put a file into a shared folder: whole or not at all, the same from any attempt."""
    fs, path = pafs.FileSystem.from_uri(folder)
    temp = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(temp) as out:
        out.write(data)
    try:
        fs.move(temp, f"{path}/{name}")
    except OSError:
        if fs.get_file_info(f"{path}/{name}").type != pafs.FileType.File:
            raise
        fs.delete_file(temp)


def read_whole(folder: str, name: str) -> bytes:
    fs, path = pafs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{path}/{name}") as src:
        return src.read()


def running_total(df: DataFrame, order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """Add `name`: the sum of `value` over all rows up to this one in `order`.

    Rows are range-partitioned and written down, so that the partition of each
    row is fixed; a partition adds up its own rows and starts from the total of
    those before it.  No task sees more than its range; the offsets are one row
    per partition.  Rows that tie in `order` get sums in any order among them.
    """
    n = shuffle_partitions(df.sparkSession)
    parts = cut(df.repartitionByRange(n, *order)
                .withColumn("__rt_part", F.spark_partition_id())
                .withColumn("__rt_value", value.cast("long")))
    totals = parts.groupBy("__rt_part").agg(F.sum("__rt_value").alias("__rt_sum"))
    before = Window.orderBy("__rt_off").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (totals.withColumnRenamed("__rt_part", "__rt_off")
               .withColumn("__rt_before", F.coalesce(F.sum("__rt_sum").over(before), F.lit(0)))
               .drop("__rt_sum"))
    inside = (Window.partitionBy("__rt_part").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (parts.withColumn("__rt_in", F.sum("__rt_value").over(inside))
            .join(F.broadcast(offsets), F.col("__rt_part") == F.col("__rt_off"))
            .withColumn(name, F.col("__rt_in") + F.col("__rt_before"))
            .drop("__rt_part", "__rt_off", "__rt_value", "__rt_in", "__rt_before"))
