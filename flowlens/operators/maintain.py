"""Upkeep of the stored flow table: retention, compaction, and reading a whole version.

The table is a folder that streams and batches add to (``export.write_flows`` with an
epoch), plus versions that upkeep makes of it:

    epoch=E/yyyymm=M/...       as written, many small files
    _base/v=V/yyyymm=M/...     rows that upkeep V has packed
    _snapshots/v=V             one row: months and their folders, the epochs that they hold

A snapshot is one file, so a reader sees a version whole, before or after it.  Months
past the retention leave the list without being read; the month of the edge is
rewritten, others are only added to.  Files that neither this version nor the one before
it names are deleted at the end, so a reader of the version before isn't broken.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.export import RETENTION_DAYS
from flowlens.schema import conform_flows

SNAPSHOT = "upto_epoch long, cutoff timestamp, months array<struct<month:int,folder:string>>"
#: Folders of a month that are packed into one.
MAX_PARTS = 8
#: Rows that a task writes into one file.
FILE_ROWS = 5_000_000


class _Folder:
    """Folders below a path, by Hadoop's file system."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.at = lambda p: jvm.org.apache.hadoop.fs.Path(f"{path}/{p}" if p else path)
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, below: str, key: str) -> list[int]:
        """Numbers of the folders ``key=N`` below a folder."""
        if not self.fs.exists(self.at(below)):
            return []
        found = [s.getPath().getName() for s in self.fs.listStatus(self.at(below)) if s.isDirectory()]
        return sorted(int(n.split("=")[1]) for n in found if n.startswith(f"{key}="))

    def delete(self, folder: str) -> None:
        self.fs.delete(self.at(folder), True)


def _month(ts: dt.datetime) -> int:
    return ts.year * 100 + ts.month


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions: those whose snapshot holds its row."""
    try:
        rows = spark.read.schema(SNAPSHOT + ", v long").parquet(f"{path}/_snapshots").select("v").distinct().collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(r[0] for r in rows)


def _snapshot(spark: SparkSession, path: str, v: int | None):
    if v is None:
        return {"upto_epoch": -1, "cutoff": None, "months": []}
    return spark.read.schema(SNAPSHOT).parquet(f"{path}/_snapshots/v={v}").first().asDict(recursive=True)


def _rows(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    """Rows of packed folders and of epochs; the month is that of the row."""
    flows = conform_flows(spark.createDataFrame([], "id string"))
    return spark.read.schema(flows.schema).option("recursiveFileLookup", "true").parquet(*[f"{path}/{f}" for f in folders]) if folders else flows


def read_table(spark: SparkSession, path: str, start: dt.datetime | None = None, end: dt.datetime | None = None) -> DataFrame:
    """Flows of the newest version and of the epochs since, with ``start <= ts < end``.

    Months outside the range aren't opened.  What the retention has passed in newer
    epochs is left out too.
    """
    versions = _versions(spark, path)
    s = _snapshot(spark, path, versions[-1] if versions else None)
    months = [m["folder"] for m in s["months"] if (start is None or m["month"] >= _month(start)) and (end is None or m["month"] <= _month(end))]
    epochs = [f"epoch={e}" for e in _Folder(spark, path).names("", "epoch") if e > s["upto_epoch"]]
    df = _rows(spark, path, months + epochs)
    if s["cutoff"] is not None:
        df = df.filter(F.col("ts") >= F.lit(s["cutoff"]))
    if start is not None:
        df = df.filter(F.col("ts") >= F.lit(start))
    if end is not None:
        df = df.filter(F.col("ts") < F.lit(end))
    return df


def _pack(df: DataFrame, folder: str) -> None:
    """Write rows by month in few large files, a range of time each."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (df.withColumn("yyyymm", F.date_format("ts", "yyyyMM").cast("int")).repartitionByRange(n, "yyyymm", "ts")
     .sortWithinPartitions("yyyymm", "ts").write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS)
     .partitionBy("yyyymm").parquet(folder))


def maintain(spark: SparkSession, path: str, as_of: dt.datetime, days: int = RETENTION_DAYS["flows"],
             upto_epoch: int | None = None) -> int:
    """Pack the epochs up to ``upto_epoch`` (by default all but the newest, which may
    still be written), drop rows before ``as_of - days``, and return the new version.

    A run that dies before its snapshot changes nothing; the next one takes its number.
    One run at a time.  A cutoff never moves back.
    """
    folder = _Folder(spark, path)
    versions = _versions(spark, path)
    last = _snapshot(spark, path, versions[-1] if versions else None)
    v = (versions[-1] if versions else 0) + 1
    cutoff = max(as_of - dt.timedelta(days=days), last["cutoff"] or dt.datetime.min)
    epochs = [e for e in folder.names("", "epoch") if e > last["upto_epoch"]]
    upto = (max(epochs[:-1], default=last["upto_epoch"]) if upto_epoch is None else upto_epoch)
    taken = [e for e in epochs if e <= upto]
    months: dict[int, list[str]] = {}
    for m in last["months"]:
        if m["month"] >= _month(cutoff):
            months.setdefault(m["month"], []).append(m["folder"])
    # read again: new epochs, the month of the edge if it has to shed rows, months in too many parts
    edge = _month(cutoff)
    sheds = edge in months and cutoff != last["cutoff"] and bool(
        _rows(spark, path, months[edge]).filter(F.col("ts") < F.lit(cutoff)).head(1))
    again = [m for m, parts in months.items() if (m == edge and sheds) or len(parts) >= MAX_PARTS]
    sources = [f"epoch={e}" for e in taken] + [f for m in again for f in months.pop(m)]
    if sources:
        _pack(_rows(spark, path, sources).filter(F.col("ts") >= F.lit(cutoff)), f"{path}/_base/v={v}")
        for m in folder.names(f"_base/v={v}", "yyyymm"):
            months.setdefault(m, []).append(f"_base/v={v}/yyyymm={m}")
    listed = [(m, f) for m, parts in sorted(months.items()) for f in parts]
    spark.createDataFrame([(max([upto, *taken]), cutoff, listed)], SNAPSHOT).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/_snapshots/v={v}")
    _clean(folder, last, {f for _, f in listed} | {m["folder"] for m in last["months"]})
    return v


def _clean(folder: _Folder, last: dict, named: set[str]) -> None:
    """Delete what neither version names, and the epochs that the one before holds packed."""
    for e in folder.names("", "epoch"):
        if e <= last["upto_epoch"]:
            folder.delete(f"epoch={e}")
    for v in folder.names("_base", "v"):
        months = folder.names(f"_base/v={v}", "yyyymm")
        for m in months:
            if f"_base/v={v}/yyyymm={m}" not in named:
                folder.delete(f"_base/v={v}/yyyymm={m}")
