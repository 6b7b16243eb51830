"""Pulls that read each object once: a ledger of objects, committed after their rows.

A pull lists the folder, takes the objects that no committed pull has taken (by path,
size and modification time, so an object that arrives late, or in the same second as
another, is as new as any), writes their parsed rows, and commits with one row in the
log.  Whatever a failed or killed pull has written under its number is not read, and
the next pull replaces it.  One driver at a time pulls into a folder.

    objects/pull=N   path, length, modified of what pull N took
    rows/pull=N      their parsed rows
    log/pull=N       one row: the commit
    failures         one row for each pull that failed
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

OBJECTS = "path string, length long, modified timestamp"
LOG = "pull long, source string, pulled_at timestamp, objects long, rows long, newest timestamp, duration_ms long, error string"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at a path; empty if nothing has been written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def last_pull(spark: SparkSession, folder: str) -> int:
    """The number of the last committed pull, or 0."""
    return _stored(spark, f"{folder}/log", LOG).agg(F.max("pull")).first()[0] or 0


def list_objects(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, length, modified of the objects under a path; their contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def new_objects(spark: SparkSession, path: str, folder: str, pattern: str | None = None) -> DataFrame:
    """Objects that no committed pull has taken; one that was written anew since counts as new."""
    taken = _stored(spark, f"{folder}/objects", OBJECTS + ", pull long").filter(F.col("pull") <= last_pull(spark, folder))
    return list_objects(spark, path, pattern).join(taken.select("path", "length", "modified"), ["path", "length", "modified"], "left_anti")


def _literal(path: str) -> str:
    """A path that a reader takes as it stands: file names may hold the signs of a glob."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def pull(spark: SparkSession, source: str, path: str, folder: str, parse: Callable[[DataFrame], DataFrame],
         fmt: str = "text", pattern: str | None = None) -> DataFrame:
    """Take the new objects under `path` once and return the log row.

    The list of new objects, not their contents, passes the driver, which lists
    files in any case.  A pull that fails is noted with its error and takes nothing, so
    the next one finds the same objects.
    """
    began = dt.datetime.now(dt.timezone.utc)

    def entry(n: int, objects: int, rows: int, newest, error: str) -> DataFrame:
        took = int((dt.datetime.now(dt.timezone.utc) - began).total_seconds() * 1000)
        row = (n, source, began.replace(tzinfo=None), objects, rows, error, took)
        df = spark.createDataFrame([row], "pull long, source string, pulled_at timestamp, objects long, rows long, error string, duration_ms long")
        # the newest time stays a column, so no time zone of the driver comes in
        df = df.join(newest) if newest is not None else df.withColumn("newest", F.lit(None).cast("timestamp"))
        return df.select(*_stored(spark, f"{folder}/log", LOG).columns)

    n = last_pull(spark, folder) + 1
    try:
        new_objects(spark, path, folder, pattern).coalesce(1).write.mode("overwrite").parquet(f"{folder}/objects/pull={n}")
        objects = spark.read.schema(OBJECTS).parquet(f"{folder}/objects/pull={n}")
        paths = [r[0] for r in objects.select("path").orderBy("path").collect()]
        rows = 0
        if paths:
            seen = Observation()
            parsed = parse(spark.read.format(fmt).load([_literal(p) for p in paths]))
            parsed.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{folder}/rows/pull={n}")
            rows = seen.get["rows"]
    except Exception as e:  # what went wrong belongs in the log, not in the scheduler
        failed = entry(n, 0, 0, None, str(e).splitlines()[0] if str(e) else type(e).__name__)
        failed.write.mode("append").parquet(f"{folder}/failures")
        return failed
    log = entry(n, len(paths), rows, objects.agg(F.max("modified").alias("newest")), "")
    # one row is one file: it is there or not
    log.drop("pull").coalesce(1).write.mode("overwrite").parquet(f"{folder}/log/pull={n}")
    return _stored(spark, f"{folder}/log", LOG).filter(F.col("pull") == n)


def pull_log(spark: SparkSession, folder: str) -> DataFrame:
    """Committed pulls, and those that failed."""
    return _stored(spark, f"{folder}/log", LOG).unionByName(_stored(spark, f"{folder}/failures", LOG))


def pulled_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the committed pulls, with the number of their pull."""
    return spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows").filter(F.col("pull") <= last_pull(spark, folder))
