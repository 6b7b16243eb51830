"""SparkSession construction and cluster-safe helpers.

The library never creates its own session inside an operator; callers pass one
in.  ``get_spark`` is a convenience for scripts, tests and the bench.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "flowlens",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings every operator assumes: UTC, AQE, Arrow.

    ``spark.sql.shuffle.partitions`` defaults to 2x the local cores; on a
    cluster set it from the data size (~128-256 MB per shuffle partition) and
    let AQE coalesce small ones.
    """
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    master = master or os.environ.get("SPARK_MASTER") or f"local[{cpus}]"
    parts = shuffle_partitions or cpus * 2
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
        # broadcast only sides that the optimizer can prove small
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
        # methods over 8,000 bytes are never compiled by the JVM; such a stage runs in compiled pieces instead
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must point at shared storage; it is only read here.
    Where it is unset a private folder is made for a local master (tests); any
    other master fails, since executors could not see the driver's folder.
    """
    sc = spark.sparkContext
    current = sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        jdir = sc._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get()
    if not current:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="flowlens-ckpt-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(current)
    return current
