"""Baselines that follow the stream: mergeable moments of hourly counts, a version a batch.

Each batch brings closed five-minute counts.  They are first tested against the version
that the batch before left; then the hours that are complete by now are merged into a new
version.  A version is written under its batch's number and replaces itself, and the
version before it is only removed a batch later, so a replayed batch tests against and
starts from what its first try did.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowlens.functions.timewin import hour_of_week
from flowlens.operators import detect as D
from flowlens.operators.maintain import _Folder
from flowlens.streaming.jobs import DEFAULT_WATERMARK, each_batch, stored, with_event_time, write_epoch

KEYS = ["agent_id", "protocol"]
_HOURS = [*KEYS, "hour", "flow_count", "bytes_in", "bytes_out"]
_MOMENTS = [*KEYS, "hour_of_week", "n", "mean", "m2", "bytes_in", "bytes_out"]


def _version(spark: SparkSession, path: str, before: int) -> tuple[int | None, DataFrame | None, DataFrame | None]:
    """Number, moments and open hours of the newest version of a batch before this one."""
    moments, hours = stored(spark, f"{path}/moments"), stored(spark, f"{path}/open")
    if moments is None or hours is None:
        return None, None, None
    # the open hours are written last, so a version that has them is whole
    newest = hours.filter(F.col("epoch") < before).agg(F.max("epoch")).first()[0]
    if newest is None:
        return None, None, None
    return newest, moments.filter(F.col("epoch") == newest).select(*_MOMENTS), hours.filter((F.col("epoch") == newest) & F.col("agent_id").isNotNull())


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Moments of the union of two sets of samples."""
    a, b = old.select(*[F.col(c).alias(f"a_{c}") if c not in (*KEYS, "hour_of_week") else F.col(c) for c in _MOMENTS]), new
    j = a.join(b, [*KEYS, "hour_of_week"], "full").fillna(0)
    n, delta = F.col("a_n") + F.col("n"), F.col("mean") - F.col("a_mean")
    return j.select(*KEYS, "hour_of_week", n.alias("n"), (F.col("a_mean") + delta * F.col("n") / n).alias("mean"),
                    (F.col("a_m2") + F.col("m2") + delta * delta * F.col("a_n") * F.col("n") / n).alias("m2"),
                    (F.col("a_bytes_in") + F.col("bytes_in")).alias("bytes_in"), (F.col("a_bytes_out") + F.col("bytes_out")).alias("bytes_out"))


def moments_of(hours: DataFrame) -> DataFrame:
    """Moments of hourly counts (agent_id, protocol, hour, flow_count, bytes) by hour of week."""
    m = hours.groupBy(*KEYS, hour_of_week(F.col("hour")).alias("hour_of_week")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("flow_count").alias("mean"), F.var_pop("flow_count").alias("v"),
        F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"))
    return m.withColumn("m2", F.col("v") * F.col("n")).select(*_MOMENTS)


def baselines_of(moments: DataFrame) -> DataFrame:
    """The table that ``detect.compute_baselines`` gives, from moments."""
    return moments.select(*KEYS, "hour_of_week", F.col("mean").alias("flow_count_mean"),
                          F.sqrt(F.greatest(F.col("m2"), F.lit(0.0)) / F.col("n")).alias("flow_count_std"),
                          (F.col("bytes_in") / F.col("n")).alias("bytes_in_mean"), (F.col("bytes_out") / F.col("n")).alias("bytes_out_mean"),
                          F.col("n").alias("sample_count"))


def learned_baselines(spark: SparkSession, path: str) -> DataFrame:
    """Baselines of the newest version."""
    _, moments, _ = _version(spark, path, 1 << 62)
    return baselines_of(moments if moments is not None else spark.createDataFrame(
        [], "agent_id string, protocol string, hour_of_week int, n long, mean double, m2 double, bytes_in long, bytes_out long"))


def stream_learn(flows: DataFrame, path: str, events_path: str, window_minutes: int = 5, delay: str = DEFAULT_WATERMARK,
                 trigger: dict | None = None, name: str = "learn") -> StreamingQuery:
    """Anomalies of each batch's closed windows against the baselines learnt from the batches
    before, and the baselines with the hours that the batch completes.

    An hour is complete when a window after it has closed.  A version holds one row for
    each (agent, protocol, hour of week) and the hours still open; two versions are kept.
    """
    spark = flows.sparkSession
    f = with_event_time(flows, delay=delay).filter(F.col("agent_id") != "")
    counts = f.groupBy(F.window("ts", f"{window_minutes} minutes").alias("w"), "agent_id", "hostname", "protocol").agg(
        F.count(F.lit(1)).alias("flow_count"), F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"))
    counts = counts.select(F.col("w.start").alias("window_start"), "agent_id", "hostname", "protocol", "flow_count", "bytes_in", "bytes_out")

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            horizon = batch.agg(F.max("window_start")).first()[0]
            if horizon is None:
                return
            before, moments, still = _version(spark, path, epoch)
            if moments is not None:
                seen = D.detect_windows(batch.drop("bytes_in", "bytes_out"), baselines_of(moments), window_minutes)
                write_epoch(seen.withColumn("baseline_epoch", F.lit(before).cast("long")), events_path, epoch)
            hours = batch.withColumn("hour", F.date_trunc("hour", "window_start")).select(*_HOURS)
            if still is not None:
                hours = hours.unionByName(still.select(*_HOURS))
            hours = hours.groupBy(*KEYS, "hour").agg(*[F.sum(c).alias(c) for c in _HOURS[3:]])
            done = F.col("hour") + F.expr("INTERVAL 1 HOUR") <= F.lit(horizon)
            new = moments_of(hours.filter(done))
            write_epoch(merged(moments, new) if moments is not None else new, f"{path}/moments", epoch)
            rest = hours.filter(~done)
            # a version without open hours has its row too, or it would not be seen
            mark = spark.range(1).select(*[F.lit(None).cast(c.dataType).alias(c.name) for c in rest.schema])
            write_epoch(rest.unionByName(mark), f"{path}/open", epoch)
        finally:
            batch.unpersist()
        for kind in ("moments", "open"):
            old = _Folder(spark, f"{path}/{kind}")
            for e in old.names("", "epoch"):
                if before is not None and e < before:
                    old.delete(f"epoch={e}")

    return each_batch(counts, write, name, trigger)
