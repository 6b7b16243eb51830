"""Structured Streaming jobs built from the batch operators.

Checkpoints and sinks live under the shared ``spark.checkpoint.dir``, so a
restarted driver or lost executor resumes from the last committed offsets.  Plans
that only append go to a Parquet sink, whose log makes each batch count once;
``foreachBatch`` jobs write partitions named by the batch number and overwrite
them, so a replayed batch replaces itself.  The reference's writer drops rows when
its 2,000-row buffer is full; here back-pressure comes from
``maxOffsetsPerTrigger`` / ``maxFilesPerTrigger`` and nothing is dropped.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowlens.functions.timewin import hour_of_week
from flowlens.operators import detect as D
from flowlens.operators import enrich as E
from flowlens.operators import export as X
from flowlens.operators.certs import extract_certs
from flowlens.session import ensure_checkpoint_dir
from flowlens.sources.ingest import flatten_flow

DEFAULT_WATERMARK = "10 minutes"


def stream_folder(spark: SparkSession, name: str, part: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "streams", name, part)


def checkpoint_for(spark: SparkSession, name: str) -> str:
    return stream_folder(spark, name, "checkpoint")


def with_event_time(df: DataFrame, ts: str = "ts", delay: str = DEFAULT_WATERMARK) -> DataFrame:
    """Watermarks need TIMESTAMP (not TIMESTAMP_NTZ) event time."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def _start(writer, name: str, trigger: dict | None) -> StreamingQuery:
    w = writer.queryName(name)
    return (w.trigger(**trigger) if trigger else w).start()


def append_to(df: DataFrame, path: str, name: str, trigger: dict | None = None) -> StreamingQuery:
    """Append a stream to a Parquet folder."""
    w = (df.writeStream.outputMode("append").format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint_for(df.sparkSession, name)))
    return _start(w, name, trigger)


def each_batch(df: DataFrame, write: Callable[[DataFrame, int], None], name: str, trigger: dict | None) -> StreamingQuery:
    w = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_for(df.sparkSession, name))
    return _start(w, name, trigger)


def write_epoch(df: DataFrame, path: str, epoch: int) -> None:
    """Write a batch's rows as the partition of its number, replacing what a first try left."""
    (df.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path))


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None if nothing was written there yet; other errors are raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def stream_ingest(nested: DataFrame, flows_path: str, agents_path: str, certs_path: str | None = None,
                  blocklist: DataFrame | None = None, geo: DataFrame | None = None, trigger: dict | None = None,
                  name: str = "ingest") -> StreamingQuery:
    """Nested wire flows -> enriched flat flows (epoch and month partitions), agent
    sightings and, with ``certs_path``, TLS certificate sightings of each batch."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            flat = flatten_flow(batch)
            if blocklist is not None:
                flat = E.enrich_threat(flat, blocklist).drop("threat_reasons")
            if geo is not None:
                flat = E.enrich_geo(flat, geo)
            X.write_flows(flat, flows_path, epoch=epoch)
            write_epoch(X.upsert_agents_from_flows(flat), agents_path, epoch)
            if certs_path is not None:
                write_epoch(extract_certs(batch), certs_path, epoch)
        finally:
            batch.unpersist()

    return each_batch(nested, write, name, trigger)


def agent_sightings(spark: SparkSession, agents_path: str) -> DataFrame:
    """Latest hostname and last_seen per agent over all batches."""
    return spark.read.parquet(agents_path).groupBy("agent_id").agg(
        F.max_by("hostname", F.struct("last_seen", "epoch")).alias("hostname"), F.max("last_seen").alias("last_seen"))


def stream_enrich(flows: DataFrame, path: str, blocklist: DataFrame, geo: DataFrame | None = None,
                  trigger: dict | None = None, name: str = "enrich") -> StreamingQuery:
    """Flows of each batch with threat and geo columns; the network join looks up the
    batch's distinct addresses."""

    def write(batch: DataFrame, epoch: int) -> None:
        out = E.enrich_threat(batch, blocklist)
        write_epoch(E.enrich_geo(out, geo) if geo is not None else out, path, epoch)

    return each_batch(flows, write, name, trigger)


def stream_timeseries(flows: DataFrame, delay: str = DEFAULT_WATERMARK) -> DataFrame:
    """Per-minute counts / bytes with a watermark; append mode emits each minute
    once it is closed."""
    f = with_event_time(flows, delay=delay)
    return f.groupBy(F.window("ts", "1 minute").alias("w")).agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out")
    ).select(F.col("w.start").alias("minute"), "cnt", "bytes_in", "bytes_out")


def stream_detect(flows: DataFrame, baselines: DataFrame, window_minutes: int = 5,
                  delay: str = DEFAULT_WATERMARK) -> DataFrame:
    """5-minute tumbling counts per (agent, hostname, protocol) joined to the
    baseline of the window's hour-of-week; emits anomalies.  Give it a stored
    baseline table: a plan over raw flows would be computed in every batch."""
    f = with_event_time(flows, delay=delay).filter(F.col("agent_id") != "")
    obs = f.groupBy(F.window("ts", f"{window_minutes} minutes").alias("w"), "agent_id", "hostname", "protocol") \
           .agg(F.count(F.lit(1)).alias("flow_count"))
    obs = obs.withColumn("window_start", F.col("w.start")).withColumn("hour_of_week", hour_of_week(F.col("w.start")))
    bl = baselines.filter(F.col("sample_count") >= D.MIN_SAMPLES).select(
        "agent_id", "protocol", "hour_of_week", "flow_count_mean", "flow_count_std")
    j = obs.join(bl, ["agent_id", "protocol", "hour_of_week"])
    return D._score(j, 60.0 / window_minutes).filter(F.abs("z_score") >= D.Z_THRESHOLD).select(
        "window_start", "agent_id", "hostname", "protocol", "anomaly_type", "z_score", "observed", "expected",
        "description", "severity")


def stream_rules(flows: DataFrame, delay: str = DEFAULT_WATERMARK) -> DataFrame:
    """One row per flow and row rule it matches (a flow may match several).

    Row rules are evaluated once per row (the reference re-fires rows while they
    stay inside a look-back longer than its 5-minute cycle); duplicates of a
    (flow, rule) within the watermark are dropped."""
    f = with_event_time(flows, delay=delay)
    hits = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in D.row_rules().items()]))
    return f.withColumn("rule", F.explode(hits)).dropDuplicatesWithinWatermark(["id", "rule"])


def stream_port_scans(flows: DataFrame, minutes: int = 5, min_ports: int = 50,
                      delay: str = DEFAULT_WATERMARK) -> DataFrame:
    """Closed windows in which a source probed more than ``min_ports`` distinct ports.

    The exact count is a chain of two windowed aggregates, (window, source, port)
    and (window, source), so a scanning source is spread over its ports."""
    f = with_event_time(flows, delay=delay).filter(F.col("protocol").isin("TCP", "UDP"))
    ports = f.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "src_ip", "dst_port").agg(
        F.min("ts").alias("first_seen"))
    return ports.groupBy(F.window(F.window_time("w"), f"{minutes} minutes").alias("w"), "src_ip").agg(
        F.count(F.lit(1)).alias("port_count"), F.min("first_seen").alias("first_seen")) \
        .filter(F.col("port_count") > min_ports) \
        .select(F.col("w.start").alias("window_start"), "src_ip", "port_count", "first_seen")


def stream_policies(flows: DataFrame, policies: DataFrame) -> DataFrame:
    """Policy violations of each arriving flow (stream-static join)."""
    return D.evaluate_policies(flows, policies)


def agent_sessions(flows: DataFrame, gap: str = "5 minutes", delay: str = DEFAULT_WATERMARK) -> DataFrame:
    """Online spans per agent: a session closes after ``gap`` without flows."""
    f = with_event_time(flows, delay=delay)
    return f.groupBy(F.session_window("ts", gap).alias("s"), "agent_id").agg(
        F.count(F.lit(1)).alias("flows")).select(
        "agent_id", F.col("s.start").alias("online_from"), F.col("s.end").alias("online_until"), "flows")


def live_tail(flows: DataFrame, condition=None) -> DataFrame:
    """Every ingested flow matching ``condition`` (push to a file / console / Kafka
    sink); no buffer to overflow, so no slow-consumer drops."""
    return flows if condition is None else flows.filter(condition)


def stream_certs(nested: DataFrame, certs_path: str, trigger: dict | None = None,
                 name: str = "certs") -> StreamingQuery:
    """Certificate sightings of each batch; ``cert_inventory`` merges them at read time."""
    return each_batch(nested, lambda batch, epoch: write_epoch(extract_certs(batch), certs_path, epoch), name, trigger)


def cert_inventory(spark: SparkSession, certs_path: str) -> DataFrame:
    """Latest attributes per fingerprint over all logged batches (first_seen kept)."""
    log = spark.read.parquet(certs_path)
    return log.groupBy("fingerprint").agg(
        *[F.max_by(c, F.struct("last_seen", "epoch")).alias(c) for c in
          ("cn", "issuer", "expiry", "expired", "sans", "agent_id", "hostname", "src_ip", "dst_ip")],
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.sum("sightings").alias("sightings"))
