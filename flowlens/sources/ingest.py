"""Agent ingest: JSON envelopes / flow streams -> flat ``flows`` rows; unions of
agent and cloud sources; saved capture sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.labels import flow_info, grpc_target
from flowlens.schema import FLOW_JSON_SCHEMA, FLOW_NAMES, INGEST_ENVELOPE_SCHEMA, conform_flows


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _parse_ts(text: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XXX")),
                      F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]")))


def read_ingest_json(envelopes: DataFrame, col: str = "value", ingest_time=None) -> DataFrame:
    """``{agent_id, hostname, flows[]}`` documents -> one nested flow per row.

    Blank flow agent_id / hostname are back-filled from the envelope; a blank
    or zero timestamp becomes the ingest time.  Malformed documents yield no
    rows (PERMISSIVE parsing, null envelope dropped).
    """
    now = F.current_timestamp() if ingest_time is None else F.lit(ingest_time).cast("timestamp")
    # explode passes over null envelopes, so each document is parsed once
    env = envelopes.select(F.from_json(F.col(col), INGEST_ENVELOPE_SCHEMA).alias("e"))
    fl = env.select(F.col("e.agent_id").alias("env_agent"), F.col("e.hostname").alias("env_host"),
                    F.explode("e.flows").alias("f")).select("env_agent", "env_host", "f.*")
    fl = fl.withColumn("_parsed", _parse_ts(F.col("timestamp")))
    ts = F.when(F.col("_parsed") >= F.lit("0002-01-01").cast("timestamp"), F.col("_parsed")).otherwise(now)
    return (fl.withColumn("agent_id", F.when(_blank(F.col("agent_id")), F.col("env_agent")).otherwise(F.col("agent_id")))
              .withColumn("hostname", F.when(_blank(F.col("hostname")), F.col("env_host")).otherwise(F.col("hostname")))
              .withColumn("ts", ts).drop("env_agent", "env_host", "timestamp", "_parsed"))


def flatten_flow(nested: DataFrame) -> DataFrame:
    """Nested wire flow -> flat table: http.method/path/status, dns.query_name /
    query_type / rcode, blank/zero defaults for absent sub-records; ``info`` is
    computed when the agent sent none."""
    service, method = grpc_target("http")
    info = F.when(_blank(F.col("info")), flow_info(grpc_service=service, grpc_method=method)).otherwise(F.col("info"))
    flat = nested.select(
        *[c for c in nested.columns if c not in ("http", "dns", "tls", "icmp", "arp", "tcp_stats", "info")],
        F.coalesce(info, F.lit("")).alias("info"),
        F.col("http.method").alias("http_method"), F.col("http.path").alias("http_path"),
        F.col("http.status").alias("http_status"),
        F.col("dns.query_name").alias("dns_query"), F.col("dns.query_type").alias("dns_type"),
        F.col("dns.rcode").alias("dns_rcode"))
    return conform_flows(flat)


def flows_from_json_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Single wire flows (one JSON object per line / Kafka value) -> nested rows;
    malformed values are skipped; an unparsable
    timestamp becomes the time of the batch."""
    return lines.select(F.from_json(F.col(col), FLOW_JSON_SCHEMA).alias("f")).select("f.*") \
        .filter(F.col("id").isNotNull()).withColumn(
        "ts", F.coalesce(_parse_ts(F.col("timestamp")), F.current_timestamp())).drop("timestamp")


def read_flow_stream(spark: SparkSession, fmt: str = "kafka", path: str | None = None,
                     options: dict | None = None) -> DataFrame:
    """Streaming nested flows from Kafka (value = JSON flow, key = agent_id) or
    from a directory of JSON-lines files (tests / offline)."""
    opts = options or {}
    if fmt == "kafka":
        raw = spark.readStream.format("kafka").options(**opts).load() \
            .select(F.col("value").cast("string").alias("value"))
    else:
        raw = spark.readStream.options(**opts).text(path)
    return flows_from_json_lines(raw)


def union_sources(*frames: DataFrame, default_source: str = "agent") -> DataFrame:
    """Agent and cloud rows in one flat table; rows without a source are 'agent'."""
    out = None
    for f in frames:
        f = f if "source" in f.columns else f.withColumn("source", F.lit(default_source))
        f = conform_flows(f.withColumn("source", F.coalesce(F.nullif(F.col("source"), F.lit("")),
                                                            F.lit(default_source))))
        out = f if out is None else out.unionByName(f)
    return out


def save_session(df: DataFrame, path: str, session_id: str, mode: str = "overwrite") -> None:
    """Saved capture: flows of one session, id-keyed (replacing duplicates),
    written under ``session_id=...`` with dynamic partition overwrite."""
    out = df.dropDuplicates(["id"]).withColumn("session_id", F.lit(session_id))
    (out.write.mode(mode).option("partitionOverwriteMode", "dynamic")
        .partitionBy("session_id").parquet(path))


def load_session(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    """Flows of a saved session ordered by timestamp (partition-pruned read)."""
    return spark.read.parquet(path).filter(F.col("session_id") == session_id) \
                .drop("session_id").orderBy("ts", "id")

