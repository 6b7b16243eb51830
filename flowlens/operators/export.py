"""Sinks and export shaping: flow table writes, agent upserts, hourly NDJSON
exports, CSV, audit CEF/LEEF/JSON, SIEM payloads, OTLP spans, retention,
incremental cursors.

Writers run on the executors (``DataFrameWriter``), never through the driver.
Payload text is built with column expressions (``format_string``,
``to_json``); HTTP delivery to third parties is outside this library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.timewin import interval

# names used in generated payloads (own identifiers, parameters of the writers)
VENDOR, PRODUCT, APP = "flowlens", "hub", "flowlens"


def write_flows(df: DataFrame, path: str, mode: str = "append", max_records_per_file: int = 5_000_000,
                epoch: int | None = None) -> None:
    """Write flows to the month-partitioned table, sorted by ts inside each file so
    Parquet min/max statistics prune time ranges.

    Rows are range-partitioned by (month, ts): a month is spread over as many
    tasks as its rows need, and each task writes a time range of one month, or of
    a few.  With ``epoch`` the rows go to a partition of that number which
    replaces itself, so a replayed micro-batch changes nothing.
    """
    out = df.withColumn("yyyymm", F.date_format("ts", "yyyyMM").cast("int"))
    keys = ["yyyymm"]
    w_mode, overwrite = mode, None
    if epoch is not None:
        out = out.withColumn("epoch", F.lit(epoch).cast("long"))
        keys, w_mode, overwrite = ["epoch", "yyyymm"], "overwrite", "dynamic"
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = (out.repartitionByRange(n, "yyyymm", "ts").sortWithinPartitions("yyyymm", "ts")
         .write.mode(w_mode).option("maxRecordsPerFile", max_records_per_file))
    if overwrite:
        w = w.option("partitionOverwriteMode", overwrite)
    w.partitionBy(*keys).parquet(path)


def read_flows(spark, path: str, start=None, end=None) -> DataFrame:
    """Read the flow table with partition pruning derived from ts bounds."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.filter((F.col("yyyymm") >= int(start.strftime("%Y%m"))) & (F.col("ts") >= F.lit(start)))
    if end is not None:
        df = df.filter((F.col("yyyymm") <= int(end.strftime("%Y%m"))) & (F.col("ts") < F.lit(end)))
    return df


def upsert_agents_from_flows(flows: DataFrame) -> DataFrame:
    """One agent row per agent of a batch: latest hostname and last_seen."""
    return flows.filter(F.col("agent_id") != "").groupBy("agent_id").agg(
        F.max_by("hostname", F.struct("ts", "id")).alias("hostname"), F.max("ts").alias("last_seen"))


# fixed values: column set of the hourly object-storage export
EXPORT_COLUMNS = ["id", "agent_id", "hostname", "ts", "protocol", "src_ip", "src_port", "dst_ip", "dst_port",
                  "bytes_in", "bytes_out", "duration_ms", "info", "http_method", "http_path", "http_status",
                  "dns_query", "dns_type", "country_code", "threat_score", "threat_level", "process_name", "pid"]


def export_frame(flows: DataFrame, start, end) -> DataFrame:
    """Rows of [start, end) with the export columns and the hour path parts."""
    f = flows.filter((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end)))
    return f.select(*EXPORT_COLUMNS, F.date_format("ts", "yyyy").alias("yyyy"), F.date_format("ts", "MM").alias("MM"),
                    F.date_format("ts", "dd").alias("dd"), F.date_format("ts", "HH").alias("HH"))


def export_log(frame: DataFrame, prefix: str = "flows", error: str = "") -> DataFrame:
    """Log rows of an export: window_start, window_end, object key, row_count, error."""
    hours = frame.groupBy("yyyy", "MM", "dd", "HH").agg(F.count(F.lit(1)).alias("row_count"))
    start = F.to_timestamp(F.concat_ws(" ", F.concat_ws("-", "yyyy", "MM", "dd"), F.concat("HH", F.lit(":00:00"))))
    key = F.concat(F.lit(f"{prefix}/yyyy="), "yyyy", F.lit("/MM="), "MM", F.lit("/dd="), "dd", F.lit("/HH="), "HH")
    return hours.select(start.alias("window_start"), (start + interval("1 HOUR")).alias("window_end"), key.alias("key"),
                        "row_count", F.lit(error).alias("error"))


def export_window(flows: DataFrame, path: str, start, end) -> DataFrame:
    """gzip NDJSON under yyyy=/MM=/dd=/HH= for every hour of [start, end) in one
    job (dynamic partition overwrite: a re-run replaces only its hours).
    Returns the log rows; a caller that catches a failed write logs
    ``export_log(frame, error=...)``."""
    f = export_frame(flows, start, end)
    (f.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "gzip")
      .partitionBy("yyyy", "MM", "dd", "HH").json(path))
    return export_log(f)


def export_flows_csv(nested: DataFrame) -> DataFrame:
    """Flat CSV projection of nested flows with tls_* columns (write with header)."""
    return nested.select(
        "id", "ts", "agent_id", "hostname", "protocol", "src_ip", "src_port", "dst_ip", "dst_port",
        "bytes_in", "bytes_out", "duration_ms",
        F.coalesce(F.col("tls.sni"), F.lit("")).alias("tls_sni"),
        F.coalesce(F.col("tls.version"), F.lit("")).alias("tls_version"),
        F.coalesce(F.col("tls.cert_cn"), F.lit("")).alias("tls_cert_cn"),
        F.coalesce(F.col("tls.cert_expiry"), F.lit("")).alias("tls_cert_expiry"),
        F.coalesce(F.col("tls.has_weak_cipher"), F.lit(False)).alias("tls_weak_cipher"))


def cef_severity(status: Column) -> Column:
    return F.when(status >= 500, 7).when(status >= 400, 5).otherwise(3)


def export_audit(audit: DataFrame, fmt: str = "json", start=None, end=None, limit: int | None = None) -> DataFrame:
    """All audit events from ``start`` to ``end``, oldest first, as one text line per
    event (CEF, LEEF) or one JSON object per event; ``limit`` keeps the oldest."""
    a = audit
    if start is not None:
        a = a.filter(F.col("ts") >= F.lit(start))
    if end is not None:
        a = a.filter(F.col("ts") <= F.lit(end))
    a = a.orderBy("ts", "id")
    if limit is not None:
        a = a.limit(limit)
    if fmt == "cef":
        line = F.format_string(
            f"CEF:0|{VENDOR}|{PRODUCT}|1.0|%s|%s %s|%d|rt=%d src=%s requestMethod=%s request=%s outcome=%d "
            "act=%s dproc=%s deviceCustomNumber1=%d deviceCustomNumber1Label=latency_ms",
            "id", "method", "path", cef_severity(F.col("status")), F.unix_millis("ts"), "client_ip", "method",
            "path", "status", "role", "token_id", "latency_ms")
    elif fmt == "leef":
        line = F.format_string(
            f"LEEF:2.0|{VENDOR}|{PRODUCT}|1.0|%s %s\tdevTime=%s\tdevTimeFormat=yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\t"
            "src=%s\trequestMethod=%s\trequest=%s\tstatusCode=%d\trole=%s\ttokenId=%s\tlatencyMs=%d",
            "method", "path", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "client_ip", "method", "path",
            "status", "role", "token_id", "latency_ms")
    else:
        line = F.to_json(F.struct("id", "token_id", "role", "method", "path", "status", "client_ip", "latency_ms",
                                  F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts")))
    return a.select("ts", "id", line.alias("line"))


def siem_payload(audit: DataFrame, kind: str, index: str = "") -> DataFrame:
    """Audit rows -> one payload record per event for splunk / elastic / datadog / loki."""
    outcome = F.when(F.col("status") >= 400, "failure").otherwise("success")
    ev = F.struct("id", "token_id", "role", "method", "path", "status", "client_ip", "latency_ms")
    if kind == "splunk":
        fields = [(F.unix_millis("ts") / 1000.0).alias("time"), F.lit(APP).alias("source"),
                  F.lit(f"{APP}:audit").alias("sourcetype"), F.lit("hub-api").alias("host"), ev.alias("event")]
        if index:
            fields.append(F.lit(index).alias("index"))
        rec = F.to_json(F.struct(*fields))
    elif kind == "elastic":
        rec = F.to_json(F.struct(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("@timestamp"),
            F.struct(F.concat_ws(" ", "method", "path").alias("action"), F.array(F.lit("web")).alias("category"),
                     F.array(F.lit("access")).alias("type"), outcome.alias("outcome"),
                     (F.col("latency_ms").cast("bigint") * 1_000_000).alias("duration")).alias("event"),
            F.struct(F.col("client_ip").alias("ip")).alias("source"),
            F.struct(F.struct(F.col("method"), F.col("path").alias("target")).alias("request"),
                     F.struct(F.col("status").alias("status_code")).alias("response")).alias("http"),
            F.struct("id", "token_id", "role", "latency_ms").alias(APP)))
    elif kind == "datadog":
        rec = F.to_json(F.struct(
            F.lit(APP).alias("ddsource"),
            F.format_string("role:%s,method:%s,status:%d", "role", "method", "status").alias("ddtags"),
            F.lit("hub-api").alias("service"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"),
            F.format_string("%s %s → %d (%dms) [%s]", "method", "path", "status", "latency_ms", "role").alias("message"),
            ev.alias("attributes")))
    elif kind == "loki":
        rec = F.to_json(F.array(
            (F.unix_micros("ts") * 1000).cast("string"),
            F.format_string('method=%s path="%s" status=%d role=%s client_ip=%s latency_ms=%d token_id=%s',
                            "method", "path", "status", "role", "client_ip", "latency_ms", "token_id")))
    else:
        raise ValueError(kind)
    return audit.select("ts", "id", rec.alias("payload"))


def incremental_cursor(df: DataFrame, cursor_ts, cursor_id: str = "", batch: int = 500) -> DataFrame:
    """Next batch after a (ts, id) cursor in (ts, id) order.  The reference keys
    the cursor on ts alone and loses rows tied at the cursor; (ts, id) does not."""
    ts = F.lit(cursor_ts).cast("timestamp")
    after = (F.col("ts") > ts) | ((F.col("ts") == ts) & (F.col("id") > cursor_id))
    return df.filter(after).orderBy("ts", "id").limit(batch)


def to_otel_spans(flows: DataFrame, window: str = "1h", as_of=None, limit: int | None = None,
                  prefix: str = APP) -> DataFrame:
    """HTTP(S) flows with a method -> OTLP spans (client kind, status 2 when
    >= 400); ``limit`` keeps the newest."""
    from flowlens.functions.timewin import since
    f = since(flows, window, as_of).filter(F.col("protocol").isin("HTTP", "HTTPS") & (F.col("http_method") != ""))
    if limit is not None:
        f = f.orderBy(F.desc("ts"), F.desc("id")).limit(limit)
    hexid = F.regexp_replace("id", "-", "")
    start_ns = F.unix_micros("ts") * 1000
    attrs = F.array(
        F.struct(F.lit("http.method").alias("key"), F.struct(F.col("http_method").alias("stringValue"),
                                                           F.lit(None).cast("string").alias("intValue")).alias("value")),
        *[F.struct(F.lit(k).alias("key"), F.struct(v.alias("stringValue"), iv.alias("intValue")).alias("value"))
          for k, v, iv in [
              ("http.target", F.col("http_path"), F.lit(None).cast("string")),
              ("http.status_code", F.lit(None).cast("string"), F.col("http_status").cast("string")),
              ("net.peer.ip", F.col("dst_ip"), F.lit(None).cast("string")),
              ("net.peer.port", F.lit(None).cast("string"), F.col("dst_port").cast("string")),
              ("net.host.ip", F.col("src_ip"), F.lit(None).cast("string")),
              (f"{prefix}.agent_id", F.col("agent_id"), F.lit(None).cast("string")),
              (f"{prefix}.hostname", F.col("hostname"), F.lit(None).cast("string"))]])
    return f.select(
        F.substring(hexid, 1, 32).alias("traceId"), F.substring(hexid, 1, 16).alias("spanId"),
        F.concat_ws(" ", "http_method", "http_path").alias("name"), F.lit(3).alias("kind"),
        start_ns.cast("string").alias("startTimeUnixNano"),
        (start_ns + F.col("duration_ms") * 1_000_000).cast("string").alias("endTimeUnixNano"),
        attrs.alias("attributes"),
        F.struct(F.when(F.col("http_status") >= 400, 2).otherwise(1).alias("code")).alias("status"),
        F.date_trunc("hour", "ts").alias("hour"))


def otlp_documents(spans: DataFrame, service: str = APP, sdk: str = f"{APP}-{PRODUCT}", version: str = "0.1.0",
                   spans_per_document: int = 1000) -> DataFrame:
    """ResourceSpans JSON documents: (hour, part, n_spans, document).

    The spans of an hour are dealt by their id over as many parts as it takes to
    hold about ``spans_per_document`` each, so no hour is one group.
    """
    parts = (spans.groupBy("hour").agg(F.count(F.lit(1)).alias("_n"))
             .select("hour", F.ceil(F.col("_n") / spans_per_document).alias("_parts")))
    g = (spans.join(parts, "hour").withColumn("part", F.pmod(F.xxhash64("spanId", "traceId", "startTimeUnixNano"), F.col("_parts")))
         .drop("_parts").groupBy("hour", "part")
         .agg(F.count(F.lit(1)).alias("n_spans"),
              F.collect_list(F.struct(*[c for c in spans.columns if c != "hour"])).alias("spans")))
    attrs = [F.struct(F.lit(k).alias("key"), F.struct(F.lit(v).alias("stringValue")).alias("value"))
             for k, v in (("service.name", service), ("telemetry.sdk.name", sdk))]
    scope = F.struct(F.lit(sdk).alias("name"), F.lit(version).alias("version"))
    doc = F.struct(F.array(F.struct(
        F.struct(F.array(*attrs).alias("attributes")).alias("resource"),
        F.array(F.struct(scope.alias("scope"), F.col("spans").alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))
    return g.select("hour", "part", "n_spans", F.to_json(doc, {"ignoreNullFields": "true"}).alias("document"))


def publish_frame(flows: DataFrame) -> DataFrame:
    """Kafka record shape: key = agent_id, value = JSON flow."""
    return flows.select(F.col("agent_id").alias("key"), F.to_json(F.struct(*flows.columns)).alias("value"))


# fixed values: retention in days per table kind
RETENTION_DAYS = {"flows": 90, "audit_events": 90, "storage_exports": 90, "report_runs": 90,
                  "alert_events": 30, "sigma_matches": 30, "anomaly_events": 30, "policy_violations": 30,
                  "cloud_flow_pull_log": 30}


def apply_retention(df: DataFrame, as_of: Column, table: str = "flows", ts: str = "ts",
                    days: int | None = None) -> DataFrame:
    """Rows still inside the retention period (write back with dynamic
    partition overwrite to drop expired months)."""
    d = days if days is not None else RETENTION_DAYS[table]
    return df.filter(F.col(ts) >= as_of - interval(f"{d} DAYS"))
