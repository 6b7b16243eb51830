"""Registered source / sink queries: cloud log parsing, ingest JSON, unions, exports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from flowlens.functions.timewin import as_of_col
from flowlens.operators import export as X
from flowlens.plans.catalog import finish, register
from flowlens.sources import cloud as CL
from flowlens.sources import ingest as IN
from flowlens.sources import testdata as td

NOW = "(SELECT max(ts) FROM flows)"
INGEST_TIME = dt.datetime(2024, 2, 1)


def W(body: str, **extra: str) -> str:
    return td.with_ctes(body, flows=td.FLOWS_SQL, **extra)


# AWS VPC flow-log lines derived from events, with the parser's edge rows
AWS_SQL = """
SELECT CASE
  WHEN event_id % 97 = 0 THEN 'version account-id interface-id srcaddr dstaddr srcport dstport protocol packets bytes start end action log-status'
  WHEN event_id % 89 = 0 THEN CONCAT_WS(' ', '2', '123456789012', 'eni-x', '-', '-', '-', '-', '-', '-', '-',
       CAST(1704067200 + event_id * 60 AS STRING), CAST(1704067260 + event_id * 60 AS STRING), '-', 'NODATA')
  WHEN event_id % 83 = 0 THEN CONCAT_WS(' ', '2', '123456789012', 'eni-x', '10.0.0.1', '10.0.0.2', '1', '2', '6', '1', '40',
       CAST(1704067200 + event_id * 60 AS STRING), CAST(1704067260 + event_id * 60 AS STRING), 'ACCEPT')
  ELSE CONCAT_WS(' ', '  2', '123456789012', CONCAT('eni-', CAST(user_id % 8 AS STRING)),
       CASE WHEN event_id % 79 = 0 THEN 'not-an-ip' ELSE CONCAT('10.0.', CAST(user_id % 8 AS STRING), '.', CAST(user_id % 256 AS STRING)) END,
       CONCAT('52.', CAST(event_id % 200 AS STRING), '.0.', CAST(user_id % 200 AS STRING)),
       CASE WHEN event_id % 71 = 0 THEN '-' ELSE CAST(1024 + event_id % 60000 AS STRING) END,
       CASE WHEN event_id % 61 = 0 THEN '70000' ELSE CAST(80 + event_id % 7 AS STRING) END,
       CASE event_id % 5 WHEN 0 THEN '6' WHEN 1 THEN '17' WHEN 2 THEN '1' WHEN 3 THEN '99' ELSE '58' END,
       CAST(1 + event_id % 9 AS STRING), CAST(CAST(FLOOR(value * 100) AS BIGINT) AS STRING),
       CASE WHEN event_id % 67 = 0 THEN '900000000' ELSE CAST(1704067200 + event_id * 60 AS STRING) END,
       CASE WHEN event_id % 67 = 0 THEN '900000100' ELSE CAST(1704067200 + event_id * 60 + (event_id % 3 - 1) * 30 AS STRING) END,
       CASE WHEN event_id % 4 = 0 THEN 'REJECT' ELSE 'ACCEPT' END, 'OK ') END AS value
FROM {events}
"""

V4 = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4RE = rf"{V4}\.{V4}\.{V4}\.{V4}"


def _duck_uint(e: str, cap: int | None = None) -> str:
    v = f"CAST({e} AS DECIMAL(20,0))"
    if cap:
        v = f"least({v}, {cap})"
    return f"CAST(CASE WHEN regexp_full_match({e}, '[0-9]{{1,19}}') THEN {v} ELSE 0 END AS BIGINT)"


@register("parse_aws_vpc", td.with_ctes(f"""
, p AS (SELECT string_split_regex(regexp_replace(value, '^\\s+|\\s+$', '', 'g'), '\\s+') AS f FROM aws),
q AS (SELECT *, {_duck_uint('f[10]')} AS b, CAST(f[11] AS BIGINT) AS st, CAST(f[12] AS BIGINT) AS en,
        {_duck_uint('f[8]', 255)} AS pn FROM p
      WHERE len(f) >= 14 AND f[1] != 'version' AND f[14] NOT IN ('NODATA', 'SKIPDATA')
        AND regexp_full_match(f[4], '{V4RE}') AND regexp_full_match(f[5], '{V4RE}'))
SELECT 'aws-1' AS agent_id, 'vpc-logs' AS hostname,
  CASE WHEN year(make_timestamp(st * 1000000)) < 2000 THEN TIMESTAMP '2024-02-01 00:00:00' ELSE make_timestamp(st * 1000000) END AS ts,
  CASE pn WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP' WHEN 58 THEN 'ICMPv6' WHEN 47 THEN 'GRE' WHEN 50 THEN 'ESP'
          ELSE 'PROTO_' || CAST(pn AS VARCHAR) END AS protocol,
  f[4] AS src_ip, CAST({_duck_uint('f[6]', 65535)} AS INTEGER) AS src_port,
  f[5] AS dst_ip, CAST({_duck_uint('f[7]', 65535)} AS INTEGER) AS dst_port,
  CAST(floor(b / 2) AS BIGINT) AS bytes_in, CAST(b - floor(b / 2) AS BIGINT) AS bytes_out,
  CAST(CASE WHEN en > st THEN (en - st) * 1000 ELSE 0 END AS BIGINT) AS duration_ms, f[13] AS action, 'aws-vpc' AS source
FROM q""", aws=AWS_SQL))
def q_parse_aws_vpc(spark, sf):
    lines = spark.sql(AWS_SQL, events=td.read_table(spark, sf, "events"))
    return CL.parse_aws_vpc(lines, "aws-1", "vpc-logs", ingest_time=INGEST_TIME).drop("id")


# GCP entries as JSON text: optional jsonPayload wrapper, numbers as strings or
# numbers, float byte counts, empty protocol, missing connection, end < start
GCP_SQL = """
SELECT CASE WHEN event_id % 2 = 0 THEN CONCAT('{{"jsonPayload":', j, '}}') ELSE j END AS value FROM (
  SELECT event_id, CONCAT('{{',
    CASE WHEN event_id % 53 = 0 THEN '' ELSE CONCAT('"connection":{{"src_ip":"10.2.', CAST(user_id % 200 AS STRING),
      '.1","dest_ip":"34.', CAST(event_id % 250 AS STRING), '.1.1","src_port":',
      CASE WHEN event_id % 3 = 0 THEN CONCAT('"', CAST(1024 + event_id % 5000 AS STRING), '"') ELSE CAST(1024 + event_id % 5000 AS STRING) END,
      ',"dest_port":', CAST(443 + event_id % 3 AS STRING), ',"protocol":"',
      CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 2 = 0 THEN 'tcp' ELSE 'udp' END, '"}},') END,
    '"bytes_sent":', CASE WHEN event_id % 5 = 0 THEN CONCAT(CAST(CAST(FLOOR(value * 10) AS BIGINT) AS STRING), '.0')
                          ELSE CONCAT('"', CAST(CAST(FLOOR(value * 10) AS BIGINT) AS STRING), '"') END,
    ',"start_time":"2024-01-', LPAD(CAST(1 + event_id % 28 AS STRING), 2, '0'), 'T',
    LPAD(CAST(event_id % 24 AS STRING), 2, '0'), ':', LPAD(CAST(event_id % 60 AS STRING), 2, '0'), ':',
    CASE WHEN event_id % 11 = 0 THEN '30' ELSE '00' END, 'Z","end_time":"2024-01-', LPAD(CAST(1 + event_id % 28 AS STRING), 2, '0'), 'T',
    LPAD(CAST(event_id % 24 AS STRING), 2, '0'), ':', LPAD(CAST(event_id % 60 AS STRING), 2, '0'), ':',
    CASE WHEN event_id % 11 = 0 THEN '10' ELSE '45' END, 'Z"}}') AS j
  FROM {events}) x
"""


@register("parse_gcp_vpc", """
SELECT 'gcp-1' AS agent_id, 'gcp-logs' AS hostname,
  make_timestamp(2024, 1, CAST(1 + event_id % 28 AS INTEGER), CAST(event_id % 24 AS INTEGER), CAST(event_id % 60 AS INTEGER),
                 CASE WHEN event_id % 11 = 0 THEN 30 ELSE 0 END) AS ts,
  CASE WHEN event_id % 7 = 0 THEN 'TCP' WHEN event_id % 2 = 0 THEN 'TCP' ELSE 'UDP' END AS protocol,
  '10.2.' || CAST(user_id % 200 AS VARCHAR) || '.1' AS src_ip, CAST(1024 + event_id % 5000 AS INTEGER) AS src_port,
  '34.' || CAST(event_id % 250 AS VARCHAR) || '.1.1' AS dst_ip, CAST(443 + event_id % 3 AS INTEGER) AS dst_port,
  CAST(floor(floor(value * 10) / 2) AS BIGINT) AS bytes_in,
  CAST(floor(value * 10) - floor(floor(value * 10) / 2) AS BIGINT) AS bytes_out,
  CAST(CASE WHEN event_id % 11 = 0 THEN 0 ELSE 45000 END AS BIGINT) AS duration_ms, 'gcp-vpc' AS source
FROM events WHERE event_id % 53 != 0""")
def q_parse_gcp_vpc(spark, sf):
    docs = spark.sql(GCP_SQL, events=td.read_table(spark, sf, "events"))
    return CL.parse_gcp_vpc(docs, "gcp-1", "gcp-logs", ingest_time=INGEST_TIME).drop("id")


def azure_docs(spark, sf):
    ev = td.read_table(spark, sf, "events")
    epoch = (F.lit(1704067200) + F.col("event_id") * 60).cast("string")
    src = F.concat(F.lit("10.3."), (F.col("user_id") % 200).cast("string"), F.lit(".1"))
    dst = F.when(F.col("event_id") % 59 == 0, F.lit("bad-ip")).otherwise(
        F.concat(F.lit("20."), (F.col("event_id") % 250).cast("string"), F.lit(".0.1")))
    proto = F.when(F.col("event_id") % 3 == 0, "U").when(F.col("event_id") % 3 == 1, "T").otherwise("X")
    base = F.concat_ws(",", epoch, src, dst, (F.col("event_id") % 60000).cast("string"), F.lit("443"), proto,
                       F.lit("O"), F.lit("A"))
    t8 = base
    t9 = F.concat_ws(",", base, F.lit("B"))
    t13 = F.concat_ws(",", base, F.lit("E"), F.lit("3"), (F.floor(F.col("value") * 10)).cast("bigint").cast("string"),
                      F.lit("2"), (F.floor(F.col("value") * 3)).cast("bigint").cast("string"))
    doc = F.struct(F.array(F.struct(F.struct(F.array(F.struct(
        F.lit("rule").alias("rule"), F.array(F.struct(F.lit("m").alias("mac"),
                                                     F.array(t8, t9, t13).alias("flowTuples"))).alias("flows")))
        .alias("flows")).alias("properties"))).alias("records"))
    return ev.select(F.to_json(doc).alias("value"))


@register("parse_azure_nsg", """
WITH b AS (SELECT event_id, make_timestamp((1704067200 + event_id * 60) * 1000000) AS ts,
             CASE WHEN event_id % 3 = 0 THEN 'UDP' ELSE 'TCP' END AS protocol,
             '10.3.' || CAST(user_id % 200 AS VARCHAR) || '.1' AS src_ip, CAST(event_id % 60000 AS INTEGER) AS src_port,
             '20.' || CAST(event_id % 250 AS VARCHAR) || '.0.1' AS dst_ip, 443 AS dst_port, value
           FROM events WHERE event_id % 59 != 0)
SELECT 'az-1' AS agent_id, 'nsg-logs' AS hostname, ts, protocol, src_ip, src_port, dst_ip, dst_port,
  CAST(0 AS BIGINT) AS bytes_in, CAST(0 AS BIGINT) AS bytes_out, CAST(0 AS BIGINT) AS duration_ms, 'azure-nsg' AS source FROM b
UNION ALL
SELECT 'az-1', 'nsg-logs', ts, protocol, src_ip, src_port, dst_ip, dst_port,
  CAST(floor(value * 3) AS BIGINT), CAST(floor(value * 10) AS BIGINT), CAST(0 AS BIGINT), 'azure-nsg' FROM b""")
def q_parse_azure_nsg(spark, sf):
    return CL.parse_azure_nsg(azure_docs(spark, sf), "az-1", "nsg-logs", ingest_time=INGEST_TIME).drop("id")


def envelopes(spark, sf):
    """One ingest envelope per flow; every third flow omits agent/hostname
    (back-filled from the envelope), every 50th has no timestamp."""
    f = td.flows(spark, sf)
    eid = F.substring("id", 25, 12).cast("bigint")
    http = F.when(F.col("http_method") != "", F.struct(F.col("http_method").alias("method"),
                                                       F.col("http_path").alias("path"),
                                                       F.col("http_status").alias("status"),
                                                       F.col("duration_ms").alias("latency_ms")))
    dns = F.when(F.col("dns_query") != "", F.struct(F.col("dns_query").alias("query_name"),
                                                    F.col("dns_type").alias("query_type"),
                                                    F.lit(False).alias("is_response"),
                                                    F.col("dns_rcode").alias("rcode")))
    flow = F.struct("id", F.when(eid % 3 == 0, F.lit("")).otherwise(F.col("agent_id")).alias("agent_id"),
                    F.when(eid % 3 == 0, F.lit("")).otherwise(F.col("hostname")).alias("hostname"),
                    F.when(eid % 50 == 0, F.lit("")).otherwise(
                        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("timestamp"),
                    "protocol", "src_ip", "src_port", "dst_ip", "dst_port", "bytes_in", "bytes_out", "duration_ms",
                    http.alias("http"), dns.alias("dns"))
    env = F.struct("agent_id", "hostname", F.array(flow).alias("flows"))
    return f.select(F.to_json(env).alias("value"))


@register("read_ingest_json", W(f"""
SELECT id, agent_id, hostname,
  CASE WHEN CAST(right(id, 12) AS BIGINT) % 50 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' ELSE ts END AS ts,
  protocol, src_ip, dst_ip, dst_port, http_method, http_path, CASE WHEN http_method != '' THEN http_status ELSE 0 END AS http_status,
  dns_query, dns_type, CASE WHEN dns_query != '' THEN dns_rcode ELSE -1 END AS dns_rcode,
  CASE WHEN http_method != '' THEN http_method || ' ' || http_path WHEN dns_query != '' THEN dns_query || ' ' || dns_type
       ELSE '' END AS info, 'agent' AS source
FROM flows"""))
def q_read_ingest_json(spark, sf):
    nested = IN.read_ingest_json(envelopes(spark, sf), ingest_time=INGEST_TIME)
    flat = IN.flatten_flow(nested)
    return flat.select("id", "agent_id", "hostname", "ts", "protocol", "src_ip", "dst_ip", "dst_port",
                       "http_method", "http_path", "http_status", "dns_query", "dns_type", "dns_rcode", "info", "source")


@register("union_sources", td.with_ctes("""
SELECT 'agent' AS source, count(*) AS n FROM flows
UNION ALL SELECT 'aws-vpc', count(*) FROM (
  SELECT string_split_regex(regexp_replace(value, '^\\s+|\\s+$', '', 'g'), '\\s+') AS f FROM aws) p
  WHERE len(f) >= 14 AND f[1] != 'version' AND f[14] NOT IN ('NODATA', 'SKIPDATA') AND f[4] != 'not-an-ip'""",
    flows=td.FLOWS_SQL, aws=AWS_SQL))
def q_union_sources(spark, sf):
    lines = spark.sql(AWS_SQL, events=td.read_table(spark, sf, "events"))
    aws = CL.to_flows(CL.parse_aws_vpc(lines, "aws-1", "vpc-logs", ingest_time=INGEST_TIME))
    agent = td.flows(spark, sf).drop("source")
    return IN.union_sources(agent, aws).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@register("upsert_agents_from_flows", W("""
SELECT agent_id, arg_max(hostname, (ts, id)) AS hostname, max(ts) AS last_seen FROM flows
WHERE agent_id != '' GROUP BY agent_id"""))
def q_upsert_agents_from_flows(spark, sf):
    return X.upsert_agents_from_flows(td.flows(spark, sf))


EXPORT_FROM, EXPORT_TO = dt.datetime(2024, 1, 20), dt.datetime(2024, 1, 22, 6)
EXPORT_RANGE = f"ts >= TIMESTAMP '{EXPORT_FROM}' AND ts < TIMESTAMP '{EXPORT_TO}'"


@register("export_log", W(f"""
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
  strftime(min(ts), 'flows/yyyy=%Y/MM=%m/dd=%d/HH=%H') AS key, count(*) AS row_count, '' AS error
FROM flows WHERE {EXPORT_RANGE} GROUP BY date_trunc('hour', ts)"""))
def q_export_log(spark, sf):
    return X.export_log(X.export_frame(td.flows(spark, sf), EXPORT_FROM, EXPORT_TO))


@register("export_rows", W(f"""
SELECT {", ".join(X.EXPORT_COLUMNS)}, strftime(ts, '%Y') AS yyyy, strftime(ts, '%m') AS MM, strftime(ts, '%d') AS dd,
  strftime(ts, '%H') AS HH FROM flows WHERE {EXPORT_RANGE}"""))
def q_export_rows(spark, sf):
    return X.export_frame(td.flows(spark, sf), EXPORT_FROM, EXPORT_TO)


@register("export_audit_json", td.with_ctes("""
SELECT id, token_id, role, method, path, status, client_ip, latency_ms, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts
FROM audit""", audit=td.AUDIT_SQL))
def q_export_audit_json(spark, sf):
    lines = X.export_audit(td.audit_events(spark, sf), "json")
    fields = "id string, token_id string, role string, method string, path string, status int, client_ip string, latency_ms int, ts string"
    return lines.select(F.from_json("line", fields).alias("j")).select("j.*")


@register("export_audit_cef", td.with_ctes(f"""
SELECT ts, id, printf('CEF:0|{X.VENDOR}|{X.PRODUCT}|1.0|%s|%s %s|%d|rt=%d src=%s requestMethod=%s request=%s outcome=%d act=%s dproc=%s deviceCustomNumber1=%d deviceCustomNumber1Label=latency_ms',
  id, method, path, CASE WHEN status >= 500 THEN 7 WHEN status >= 400 THEN 5 ELSE 3 END, epoch_ms(ts), client_ip,
  method, path, status, role, token_id, latency_ms) AS line
FROM audit WHERE ts >= TIMESTAMP '2024-01-05 00:00:00'""", audit=td.AUDIT_SQL))
def q_export_audit_cef(spark, sf):
    return X.export_audit(td.audit_events(spark, sf), "cef", start=dt.datetime(2024, 1, 5))


@register("export_audit_leef", td.with_ctes(f"""
SELECT ts, id, printf('LEEF:2.0|{X.VENDOR}|{X.PRODUCT}|1.0|%s %s' || chr(9) || 'devTime=%s' || chr(9)
  || 'devTimeFormat=yyyy-MM-dd''T''HH:mm:ss.SSS''Z''' || chr(9) || 'src=%s' || chr(9) || 'requestMethod=%s' || chr(9)
  || 'request=%s' || chr(9) || 'statusCode=%d' || chr(9) || 'role=%s' || chr(9) || 'tokenId=%s' || chr(9) || 'latencyMs=%d',
  method, path, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z', client_ip, method, path, status, role, token_id, latency_ms) AS line
FROM audit""", audit=td.AUDIT_SQL))
def q_export_audit_leef(spark, sf):
    return X.export_audit(td.audit_events(spark, sf), "leef")


@register("siem_splunk", td.with_ctes(f"""
SELECT id, epoch_ms(ts) / 1000.0 AS time, '{X.APP}' AS source, '{X.APP}:audit' AS sourcetype, 'hub-api' AS host,
  'main' AS index, token_id, role, method, path, status, client_ip, latency_ms FROM audit""", audit=td.AUDIT_SQL))
def q_siem_splunk(spark, sf):
    p = X.siem_payload(td.audit_events(spark, sf), "splunk", index="main")
    event = "id string, token_id string, role string, method string, path string, status int, client_ip string, latency_ms int"
    j = p.select(F.from_json("payload", f"time double, source string, sourcetype string, host string, index string, event struct<{event.replace(' ', ':').replace(',:', ',')}>").alias("j"))
    return j.select("j.event.id", "j.time", "j.source", "j.sourcetype", "j.host", "j.index",
                    *[f"j.event.{c}" for c in ("token_id", "role", "method", "path", "status", "client_ip", "latency_ms")])


@register("siem_elastic", td.with_ctes("""
SELECT id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS at, method || ' ' || path AS action, 'web' AS category, 'access' AS kind,
  CASE WHEN status >= 400 THEN 'failure' ELSE 'success' END AS outcome, CAST(latency_ms AS BIGINT) * 1000000 AS duration,
  client_ip AS ip, method, path AS target, status AS status_code, token_id, role, latency_ms FROM audit""", audit=td.AUDIT_SQL))
def q_siem_elastic(spark, sf):
    p = X.siem_payload(td.audit_events(spark, sf), "elastic").select("payload")
    j = lambda path, kind="string": F.get_json_object("payload", path).cast(kind)
    return p.select(j(f"$.{X.APP}.id").alias("id"), j("$.@timestamp").alias("at"), j("$.event.action").alias("action"),
                    j("$.event.category[0]").alias("category"), j("$.event.type[0]").alias("kind"),
                    j("$.event.outcome").alias("outcome"), j("$.event.duration", "bigint").alias("duration"),
                    j("$.source.ip").alias("ip"), j("$.http.request.method").alias("method"),
                    j("$.http.request.target").alias("target"), j("$.http.response.status_code", "int").alias("status_code"),
                    j(f"$.{X.APP}.token_id").alias("token_id"), j(f"$.{X.APP}.role").alias("role"),
                    j(f"$.{X.APP}.latency_ms", "int").alias("latency_ms"))


@register("siem_datadog", td.with_ctes(f"""
SELECT id, '{X.APP}' AS ddsource, 'role:' || role || ',method:' || method || ',status:' || CAST(status AS VARCHAR) AS ddtags,
  'hub-api' AS service, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at,
  printf('%s %s → %d (%dms) [%s]', method, path, status, latency_ms, role) AS message, client_ip FROM audit""",
    audit=td.AUDIT_SQL))
def q_siem_datadog(spark, sf):
    p = X.siem_payload(td.audit_events(spark, sf), "datadog").select("payload")
    j = lambda path: F.get_json_object("payload", path)
    return p.select(j("$.attributes.id").alias("id"), j("$.ddsource").alias("ddsource"), j("$.ddtags").alias("ddtags"),
                    j("$.service").alias("service"), j("$.timestamp").alias("at"), j("$.message").alias("message"),
                    j("$.attributes.client_ip").alias("client_ip"))


@register("siem_loki", td.with_ctes("""
SELECT id, CAST(epoch_us(ts) * 1000 AS VARCHAR) AS at,
  printf('method=%s path="%s" status=%d role=%s client_ip=%s latency_ms=%d token_id=%s', method, path, status, role, client_ip,
         latency_ms, token_id) AS line FROM audit""", audit=td.AUDIT_SQL))
def q_siem_loki(spark, sf):
    p = X.siem_payload(td.audit_events(spark, sf), "loki")
    v = F.from_json("payload", "array<string>")
    return p.select("id", v[0].alias("at"), v[1].alias("line"))


@register("incremental_cursor", W("""
SELECT * FROM flows WHERE ts > TIMESTAMP '2024-01-15 08:00:00'
  OR (ts = TIMESTAMP '2024-01-15 08:00:00' AND id > '00000000-0000-0000-0000-000000000000')
ORDER BY ts, id LIMIT 500"""))
def q_incremental_cursor(spark, sf):
    return X.incremental_cursor(td.flows(spark, sf), "2024-01-15 08:00:00", "00000000-0000-0000-0000-000000000000")


@register("to_otel_spans", W(f"""
SELECT left(replace(id, '-', ''), 32) AS traceId, left(replace(id, '-', ''), 16) AS spanId,
  http_method || ' ' || http_path AS name, 3 AS kind, CAST(epoch_us(ts) * 1000 AS VARCHAR) AS startTimeUnixNano,
  CAST(epoch_us(ts) * 1000 + duration_ms * 1000000 AS VARCHAR) AS endTimeUnixNano,
  CASE WHEN http_status >= 400 THEN 2 ELSE 1 END AS status_code
FROM flows WHERE protocol IN ('HTTP', 'HTTPS') AND http_method != '' AND ts >= {NOW} - INTERVAL 7 DAYS"""))
def q_to_otel_spans(spark, sf):
    s = X.to_otel_spans(td.flows(spark, sf), window="7d")
    return s.select("traceId", "spanId", "name", "kind", "startTimeUnixNano", "endTimeUnixNano",
                    F.col("status.code").alias("status_code"))


SPAN_ATTRIBUTES = [("http.method", "http_method"), ("http.target", "http_path"), ("http.status_code", "http_status"),
                   ("net.peer.ip", "dst_ip"), ("net.peer.port", "dst_port"), ("net.host.ip", "src_ip"),
                   (f"{X.APP}.agent_id", "agent_id"), (f"{X.APP}.hostname", "hostname")]


@register("otlp_documents", W(f"""
SELECT '{X.APP}' AS service, '{X.APP}-{X.PRODUCT}' AS sdk, '{X.APP}-{X.PRODUCT}' AS scope, '0.1.0' AS version,
  left(replace(id, '-', ''), 32) AS traceId, left(replace(id, '-', ''), 16) AS spanId, http_method || ' ' || http_path AS name,
  CAST(epoch_us(ts) * 1000 AS VARCHAR) AS startTimeUnixNano,
  '{",".join(k for k, _ in SPAN_ATTRIBUTES)}' AS keys,
  concat_ws('|', {", ".join(f"CAST({c} AS VARCHAR)" for _, c in SPAN_ATTRIBUTES)}) AS "values"
FROM flows WHERE protocol IN ('HTTP', 'HTTPS') AND http_method != '' AND ts >= {NOW} - INTERVAL 30 DAYS"""))
def q_otlp_documents(spark, sf):
    """The spans of all documents, read back from their JSON with resource and scope."""
    docs = X.otlp_documents(X.to_otel_spans(td.flows(spark, sf), window="30d"))
    value = "struct<stringValue:string,intValue:string>"
    attrs = f"array<struct<key:string,value:{value}>>"
    span = f"struct<traceId:string,spanId:string,name:string,startTimeUnixNano:string,attributes:{attrs}>"
    kind = (f"struct<resourceSpans:array<struct<resource:struct<attributes:{attrs}>,"
            f"scopeSpans:array<struct<scope:struct<name:string,version:string>,spans:array<{span}>>>>>>")
    r = docs.select(F.from_json("document", kind)["resourceSpans"][0].alias("r"))
    r = r.select("r.resource.attributes", F.col("r.scopeSpans")[0].alias("s"))
    # columns of their own before the explode: a row that kept `s` would carry every span of its document
    r = r.select(F.col("attributes")[0]["value"]["stringValue"].alias("service"),
                 F.col("attributes")[1]["value"]["stringValue"].alias("sdk"), F.col("s.scope.name").alias("scope"),
                 F.col("s.scope.version").alias("version"), F.col("s.spans").alias("spans"))
    r = r.select("service", "sdk", "scope", "version", F.explode("spans").alias("p"))
    text = F.transform("p.attributes", lambda a: F.coalesce(a["value"]["stringValue"], a["value"]["intValue"]))
    return r.select("service", "sdk", "scope", "version", "p.traceId", "p.spanId", "p.name", "p.startTimeUnixNano",
                    F.array_join(F.transform("p.attributes", lambda a: a["key"]), ",").alias("keys"),
                    F.array_join(text, "|").alias("values"))


FRAME_COLUMNS = ["id", "ts", "protocol", "src_ip", "src_port", "dst_ip", "dst_port", "bytes_in", "bytes_out", "http_status", "pid"]


@register("publish_frame", W(f"""
SELECT agent_id AS key, {", ".join(c for c in FRAME_COLUMNS if c != "ts")},
  strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at FROM flows"""))
def q_publish_frame(spark, sf):
    """Kafka records, their values read back from JSON."""
    p = X.publish_frame(td.flows(spark, sf))
    j = F.from_json("value", "id string, ts timestamp, protocol string, src_ip string, src_port int, dst_ip string, "
                             "dst_port int, bytes_in long, bytes_out long, http_status int, pid long")
    return p.select("key", j.alias("j")).select("key", *[f"j.{c}" for c in FRAME_COLUMNS if c != "ts"],
                                                F.date_format("j.ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))


@register("apply_retention", W(f"""
SELECT count(*) AS kept FROM flows WHERE ts >= {NOW} - INTERVAL 20 DAYS"""))
def q_apply_retention(spark, sf):
    f = td.flows(spark, sf)
    return X.apply_retention(f, as_of_col(f), days=20).agg(F.count(F.lit(1)).alias("kept"))


@register("export_flows_csv", W("""
, t AS (SELECT *, CASE WHEN protocol = 'TLS' OR dst_port = 443 THEN 1 END AS tls FROM flows)
SELECT id, ts, agent_id, hostname, protocol, src_ip, src_port, dst_ip, dst_port, bytes_in, bytes_out, duration_ms,
  COALESCE(tls * 0 || '', '') || CASE WHEN tls = 1 THEN '.' || dst_ip || '.example.com' ELSE '' END AS tls_sni,
  CASE WHEN tls = 1 THEN CASE WHEN src_port % 2 = 0 THEN 'TLS 1.3' ELSE 'TLS 1.2' END ELSE '' END AS tls_version,
  CASE WHEN tls = 1 AND src_port % 3 != 0 THEN 'svc-' || CAST(src_port % 20 AS VARCHAR) ELSE '' END AS tls_cert_cn,
  CASE WHEN tls = 1 AND src_port % 3 != 0 THEN '2024-0' || CAST(1 + src_port % 9 AS VARCHAR) || '-01' ELSE '' END AS tls_cert_expiry,
  COALESCE(tls = 1 AND src_port % 5 = 0, FALSE) AS tls_weak_cipher FROM t"""))
def q_export_flows_csv(spark, sf):
    from flowlens.schema import TLS
    port = F.col("src_port")
    cert = port % 3 != 0
    own = {"sni": F.concat(F.lit("0."), "dst_ip", F.lit(".example.com")),
           "version": F.when(port % 2 == 0, "TLS 1.3").otherwise("TLS 1.2"),
           "cert_cn": F.when(cert, F.concat(F.lit("svc-"), (port % 20).cast("string"))),
           "cert_expiry": F.when(cert, F.concat(F.lit("2024-0"), (1 + port % 9).cast("string"), F.lit("-01"))),
           "has_weak_cipher": port % 5 == 0}
    tls = F.struct(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TLS.fields])
    f = td.flows(spark, sf)
    return X.export_flows_csv(f.withColumn("tls", F.when((F.col("protocol") == "TLS") | (F.col("dst_port") == 443), tls)))
