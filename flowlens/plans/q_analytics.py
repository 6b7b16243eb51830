"""Registered analytics queries (dashboards, endpoints, service graph, compliance views)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.ip import duck_is_external_like
from flowlens.operators import aggregate as agg
from flowlens.plans.catalog import finish, register
from flowlens.sources import testdata as td

NOW = "(SELECT max(ts) FROM flows)"


def W(body: str, **extra: str) -> str:
    return td.with_ctes(body, flows=td.FLOWS_SQL, **extra)


@register("endpoint_stats", W(f"""
SELECT http_method, http_path, count(*) AS total,
  count(*) FILTER (WHERE http_status >= 200 AND http_status < 400) AS success_count,
  count(*) FILTER (WHERE http_status >= 400) AS error_count,
  ROUND(count(*) FILTER (WHERE http_status >= 400) / count(*) * 100.0, 6) AS error_rate,
  ROUND(avg(duration_ms), 6) AS avg_latency,
  ROUND(quantile_cont(duration_ms, 0.5), 6) AS p50,
  ROUND(quantile_cont(duration_ms, 0.95), 6) AS p95,
  ROUND(quantile_cont(duration_ms, 0.99), 6) AS p99
FROM flows
WHERE protocol IN ('HTTP', 'HTTPS') AND ts >= {NOW} - INTERVAL 7 DAYS
  AND http_method != '' AND http_path != ''
GROUP BY http_method, http_path
ORDER BY total DESC, http_method, http_path LIMIT 100"""))
def q_endpoint_stats(spark, sf):
    return finish(agg.endpoint_stats(td.flows(spark, sf), window="7d", k=100))


@register("endpoint_summary", W(f"""
, ep AS (
  SELECT http_method, http_path, count(*) AS total,
    count(*) FILTER (WHERE http_status >= 400) AS error_count,
    count(*) FILTER (WHERE http_status >= 400) / count(*) * 100.0 AS error_rate,
    avg(duration_ms) AS avg_latency, quantile_cont(duration_ms, 0.95) AS p95
  FROM flows WHERE protocol IN ('HTTP', 'HTTPS') AND ts >= {NOW} - INTERVAL 30 DAYS
    AND http_method != '' AND http_path != ''
  GROUP BY http_method, http_path)
SELECT CAST(sum(total) AS BIGINT) AS total_requests, CAST(sum(error_count) AS BIGINT) AS total_errors,
  ROUND(avg(error_rate), 6) AS avg_error_rate,
  ROUND(sum(avg_latency * total) / sum(total), 6) AS weighted_avg_latency,
  ROUND(avg(p95), 6) AS mean_p95, count(*) AS endpoints
FROM ep"""))
def q_endpoint_summary(spark, sf):
    ep = agg.endpoint_stats(td.flows(spark, sf), window="30d", k=None)
    return finish(agg.endpoint_summary(ep))


@register("endpoint_stats_nearest_rank", W("""
SELECT COALESCE(NULLIF(hostname, ''), dst_ip) AS host, http_method, http_path, count(*) AS count,
  count(*) FILTER (WHERE http_status >= 400) AS errors,
  CAST(quantile_disc(duration_ms, 0.5) AS DOUBLE) AS p50,
  CAST(quantile_disc(duration_ms, 0.95) AS DOUBLE) AS p95,
  CAST(quantile_disc(duration_ms, 0.99) AS DOUBLE) AS p99,
  ROUND(avg(duration_ms), 6) AS avg_latency
FROM flows WHERE http_method != ''
GROUP BY 1, 2, 3"""))
def q_endpoint_stats_nearest_rank(spark, sf):
    return finish(agg.endpoint_stats_nearest_rank(td.flows(spark, sf)))


@register("traffic_stats", W(f"""
SELECT (SELECT count(*) FROM flows) AS total_flows,
  (SELECT count(*) FROM flows WHERE ts > {NOW} - INTERVAL 60 SECONDS) AS flows_per_minute,
  (SELECT count(DISTINCT agent_id) FROM agents WHERE last_seen > {NOW} - INTERVAL 5 MINUTES) AS active_agents
""", agents=td.AGENTS_SQL))
def q_traffic_stats(spark, sf):
    return agg.traffic_stats(td.flows(spark, sf), td.agents(spark, sf))


@register("top_protocols", W("""
SELECT protocol, count(*) AS cnt, ROUND(count(*) * 100.0 / (SELECT count(*) FROM flows), 6) AS share_pct
FROM flows GROUP BY protocol ORDER BY cnt DESC, protocol LIMIT 5"""))
def q_top_protocols(spark, sf):
    return finish(agg.top_protocols(td.flows(spark, sf), k=5))


@register("protocol_breakdown", W(f"""
, f AS (SELECT * FROM flows WHERE ts >= {NOW} - INTERVAL 168 HOURS)
SELECT protocol, count(*) AS cnt, ROUND(count(*) * 100.0 / (SELECT count(*) FROM f), 6) AS share_pct
FROM f GROUP BY protocol ORDER BY cnt DESC, protocol LIMIT 20"""))
def q_protocol_breakdown(spark, sf):
    return finish(agg.top_protocols(td.flows(spark, sf), k=20, hours=168))


@register("top_sources", W("""
SELECT src_ip, count(*) AS cnt FROM flows GROUP BY src_ip ORDER BY cnt DESC, src_ip LIMIT 5"""))
def q_top_sources(spark, sf):
    return agg.top_sources(td.flows(spark, sf), k=5)


@register("top_talkers_bytes", W(f"""
SELECT src_ip, count(*) AS flow_count, CAST(sum(bytes_in + bytes_out) AS BIGINT) AS total_bytes
FROM flows WHERE ts > {NOW} - INTERVAL 7 DAYS
GROUP BY src_ip ORDER BY total_bytes DESC, src_ip LIMIT 25"""))
def q_top_talkers_bytes(spark, sf):
    return agg.top_talkers(td.flows(spark, sf), window="7d", by="bytes", k=25)


@register("top_talkers_flows", W(f"""
SELECT src_ip, count(*) AS flow_count, CAST(sum(bytes_in + bytes_out) AS BIGINT) AS total_bytes
FROM flows WHERE ts > {NOW} - INTERVAL 24 HOURS
GROUP BY src_ip ORDER BY flow_count DESC, src_ip LIMIT 99"""))
def q_top_talkers_flows(spark, sf):
    return agg.top_talkers(td.flows(spark, sf), window="24h", by="flows", k=99)


@register("exfil_talkers", W(f"""
SELECT src_ip, min(hostname) AS hostname, CAST(sum(bytes_out) AS BIGINT) AS bytes_out,
  CAST(sum(bytes_in) AS BIGINT) AS bytes_in, count(*) AS flow_count,
  count(DISTINCT dst_ip) AS unique_destinations
FROM flows WHERE ts >= {NOW} - INTERVAL 7 DAYS
GROUP BY src_ip ORDER BY bytes_out DESC, src_ip LIMIT 20"""))
def q_exfil_talkers(spark, sf):
    return agg.exfil_talkers(td.flows(spark, sf), window="7d")


@register("timeseries", W(f"""
SELECT date_trunc('minute', ts) AS minute, count(*) AS cnt,
  CAST(sum(bytes_in) AS BIGINT) AS bytes_in, CAST(sum(bytes_out) AS BIGINT) AS bytes_out
FROM flows WHERE ts >= {NOW} - INTERVAL 24 HOURS
GROUP BY 1"""))
def q_timeseries(spark, sf):
    return agg.timeseries(td.flows(spark, sf), hours=24)


@register("timeseries_filled", W(f"""
, f AS (SELECT *, date_trunc('minute', ts) AS minute FROM flows WHERE ts >= {NOW} - INTERVAL 48 HOURS)
SELECT m.minute, count(f.id) AS cnt, CAST(COALESCE(sum(bytes_in), 0) AS BIGINT) AS bytes_in,
  CAST(COALESCE(sum(bytes_out), 0) AS BIGINT) AS bytes_out
FROM (SELECT unnest(generate_series((SELECT min(minute) FROM f), (SELECT max(minute) FROM f), INTERVAL 1 MINUTE)) AS minute) m
LEFT JOIN f ON f.minute = m.minute GROUP BY m.minute"""))
def q_timeseries_filled(spark, sf):
    return agg.timeseries(td.flows(spark, sf), hours=48, fill=True)


@register("service_edges", W(f"""
SELECT src_ip, dst_ip, protocol, count(*) AS flow_count, ROUND(avg(duration_ms), 6) AS avg_latency_ms,
  CAST(sum(bytes_in + bytes_out) AS BIGINT) AS bytes_total
FROM flows WHERE ts >= {NOW} - INTERVAL 7 DAYS
GROUP BY 1, 2, 3 ORDER BY flow_count DESC, src_ip, dst_ip, protocol LIMIT 300"""))
def q_service_edges(spark, sf):
    return finish(agg.service_edges(td.flows(spark, sf), window="7d"))


@register("service_nodes", W(f"""
, e AS (SELECT src_ip, dst_ip, protocol, count(*) AS flow_count FROM flows
        WHERE ts >= {NOW} - INTERVAL 7 DAYS GROUP BY 1, 2, 3
        ORDER BY flow_count DESC, src_ip, dst_ip, protocol LIMIT 300)
SELECT ip, CAST(sum(flow_count) AS BIGINT) AS flow_count FROM (
  SELECT src_ip AS ip, flow_count FROM e UNION ALL SELECT dst_ip AS ip, flow_count FROM e) x
WHERE ip != '' GROUP BY ip"""))
def q_service_nodes(spark, sf):
    return agg.service_nodes(agg.service_edges(td.flows(spark, sf), window="7d"))


@register("service_map_nodes", W("""
, g AS (SELECT *, CASE WHEN country_code != '' THEN 'AS of ' || country_code || CAST(src_port % 3 AS VARCHAR) ELSE '' END AS org FROM flows),
ends AS (
  SELECT src_ip AS ip, ts, protocol, bytes_in + bytes_out AS bytes, '' AS country_code, '' AS org FROM g
  UNION ALL SELECT dst_ip AS ip, ts, protocol, bytes_in + bytes_out AS bytes, country_code, org FROM g)
SELECT ip, count(*) AS flows, CAST(sum(bytes) AS BIGINT) AS bytes,
  array_to_string(list_sort(list_distinct(list(protocol))), ',') AS protocols,
  arg_min(country_code, (ts, country_code)) FILTER (WHERE country_code != '') AS country_code,
  arg_min(org, (ts, org)) FILTER (WHERE org != '') AS as_org
FROM ends WHERE ip != '' GROUP BY ip"""))
def q_service_map_nodes(spark, sf):
    f = td.flows(spark, sf)
    org = F.when(F.col("country_code") != "", F.concat(F.lit("AS of "), "country_code", (F.col("src_port") % 3).cast("string")))
    return agg.service_map_nodes(f.withColumn("as_org", F.coalesce(org, F.lit(""))))


@register("external_destinations", W(f"""
SELECT dst_ip, arg_max(dst_port, (ts, id)) AS dst_port, arg_max(protocol, (ts, id)) AS protocol,
  count(*) AS flow_count, CAST(sum(bytes_out) AS BIGINT) AS bytes_out, max(ts) AS last_seen,
  array_to_string(list_slice(list_sort(list_distinct(list(src_ip))), 1, 5), ',') AS src_ips
FROM flows WHERE ts >= {NOW} - INTERVAL 7 DAYS AND {duck_is_external_like('dst_ip')} AND dst_ip != '::1'
GROUP BY dst_ip ORDER BY bytes_out DESC, dst_ip LIMIT 100"""))
def q_external_destinations(spark, sf):
    return finish(agg.external_destinations(td.flows(spark, sf), window="7d"))


@register("geo_summary", W(f"""
SELECT country_code, max(country_name) AS country_name, count(*) AS connections,
  CAST(sum(bytes_out) AS BIGINT) AS bytes_out, count(DISTINCT src_ip) AS unique_sources,
  max(threat_score) AS max_threat_score
FROM flows WHERE ts >= {NOW} - INTERVAL 30 DAYS AND country_code != ''
GROUP BY country_code ORDER BY connections DESC, country_code LIMIT 50"""))
def q_geo_summary(spark, sf):
    return agg.geo_summary(td.flows(spark, sf), window="30d")


@register("compliance_summary", W(f"""
, s AS (SELECT count(*) AS total_connections,
          count(*) FILTER (WHERE {duck_is_external_like('src_ip')}) AS external_connections
        FROM flows WHERE ts >= {NOW} - INTERVAL 7 DAYS)
SELECT total_connections, external_connections,
  ROUND(CASE WHEN total_connections > 0 THEN external_connections * 100.0 / total_connections ELSE 0.0 END, 6) AS external_pct,
  (SELECT count(*) FROM certs WHERE expired) AS tls_issues
FROM s""", certs=td.TLS_CERTS_SQL))
def q_compliance_summary(spark, sf):
    return finish(agg.compliance_summary(td.flows(spark, sf), td.tls_certs(spark, sf), window="7d"))
