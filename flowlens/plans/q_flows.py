"""Registered queries: filters, enrichment, labels, latest-version dimensions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import functions as F

from flowlens.functions import labels as L
from flowlens.functions.ip import (AUDIT_PRIVATE, SCORER_PRIVATE, duck_ipv4_long, duck_is_external,
                                   duck_is_private, is_external, is_external_like, is_private,
                                   is_valid_ip)
from flowlens.operators import aggregate as agg
from flowlens.operators import enrich as E
from flowlens.operators import filters as FL
from flowlens.operators import latest as LT
from flowlens.operators.rangejoin import lookup, network_table
from flowlens.plans.catalog import finish, register
from flowlens.sources import testdata as td

NOW = "(SELECT max(ts) FROM flows)"
BL_VALUES = ", ".join(f"('{n}', {lo}, {hi})" for n, lo, hi in td.BLOCKLIST_ROWS)


def W(body: str, **extra: str) -> str:
    return td.with_ctes(body, flows=td.FLOWS_SQL, **extra)


def blocklist(spark):
    return E.blocklist_from_lines(spark.createDataFrame([(n,) for n, _, _ in td.BLOCKLIST_ROWS], "value string"))


def threat_flows(spark, sf):
    return E.enrich_threat(td.flows(spark, sf), blocklist(spark))


def _hub_points() -> str:
    parts = " ".join(f"WHEN dst_port IN ({', '.join(map(str, ports))}) THEN {p}"
                     for ports, p, _ in E.HUB_PORT_RULES)
    return f"CASE {parts} ELSE 0 END"


def _hub_reason() -> str:
    parts = " ".join(f"WHEN dst_port IN ({', '.join(map(str, ports))}) THEN '{why}'"
                     for ports, _, why in E.HUB_PORT_RULES)
    return f"CASE {parts} END"


# DuckDB: flows re-scored by the hub threat rules (replaces threat_score/level)
TFLOWS = f""", bl AS (SELECT * FROM (VALUES {BL_VALUES}) t(net, lo, hi)),
s1 AS (SELECT *, (EXISTS (SELECT 1 FROM bl WHERE {duck_ipv4_long('dst_ip')} BETWEEN bl.lo AND bl.hi)
                  AND NOT {duck_is_private('dst_ip')}) AS hit,
              {_hub_points()} AS pts, {_hub_reason()} AS port_reason FROM flows),
tflows AS (SELECT * EXCLUDE (hit, pts, port_reason, threat_score, threat_level),
     CAST(LEAST(CASE WHEN hit THEN 75 ELSE 0 END + pts, 100) AS INT) AS threat_score,
     CASE WHEN LEAST(CASE WHEN hit THEN 75 ELSE 0 END + pts, 100) >= 75 THEN 'high'
          WHEN LEAST(CASE WHEN hit THEN 75 ELSE 0 END + pts, 100) >= 50 THEN 'medium'
          WHEN LEAST(CASE WHEN hit THEN 75 ELSE 0 END + pts, 100) >= 20 THEN 'low' ELSE 'clean' END AS threat_level,
     concat_ws(',', CASE WHEN hit THEN 'blocklist_hit' END, port_reason) AS threat_reasons
   FROM s1)
"""


@register("enrich_threat", W(TFLOWS + """
SELECT id, dst_ip, dst_port, threat_score, threat_level, threat_reasons FROM tflows"""))
def q_enrich_threat(spark, sf):
    return threat_flows(spark, sf).select(
        "id", "dst_ip", "dst_port", "threat_score", "threat_level",
        F.array_join("threat_reasons", ",").alias("threat_reasons"))


DESK_BL = [("185.220.0.0/15", 3118202880, 3118333951)]


@register("enrich_threat_bidirectional", W(f"""
, dbl AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {lo}, {hi})" for n, lo, hi in DESK_BL)}) t(net, lo, hi)),
d1 AS (SELECT id, dst_port,
  (SELECT min(net) FROM dbl WHERE {duck_ipv4_long('src_ip')} BETWEEN lo AND hi) AS s_net,
  (SELECT min(net) FROM dbl WHERE {duck_ipv4_long('dst_ip')} BETWEEN lo AND hi) AS d_net,
  CASE WHEN dst_port IN ({', '.join(map(str, E.DESKTOP_C2_PORTS))}) THEN 40
       WHEN dst_port IN ({', '.join(map(str, E.DESKTOP_TOR_PORTS))}) THEN 25
       WHEN dst_port = 23 THEN 20 ELSE 0 END AS pts,
  CASE WHEN dst_port IN ({', '.join(map(str, E.DESKTOP_C2_PORTS))}) THEN printf('Known C2/RAT port (%d)', dst_port)
       WHEN dst_port IN ({', '.join(map(str, E.DESKTOP_TOR_PORTS))}) THEN printf('Tor relay port (%d)', dst_port)
       WHEN dst_port = 23 THEN 'Cleartext Telnet (port 23)' END AS preason
  FROM flows),
d2 AS (SELECT *, (CASE WHEN s_net IS NOT NULL THEN 75 ELSE 0 END + CASE WHEN d_net IS NOT NULL THEN 75 ELSE 0 END + pts) AS raw FROM d1)
SELECT id, CAST(CASE WHEN raw > 0 THEN LEAST(raw, 100) END AS INT) AS desk_threat_score,
  CASE WHEN raw <= 0 THEN NULL WHEN LEAST(raw, 100) >= 70 THEN 'high' WHEN LEAST(raw, 100) >= 40 THEN 'medium'
       WHEN LEAST(raw, 100) >= 20 THEN 'low' ELSE 'clean' END AS desk_threat_level,
  CASE WHEN raw > 0 THEN concat_ws('|', CASE WHEN s_net IS NOT NULL THEN 'Source IP in threat blocklist (' || s_net || ')' END,
       CASE WHEN d_net IS NOT NULL THEN 'Destination IP in threat blocklist (' || d_net || ')' END, preason) END AS desk_threat_reasons
FROM d2"""))
def q_enrich_threat_bidirectional(spark, sf):
    bl = E.blocklist_from_lines(spark.createDataFrame([(n,) for n, _, _ in DESK_BL], "value string"))
    out = E.enrich_threat_bidirectional(td.flows(spark, sf), bl)
    return out.select("id", "desk_threat_score", "desk_threat_level",
                      F.array_join("desk_threat_reasons", "|").alias("desk_threat_reasons"))


# a stored list against many addresses: the first line of the list that holds an address wins
LONG_LIST = f"""
, bl AS (SELECT ord, value AS net, CAST(split_part(value, '/', 2) AS INT) AS bits,
           {duck_ipv4_long("split_part(value, '/', 1)")} AS lo,
           CASE WHEN value LIKE '2001:%' THEN split_part(value, ':', 3) END AS grp
         FROM lines WHERE value LIKE '%/%' AND value NOT LIKE '#%'),
ips AS (SELECT ip, {duck_ipv4_long('ip')} AS n, CASE WHEN ip LIKE '2001:%' THEN split_part(ip, ':', 3) END AS grp
        FROM (SELECT src_ip AS ip FROM flows UNION SELECT dst_ip AS ip FROM flows) u),
cuts AS (SELECT ip, bits, n - n % CAST(power(2, 32 - bits) AS BIGINT) AS lo
         FROM ips, (SELECT DISTINCT bits FROM bl WHERE lo IS NOT NULL) b WHERE n IS NOT NULL),
hits AS (SELECT ip, arg_min(net, ord) AS net FROM (
           SELECT c.ip, b.net, b.ord FROM cuts c JOIN bl b ON b.bits = c.bits AND b.lo = c.lo
           UNION ALL SELECT i.ip, b.net, b.ord FROM ips i JOIN bl b ON b.grp = i.grp) h GROUP BY ip)
"""


@register("stored_list_matches", td.with_ctes(LONG_LIST + """
SELECT f.id, f.src_ip, s.net AS src_net, f.dst_ip, d.net AS dst_net FROM flows f
LEFT JOIN hits s ON s.ip = f.src_ip LEFT JOIN hits d ON d.ip = f.dst_ip""",
                                              flows=td.MANY_ADDRESSES_SQL, lines=td.LONG_BLOCKLIST_SQL))
def q_stored_list_matches(spark, sf):
    lines = E.blocklist_from_lines(td.long_blocklist(spark, sf), order_col="ord")
    table = network_table(lines, priority=F.col("ord"), payload=["net"])
    out = lookup(td.many_addresses(spark, sf), ["src_ip", "dst_ip"], table)
    return out.select("id", "src_ip", F.col("src_ip_net").alias("src_net"), "dst_ip", F.col("dst_ip_net").alias("dst_net"))


@register("stored_list_scores", td.with_ctes(LONG_LIST + f"""
, s AS (SELECT f.id, (h.ip IS NOT NULL AND NOT {duck_is_private('f.dst_ip')}) AS hit, {_hub_points()} AS pts,
          {_hub_reason()} AS port_reason FROM flows f LEFT JOIN hits h ON h.ip = f.dst_ip),
t AS (SELECT id, hit, port_reason, CAST(LEAST(CASE WHEN hit THEN 75 ELSE 0 END + pts, 100) AS INT) AS threat_score FROM s)
SELECT id, threat_score, CASE WHEN threat_score >= 75 THEN 'high' WHEN threat_score >= 50 THEN 'medium'
  WHEN threat_score >= 20 THEN 'low' ELSE 'clean' END AS threat_level,
  concat_ws(',', CASE WHEN hit THEN 'blocklist_hit' END, port_reason) AS threat_reasons FROM t""",
                                             flows=td.MANY_ADDRESSES_SQL, lines=td.LONG_BLOCKLIST_SQL))
def q_stored_list_scores(spark, sf):
    lines = E.blocklist_from_lines(td.long_blocklist(spark, sf), order_col="ord")
    return E.enrich_threat(td.many_addresses(spark, sf), lines).select(
        "id", "threat_score", "threat_level", F.array_join("threat_reasons", ",").alias("threat_reasons"))


def _bounds(net: str) -> tuple[int, int]:
    n = ipaddress.ip_network(net)
    return int(n.network_address), int(n.broadcast_address)


GEO_VALUES = ", ".join(f"({_bounds(net)[0]}, {_bounds(net)[1]}, '{cc}', '{cn}', '{org}')"
                       for (net, cc, cn, org) in E.SAMPLE_GEO)


@register("enrich_geo", W(f"""
, geo AS (SELECT * FROM (VALUES {GEO_VALUES}) t(lo, hi, cc, cn, org)),
m AS (SELECT f.id, arg_min(g.cc, (g.hi - g.lo, g.cc, g.cn, g.org)) AS cc, arg_min(g.cn, (g.hi - g.lo, g.cc, g.cn, g.org)) AS cn,
             arg_min(g.org, (g.hi - g.lo, g.cc, g.cn, g.org)) AS org
      FROM flows f JOIN geo g ON {duck_ipv4_long('f.dst_ip')} BETWEEN g.lo AND g.hi
      WHERE NOT {duck_is_private('f.dst_ip')} GROUP BY f.id)
SELECT f.id, f.dst_ip,
  CASE WHEN COALESCE(m.cc, '') != '' THEN m.cc ELSE f.country_code END AS country_code,
  CASE WHEN COALESCE(m.cc, '') != '' THEN m.cn ELSE f.country_name END AS country_name,
  CASE WHEN COALESCE(m.cc, '') != '' THEN m.org ELSE f.as_org END AS as_org
FROM flows f LEFT JOIN m ON f.id = m.id"""))
def q_enrich_geo(spark, sf):
    out = E.enrich_geo(td.flows(spark, sf), E.geo_ranges(spark))
    return out.select("id", "dst_ip", "country_code", "country_name", "as_org")


@register("threat_summary", W(TFLOWS + f"""
SELECT dst_ip, max(threat_score) AS score, arg_max(threat_level, (threat_score, ts, id)) AS level,
  arg_max(country_code, (ts, id)) AS country_code, arg_max(country_name, (ts, id)) AS country_name,
  arg_max(as_org, (ts, id)) AS as_org, count(*) AS flow_count, max(ts) AS last_seen,
  array_to_string(list_slice(list_sort(list_distinct(list(NULLIF(process_name, '')))), 1, 10), ',') AS processes
FROM tflows WHERE threat_score > 0 AND ts >= (SELECT max(ts) FROM flows) - INTERVAL 7 DAYS
GROUP BY dst_ip ORDER BY score DESC, flow_count DESC, dst_ip LIMIT 50"""))
def q_threat_summary(spark, sf):
    top, _ = agg.threat_summary(threat_flows(spark, sf), window="7d")
    return finish(top)


@register("threat_level_counts", W(TFLOWS + """
, per AS (SELECT dst_ip, arg_max(threat_level, (threat_score, ts, id)) AS level FROM tflows
          WHERE threat_score > 0 AND ts >= (SELECT max(ts) FROM flows) - INTERVAL 7 DAYS GROUP BY dst_ip)
SELECT count(*) AS total, count(*) FILTER (WHERE level = 'high') AS high,
  count(*) FILTER (WHERE level = 'medium') AS medium, count(*) FILTER (WHERE level = 'low') AS low FROM per"""))
def q_threat_level_counts(spark, sf):
    _, counts = agg.threat_summary(threat_flows(spark, sf), window="7d")
    return counts


@register("threat_offenders", W(TFLOWS + """
SELECT src_ip, count(*) AS hits, count(DISTINCT dst_ip) AS distinct_dsts,
  array_to_string(list_slice(list_sort(list_distinct(list(dst_ip))), 1, 5), ',') AS sample_dsts,
  array_to_string(list_sort(list_distinct(list(protocol))), ',') AS protocols,
  CAST(sum(bytes_in + bytes_out) AS BIGINT) AS total_bytes,
  CASE WHEN count(*) >= 20 THEN 'P1' WHEN count(*) >= 10 THEN 'P2' ELSE 'P3' END AS priority
FROM tflows WHERE threat_level = 'high' GROUP BY src_ip HAVING count(*) >= 3"""))
def q_threat_offenders(spark, sf):
    return finish(agg.threat_offenders(threat_flows(spark, sf), min_hits=3))


@register("ip_classification", W(f"""
SELECT ip, {duck_is_private('ip')} AS is_private, {duck_is_external('ip')} AS is_external,
  {duck_ipv4_long('ip')} IS NOT NULL AS is_valid,
  NOT ({' OR '.join(f"ip LIKE '{p}%'" for p in ['10.', '172.16.', '172.17.', '172.18.', '172.19.', '172.2', '172.30.', '172.31.', '192.168.', '127.'])}) AS is_external_like
FROM (SELECT src_ip AS ip FROM flows UNION SELECT dst_ip AS ip FROM flows) x"""))
def q_ip_classification(spark, sf):
    f = td.flows(spark, sf)
    ips = f.select(F.col("src_ip").alias("ip")).union(f.select(F.col("dst_ip").alias("ip"))).distinct()
    return ips.select("ip", is_private("ip").alias("is_private"), is_external("ip").alias("is_external"),
                      is_valid_ip("ip").alias("is_valid"), is_external_like("ip").alias("is_external_like"))


@register("query_flows_page", W(f"""
SELECT id, agent_id, hostname, ts, protocol, src_ip, dst_ip, dst_port, http_status FROM flows
WHERE protocol = 'HTTP' AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'
ORDER BY ts DESC, id DESC LIMIT 5000 OFFSET 50"""))
def q_query_flows_page(spark, sf):
    page, _ = FL.query_flows(td.flows(spark, sf), protocol="HTTP", from_="2024-01-10T00:00:00Z",
                             to="2024-01-20T12:00", limit=5000, offset=50,
                             columns=["id", "agent_id", "hostname", "ts", "protocol", "src_ip", "dst_ip",
                                      "dst_port", "http_status"])
    return page


@register("query_flows_total", W("""
SELECT count(*) AS total FROM flows WHERE src_ip = '10.0.1.1' AND hostname = 'host-1'
  AND ts >= TIMESTAMP '2024-01-05 00:00:00'"""))
def q_query_flows_total(spark, sf):
    _, total = FL.query_flows(td.flows(spark, sf), src_ip="10.0.1.1", hostname="host-1",
                              from_="2024-01-05T00:00", to="not-a-time")
    return total


@register("search_flows_cidr", W(f"""
SELECT id, src_ip, src_port, dst_ip, dst_port, country_code FROM flows
WHERE {duck_ipv4_long('dst_ip')} BETWEEN {_bounds('8.8.0.0/16')[0]} AND {_bounds('8.8.0.0/16')[1]}
  AND (src_port = 443 OR dst_port = 443) AND country_code = 'US' AND ts >= {NOW} - INTERVAL 240 HOURS"""))
def q_search_flows_cidr(spark, sf):
    return FL.search_flows(td.flows(spark, sf), dst_ip="8.8.0.0/16", port=443, country="US",
                           hours=240, limit=None).select(
        "id", "src_ip", "src_port", "dst_ip", "dst_port", "country_code")


@register("connection_audit_external", W(f"""
SELECT id, agent_id, hostname, ts, protocol, src_ip, src_port, dst_ip, dst_port, bytes_in, bytes_out,
  duration_ms, info, process_name, pid, {duck_is_external('dst_ip')} AS is_external
FROM flows WHERE ts >= {NOW} - INTERVAL 7 DAYS AND protocol = 'TCP' AND {duck_is_external('dst_ip')}"""))
def q_connection_audit_external(spark, sf):
    return FL.connection_audit(td.flows(spark, sf), window="7d", protocol="TCP", external_only=True)


@register("quick_filter_text", W("""
SELECT id, protocol, src_ip, dst_ip, dst_port FROM flows
WHERE src_ip LIKE '%8.8%' OR dst_ip LIKE '%8.8%' OR lower(protocol) LIKE '%8.8%' OR lower(info) LIKE '%8.8%'
   OR CAST(src_port AS VARCHAR) LIKE '%8.8%' OR CAST(dst_port AS VARCHAR) LIKE '%8.8%'
   OR lower(country_name) LIKE '%8.8%' OR lower(as_org) LIKE '%8.8%'"""))
def q_quick_filter_text(spark, sf):
    return FL.quick_filter(td.flows(spark, sf), "8.8").select("id", "protocol", "src_ip", "dst_ip", "dst_port")


@register("quick_filter_named", W("""
SELECT 'http' AS filter, count(*) AS n FROM flows WHERE starts_with(lower(protocol), 'http')
UNION ALL SELECT 'dns', count(*) FROM flows WHERE lower(protocol) = 'dns'
UNION ALL SELECT 'tls', count(*) FROM flows WHERE lower(protocol) = 'tls'
UNION ALL SELECT 'errors', count(*) FROM flows WHERE http_status >= 400
UNION ALL SELECT 'threats', count(*) FROM flows WHERE threat_score > 0
UNION ALL SELECT 'hub', count(*) FROM flows WHERE source = 'hub'"""))
def q_quick_filter_named(spark, sf):
    f = td.flows(spark, sf)
    out = None
    for name in FL.QUICK_FILTERS:
        part = FL.quick_filter(f, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("filter"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@register("apply_saved_query", W("""
, sq AS (SELECT arg_max(filters, version) AS filters, arg_max(deleted, version) AS deleted
         FROM saved WHERE id = 'sq-2')
SELECT f.id, f.ts, f.protocol, f.src_ip, f.dst_ip FROM flows f, sq
WHERE NOT sq.deleted
  AND (json_extract_string(sq.filters, '$.protocol') IS NULL OR f.protocol = json_extract_string(sq.filters, '$.protocol'))
  AND (json_extract_string(sq.filters, '$.src_ip') IS NULL OR f.src_ip = json_extract_string(sq.filters, '$.src_ip'))
  AND (json_extract_string(sq.filters, '$.dst_ip') IS NULL OR f.dst_ip = json_extract_string(sq.filters, '$.dst_ip'))
  AND (json_extract_string(sq.filters, '$.from') IS NULL
       OR f.ts >= strptime(json_extract_string(sq.filters, '$.from'), '%Y-%m-%dT%H:%M'))
ORDER BY f.ts DESC, f.id DESC LIMIT 100""", saved=td.SAVED_QUERIES_SQL))
def q_apply_saved_query(spark, sf):
    page, _ = FL.apply_saved_query(td.flows(spark, sf), td.saved_queries(spark, sf), "sq-2")
    return page.select("id", "ts", "protocol", "src_ip", "dst_ip")


@register("keyset_page", W("""
SELECT id, ts FROM flows
WHERE ts < TIMESTAMP '2024-01-15 12:00:00' OR (ts = TIMESTAMP '2024-01-15 12:00:00' AND id < '00000000-0000-0000-0000-000000005000')
ORDER BY ts DESC, id DESC LIMIT 500"""))
def q_keyset_page(spark, sf):
    return FL.page_after(td.flows(spark, sf), "2024-01-15 12:00:00",
                         "00000000-0000-0000-0000-000000005000", 500).select("id", "ts")


@register("derived_columns", W(TFLOWS + """
SELECT id, bytes_in + bytes_out AS total_bytes, threat_level IN ('high', 'medium') AS is_threat FROM tflows"""))
def q_derived_columns(spark, sf):
    return E.derived_columns(threat_flows(spark, sf)).select("id", "total_bytes", "is_threat")


def _duck_case(key: str, mapping: dict, default: str) -> str:
    whens = " ".join(f"WHEN {key} = {k} THEN '{v}'" for k, v in mapping.items())
    return f"CASE {whens} ELSE {default} END"


@register("code_labels", td.with_ctes(f"""
SELECT event_id, CASE WHEN t = 3 THEN {_duck_case('c', L.ICMP_UNREACHABLE, "printf('Destination Unreachable (code %d)', c)")}
  WHEN t = 11 THEN {_duck_case('c', L.ICMP_TIME_EXCEEDED, "printf('Time Exceeded (code %d)', c)")}
  ELSE {_duck_case('t', L.ICMP_TYPES, "printf('ICMP type %d code %d', t, c)")} END AS icmp_label,
  {_duck_case('q', L.DNS_QTYPES, "'UNKNOWN'")} AS qtype_label,
  {_duck_case('r', L.DNS_RCODES, "'UNKNOWN'")} AS rcode_label,
  {_duck_case('p', L.IP_PROTOCOLS, "printf('PROTO_%d', p)")} AS proto_label
FROM codes""", codes="""SELECT event_id, CAST(event_id % 140 AS INT) AS t, CAST(user_id % 5 AS INT) AS c,
  CAST(event_id % 260 AS INT) AS q, CAST(user_id % 8 AS INT) AS r, CAST(event_id % 64 AS INT) AS p FROM {events}"""))
def q_code_labels(spark, sf):
    ev = td.read_table(spark, sf, "events").select(
        "event_id", (F.col("event_id") % 140).cast("int").alias("t"), (F.col("user_id") % 5).cast("int").alias("c"),
        (F.col("event_id") % 260).cast("int").alias("q"), (F.col("user_id") % 8).cast("int").alias("r"),
        (F.col("event_id") % 64).cast("int").alias("p"))
    return ev.select("event_id", L.icmp_type_name("t", "c").alias("icmp_label"),
                     L.dns_qtype_name("q").alias("qtype_label"), L.dns_rcode_name("r").alias("rcode_label"),
                     L.ip_proto_name("p").alias("proto_label"))


@register("classify_protocol", W(f"""
SELECT id, CASE WHEN src_port IN ({', '.join(map(str, L.TLS_PORTS))}) OR dst_port IN ({', '.join(map(str, L.TLS_PORTS))}) THEN 'TLS'
  WHEN src_port IN ({', '.join(map(str, L.HTTP_PORTS))}) OR dst_port IN ({', '.join(map(str, L.HTTP_PORTS))}) THEN 'HTTP'
  ELSE protocol END AS app_protocol FROM flows"""))
def q_classify_protocol(spark, sf):
    return td.flows(spark, sf).select("id", L.classify_protocol("protocol", "src_port", "dst_port").alias("app_protocol"))


# ---- latest-version dimensions ---------------------------------------------

AG_LATEST = """
, la AS (SELECT agent_id,
    COALESCE(arg_max(hostname, (last_seen, version_seq)) FILTER (WHERE hostname != ''), '') AS hostname,
    COALESCE(arg_max(version, (last_seen, version_seq)) FILTER (WHERE version != ''), '') AS version,
    COALESCE(arg_max(os, (last_seen, version_seq)) FILTER (WHERE os != ''), '') AS os,
    COALESCE(arg_max(cluster, (last_seen, version_seq)) FILTER (WHERE cluster != ''), '') AS cluster,
    arg_max(capture_mode, (last_seen, version_seq)) AS capture_mode,
    arg_max(ebpf_enabled, (last_seen, version_seq)) AS ebpf_enabled,
    max(last_seen) AS last_seen, min(registered_at) AS registered_at
  FROM agents GROUP BY agent_id)
"""


@register("latest_agents", W(AG_LATEST + "SELECT * FROM la", agents=td.AGENTS_SQL))
def q_latest_agents(spark, sf):
    return LT.latest_agents(td.agents(spark, sf))


@register("agent_inventory", W(AG_LATEST + f"""
, fc AS (SELECT agent_id, count(*) AS n FROM flows WHERE ts >= {NOW} - INTERVAL 24 HOURS GROUP BY agent_id)
SELECT la.*, COALESCE(fc.n, 0) AS flow_count_window FROM la LEFT JOIN fc ON la.agent_id = fc.agent_id""",
    agents=td.AGENTS_SQL))
def q_agent_inventory(spark, sf):
    return LT.agent_inventory(td.agents(spark, sf), td.flows(spark, sf), hours=24)


@register("fleet_totals", W(AG_LATEST + f"""
SELECT count(*) AS agents, count(*) FILTER (WHERE last_seen > {NOW} - INTERVAL 3 DAYS) AS online,
  count(*) FILTER (WHERE ebpf_enabled) AS ebpf FROM la""", agents=td.AGENTS_SQL))
def q_fleet_totals(spark, sf):
    f = td.flows(spark, sf)
    from flowlens.functions.timewin import as_of_col
    inv = LT.agent_inventory(td.agents(spark, sf), f, hours=24)
    return LT.fleet_totals(inv, as_of_col(f), online_minutes=3 * 24 * 60)


@register("cluster_summary", W(AG_LATEST + f"""
, fc AS (SELECT agent_id, count(*) AS n FROM flows WHERE ts >= {NOW} - INTERVAL 48 HOURS GROUP BY agent_id)
SELECT CASE WHEN cluster = '' THEN 'default' ELSE cluster END AS cluster, count(*) AS agent_count,
  count(*) FILTER (WHERE last_seen > {NOW} - INTERVAL 2 DAYS) AS online_count,
  array_to_string(list_sort(list_distinct(list(NULLIF(version, '')))), ',') AS versions,
  CAST(COALESCE(sum(fc.n), 0) AS BIGINT) AS flows_window
FROM la LEFT JOIN fc ON la.agent_id = fc.agent_id GROUP BY cluster""", agents=td.AGENTS_SQL))
def q_cluster_summary(spark, sf):
    return finish(LT.cluster_summary(td.agents(spark, sf), td.flows(spark, sf), hours=48,
                                     online_minutes=2 * 24 * 60))


@register("fleet_search", W("""
, a AS (SELECT agent_id, arg_max(cluster, (last_seen, version_seq)) AS cluster FROM agents GROUP BY agent_id)
SELECT f.id, f.agent_id, f.hostname, f.ts, f.protocol, f.src_ip, f.src_port, f.dst_ip, f.dst_port,
  f.bytes_in, f.bytes_out, f.duration_ms, f.process_name, COALESCE(a.cluster, '') AS cluster
FROM flows f LEFT JOIN a ON a.agent_id = f.agent_id
WHERE f.agent_id IN (SELECT agent_id FROM a WHERE cluster = 'prod-eu') AND f.protocol = 'DNS'
ORDER BY f.ts DESC, f.id DESC LIMIT 1000""", agents=td.AGENTS_SQL))
def q_fleet_search(spark, sf):
    return LT.fleet_search(td.flows(spark, sf), td.agents(spark, sf), cluster="prod-eu", protocol="dns",
                           limit=1000)


@register("enrich_graph_nodes", W(f"""
, e AS (SELECT src_ip, dst_ip, protocol, count(*) AS flow_count FROM flows
        WHERE ts >= {NOW} - INTERVAL 30 DAYS GROUP BY 1, 2, 3),
n AS (SELECT ip, CAST(sum(flow_count) AS BIGINT) AS flow_count FROM (
  SELECT src_ip AS ip, flow_count FROM e UNION ALL SELECT dst_ip AS ip, flow_count FROM e) x WHERE ip != '' GROUP BY ip),
a AS (SELECT agent_id, arg_max(hostname, last_seen) AS hostname, max(last_seen) AS last_seen FROM agents GROUP BY agent_id),
k AS (SELECT ip, arg_min(hostname, last_seen) AS agent_hostname FROM (
   SELECT agent_id AS ip, hostname, last_seen FROM a UNION ALL SELECT hostname AS ip, hostname, last_seen FROM a) y
   WHERE ip != '' GROUP BY ip)
SELECT n.ip, n.flow_count, k.agent_hostname IS NOT NULL AS is_known, COALESCE(k.agent_hostname, '') AS hostname
FROM n LEFT JOIN k ON n.ip = k.ip""", agents=td.AGENTS_SQL))
def q_enrich_graph_nodes(spark, sf):
    nodes = agg.service_nodes(agg.service_edges(td.flows(spark, sf), window="30d", k=None))
    return LT.enrich_graph_nodes(nodes, td.agents(spark, sf))


@register("team_rollup", td.with_ctes("""
SELECT t.team_id, t.name, t.created_at, count(tm.user_id) AS member_count
FROM teams t LEFT JOIN tm ON t.team_id = tm.team_id GROUP BY t.team_id, t.name, t.created_at""",
    teams=td.TEAMS_SQL, tm=td.TEAM_MEMBERS_SQL))
def q_team_rollup(spark, sf):
    return LT.team_rollup(td.teams(spark, sf), td.team_members(spark, sf))


@register("team_members", td.with_ctes("""
, m AS (SELECT user_id, arg_max(email, version) AS email, arg_max(display_name, version) AS display_name,
        arg_max(role, version) AS role, arg_max(is_active, version) AS is_active FROM members GROUP BY user_id)
SELECT tm.team_id, tm.user_id, tm.added_at, m.email, m.display_name, m.role
FROM tm JOIN m ON tm.user_id = m.user_id WHERE m.is_active""", members=td.MEMBERS_SQL, tm=td.TEAM_MEMBERS_SQL))
def q_team_members(spark, sf):
    return LT.team_members_view(td.team_members(spark, sf), td.members(spark, sf))


@register("agent_flow_counts", W(f"""
SELECT agent_id, count(*) AS flow_count FROM flows WHERE ts >= {NOW} - INTERVAL 24 HOURS GROUP BY agent_id"""))
def q_agent_flow_counts(spark, sf):
    return LT.agent_flow_counts(td.flows(spark, sf), hours=24)
