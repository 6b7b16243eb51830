"""Registered detection queries: baselines, anomalies, alerts, rules, policies, incidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.ip import duck_ipv4_long
from flowlens.functions.timewin import as_of_col
from flowlens.operators import detect as D
from flowlens.operators import rulesets as RS
from flowlens.plans.catalog import CATALOG, finish, register
from flowlens.sources import testdata as td

NOW = "(SELECT max(ts) FROM flows)"
LOOKBACK_DAYS = 28  # 7 days yields < 3 samples per hour-of-week (see README)


def W(body: str, **extra: str) -> str:
    return td.with_ctes(body, flows=td.FLOWS_SQL, **extra)


BASELINE_CTE = f"""
, hc AS (SELECT agent_id, protocol, date_trunc('hour', ts) AS hb, count(*) AS c,
           sum(bytes_in) AS bi, sum(bytes_out) AS bo
         FROM flows WHERE ts >= {NOW} - INTERVAL {LOOKBACK_DAYS} DAYS AND agent_id != '' GROUP BY 1, 2, 3),
bl AS (SELECT agent_id, protocol, CAST((isodow(hb) - 1) * 24 + hour(hb) AS INTEGER) AS hour_of_week,
         avg(c) AS flow_count_mean, stddev_pop(c) AS flow_count_std, avg(bi) AS bytes_in_mean,
         avg(bo) AS bytes_out_mean, count(*) AS sample_count FROM hc GROUP BY 1, 2, 3)
"""


def baselines(spark, sf):
    return D.compute_baselines(td.flows(spark, sf), lookback_days=LOOKBACK_DAYS)


@register("compute_baselines", W(BASELINE_CTE + """
SELECT agent_id, protocol, hour_of_week, ROUND(flow_count_mean, 6) AS flow_count_mean,
  ROUND(flow_count_std, 6) AS flow_count_std, ROUND(bytes_in_mean, 6) AS bytes_in_mean,
  ROUND(bytes_out_mean, 6) AS bytes_out_mean, sample_count FROM bl"""))
def q_compute_baselines(spark, sf):
    return finish(baselines(spark, sf))


def _duck_score(per_hour: str) -> str:
    """DuckDB columns of the Z-score test over a frame with flow_count and baseline columns."""
    obs = f"(flow_count * {per_hour})"
    z = f"(({obs} - flow_count_mean) / greatest(flow_count_std, flow_count_mean * 0.1, 5.0))"
    kind = f"(CASE WHEN {z} < 0 THEN 'drop' ELSE 'spike' END)"
    return f"""CAST({obs} AS DOUBLE) AS observed, {z} AS z_score, {kind} AS anomaly_type,
  CASE WHEN abs({z}) >= 6 THEN 'high' WHEN abs({z}) >= 4 THEN 'medium' ELSE 'low' END AS severity,
  printf('%s: %s traffic on agent %s is %.1fx %s than usual (observed: %.0f flows/hr, expected: ~%.0f, σ=%.1f)',
    upper(left({kind}, 1)) || substr({kind}, 2), protocol, hostname,
    round_even(abs({obs} / greatest(flow_count_mean, 1.0)), 1), CASE WHEN {z} < 0 THEN 'lower' ELSE 'higher' END,
    round_even({obs}, 0), round_even(flow_count_mean, 0), round_even({z}, 1) + 0.0) AS description,
  flow_count_mean AS expected"""


@register("anomalies_history", W(BASELINE_CTE + f"""
, obs AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, agent_id, hostname, protocol,
            count(*) AS flow_count FROM flows WHERE agent_id != '' GROUP BY 1, 2, 3, 4),
j AS (SELECT o.*, b.flow_count_mean, b.flow_count_std FROM obs o JOIN bl b
      ON o.agent_id = b.agent_id AND o.protocol = b.protocol
      AND CAST((isodow(o.window_start) - 1) * 24 + hour(o.window_start) AS INTEGER) = b.hour_of_week
      WHERE b.sample_count >= 3),
s AS (SELECT window_start, agent_id, hostname, protocol, {_duck_score('12.0')} FROM j)
SELECT window_start, agent_id, hostname, protocol, anomaly_type, ROUND(z_score, 6) AS z_score,
  ROUND(observed, 6) AS observed, ROUND(expected, 6) AS expected, description, severity
FROM s WHERE abs(z_score) >= 3"""))
def q_anomalies_history(spark, sf):
    return finish(D.detect_anomalies_history(td.flows(spark, sf), baselines(spark, sf)))


@register("anomalies_latest", W(BASELINE_CTE + f"""
, obs AS (SELECT agent_id, hostname, protocol, count(*) AS flow_count FROM flows
          WHERE ts >= {NOW} - INTERVAL 180 MINUTES AND agent_id != '' GROUP BY 1, 2, 3),
j AS (SELECT o.*, b.flow_count_mean, b.flow_count_std FROM obs o JOIN bl b
      ON o.agent_id = b.agent_id AND o.protocol = b.protocol
      WHERE b.hour_of_week = CAST((isodow({NOW}) - 1) * 24 + hour({NOW}) AS INTEGER) AND b.sample_count >= 3),
s AS (SELECT agent_id, hostname, protocol, {_duck_score('(60.0 / 180)')} FROM j)
SELECT agent_id, hostname, protocol, anomaly_type, ROUND(z_score, 6) AS z_score, ROUND(observed, 6) AS observed,
  ROUND(expected, 6) AS expected, description, severity, {NOW} AS detected_at
FROM s WHERE abs(z_score) >= 0.05"""))
def q_anomalies_latest(spark, sf):
    f = td.flows(spark, sf)
    return finish(D.detect_anomalies(f, baselines(spark, sf), window_minutes=180, z_threshold=0.05))


# stand-in for busier agents: every flow twenty times within its next 20 minutes
DENSE_SQL = """
SELECT f.id, f.agent_id, f.hostname, f.protocol, f.bytes_in, f.bytes_out, f.ts + v.i * INTERVAL '1' MINUTE AS ts
FROM {flows} f CROSS JOIN (SELECT * FROM (VALUES """ + ", ".join(f"({i})" for i in range(20)) + """) t(i)) v
"""


def dense_flows(spark, sf):
    return spark.sql(DENSE_SQL.format(flows="{flows}"), flows=td.flows(spark, sf))


def D_CTE(body: str) -> str:
    """The oracle's text over the busier flows."""
    return td.with_ctes(body, sparse=td.FLOWS_SQL, flows=DENSE_SQL.format(flows="sparse"))


# the latest host name and first flow of each agent
HOSTS_CTE = """
, hosts AS (SELECT agent_id, COALESCE(arg_max(hostname, (ts, hostname)) FILTER (WHERE hostname != ''), '') AS hostname,
              min(ts) AS first_seen FROM flows WHERE agent_id != '' GROUP BY 1)
"""


@register("anomalies_silent_latest", D_CTE(BASELINE_CTE + HOSTS_CTE + f"""
, obs AS (SELECT agent_id, hostname, protocol, count(*) AS flow_count FROM flows
          WHERE ts >= {NOW} - INTERVAL 60 MINUTES AND agent_id != '' GROUP BY 1, 2, 3),
b AS (SELECT * FROM bl WHERE sample_count >= 3
      AND hour_of_week = CAST((isodow({NOW}) - 1) * 24 + hour({NOW}) AS INTEGER)),
j AS (SELECT b.agent_id, COALESCE(o.hostname, h.hostname) AS hostname, b.protocol,
        COALESCE(o.flow_count, 0) AS flow_count, b.flow_count_mean, b.flow_count_std
      FROM b LEFT JOIN obs o ON o.agent_id = b.agent_id AND o.protocol = b.protocol
      LEFT JOIN hosts h ON h.agent_id = b.agent_id),
s AS (SELECT agent_id, hostname, protocol, {_duck_score('1.0')} FROM j)
SELECT agent_id, hostname, protocol, anomaly_type, ROUND(z_score, 6) AS z_score, ROUND(observed, 6) AS observed,
  ROUND(expected, 6) AS expected, description, severity, {NOW} AS detected_at
FROM s WHERE abs(z_score) >= 3"""))
def q_anomalies_silent_latest(spark, sf):
    f = dense_flows(spark, sf)
    base = D.compute_baselines(f, lookback_days=LOOKBACK_DAYS)
    return finish(D.detect_anomalies(f, base, window_minutes=60, include_silent=True))


@register("anomalies_silent_history", D_CTE(BASELINE_CTE + HOSTS_CTE + f"""
, obs AS (SELECT time_bucket(INTERVAL '60 minutes', ts) AS window_start, agent_id, hostname, protocol,
            count(*) AS flow_count FROM flows WHERE agent_id != '' GROUP BY 1, 2, 3, 4),
grid AS (SELECT unnest(generate_series(date_trunc('hour', (SELECT min(first_seen) FROM hosts)),
                                       {NOW}, INTERVAL 1 HOUR)) AS window_start),
quiet AS (SELECT g.window_start, h.agent_id, h.hostname, b.protocol, 0 AS flow_count
          FROM grid g JOIN bl b ON b.hour_of_week = CAST((isodow(g.window_start) - 1) * 24 + hour(g.window_start) AS INTEGER)
          JOIN hosts h ON h.agent_id = b.agent_id AND g.window_start > h.first_seen
          WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.window_start = g.window_start
                            AND o.agent_id = b.agent_id AND o.protocol = b.protocol)),
j AS (SELECT o.*, b.flow_count_mean, b.flow_count_std FROM (SELECT * FROM obs UNION ALL SELECT * FROM quiet) o JOIN bl b
      ON o.agent_id = b.agent_id AND o.protocol = b.protocol
      AND CAST((isodow(o.window_start) - 1) * 24 + hour(o.window_start) AS INTEGER) = b.hour_of_week
      WHERE b.sample_count >= 3),
s AS (SELECT window_start, agent_id, hostname, protocol, {_duck_score('1.0')} FROM j)
SELECT window_start, agent_id, hostname, protocol, anomaly_type, ROUND(z_score, 6) AS z_score,
  ROUND(observed, 6) AS observed, ROUND(expected, 6) AS expected, description, severity
FROM s WHERE abs(z_score) >= 3"""))
def q_anomalies_silent_history(spark, sf):
    f = dense_flows(spark, sf)
    base = D.compute_baselines(f, lookback_days=LOOKBACK_DAYS)
    return finish(D.detect_anomalies_history(f, base, window_minutes=60, include_silent=True))


WINDOWS = [5, 60, 1440]


def _duck_metrics() -> str:
    parts = []
    for w in WINDOWS:
        inw = f"ts > {NOW} - INTERVAL {w} MINUTES"
        parts.append(f"""SELECT {w} AS window_minutes, 'flows_per_minute' AS metric,
  (SELECT count(*) FROM flows WHERE {inw}) / {float(w)} AS value""")
        parts.append(f"""SELECT {w}, 'http_error_rate', (SELECT count(*) FILTER (WHERE http_status >= 400) * 100.0
  / greatest(count(*), 1) FROM flows WHERE {inw} AND protocol = 'HTTP')""")
        parts.append(f"""SELECT {w}, 'dns_nxdomain_rate', (SELECT count(*) FILTER (WHERE dns_rcode = 3) * 100.0
  / greatest(count(*), 1) FROM flows WHERE {inw} AND protocol = 'DNS')""")
        parts.append(f"SELECT {w}, 'anomaly_flow_rate', (SELECT v FROM afr)")
        parts.append(f"SELECT {w}, 'anomaly_http_latency', (SELECT v FROM ahl)")
    return "\nUNION ALL ".join(parts)


METRICS_CTE = f"""
, hb AS (SELECT date_trunc('hour', ts) AS h, count(*) AS cnt,
           avg(CASE WHEN protocol IN ('HTTP', 'HTTPS') AND http_method != '' THEN duration_ms END) AS avg_lat
         FROM flows WHERE ts >= {NOW} - INTERVAL 7 DAYS AND ts < {NOW} - INTERVAL 1 HOUR GROUP BY 1),
bs AS (SELECT avg(cnt) AS b_avg, stddev_pop(cnt) AS b_std, avg(avg_lat) AS l_avg, stddev_pop(avg_lat) AS l_std FROM hb),
cur AS (SELECT count(*) FILTER (WHERE ts >= {NOW} - INTERVAL 5 MINUTES) AS n5,
           avg(CASE WHEN ts >= {NOW} - INTERVAL 5 MINUTES AND protocol IN ('HTTP', 'HTTPS') AND http_method != ''
                    THEN duration_ms END) AS lat5 FROM flows),
afr AS (SELECT CASE WHEN COALESCE(b_std, 0) < 1 THEN 0.0 ELSE (n5 * 12.0 - b_avg) / b_std END AS v FROM bs, cur),
ahl AS (SELECT CASE WHEN COALESCE(l_std, 0) < 1 THEN 0.0 ELSE (lat5 - l_avg) / l_std END AS v FROM bs, cur),
metrics AS ({_duck_metrics()})
"""


@register("alert_metrics", W(METRICS_CTE + """
SELECT window_minutes, metric, ROUND(value, 6) AS value FROM metrics"""))
def q_alert_metrics(spark, sf):
    return finish(D.alert_metrics(td.flows(spark, sf), WINDOWS))


# fixed config: alert rules (id, name, metric, condition, threshold, window, cooldown, enabled)
ALERT_RULES = [
    ("r1", "flow rate high", "flows_per_minute", "gt", 0.1, 1440, 15, True),
    ("r2", "flow rate low", "flows_per_minute", "lt", 100.0, 60, 15, True),
    ("r3", "http errors", "http_error_rate", "gt", 10.0, 1440, 15, True),
    ("r4", "http errors low", "http_error_rate", "lt", 10.0, 1440, 15, True),
    ("r5", "nxdomain", "dns_nxdomain_rate", "gt", 5.0, 1440, 15, True),
    ("r6", "nxdomain disabled", "dns_nxdomain_rate", "lt", 500.0, 60, 15, False),
    ("r7", "flow sigma", "anomaly_flow_rate", "gt", -100.0, 5, 15, True),
    ("r8", "flow sigma low", "anomaly_flow_rate", "lt", 100.0, 0, 0, True),
    ("r9", "latency sigma", "anomaly_http_latency", "gt", -100.0, 5, 30, True),
    ("r10", "latency sigma low", "anomaly_http_latency", "lt", 0.0, 5, 15, True),
]
RULES_SCHEMA = ("id string, name string, metric string, condition string, threshold double, "
                "window_minutes int, cooldown_minutes int, enabled boolean")
# alert history derived from the flows: r1 fired 3 minutes before the last flow
# (inside its cooldown), r3 20 minutes before (outside)
EVENTS_SQL = """
SELECT 'r1' AS rule_id, max(ts) - INTERVAL 3 MINUTES AS fired_at FROM {flows}
UNION ALL SELECT 'r3' AS rule_id, max(ts) - INTERVAL 20 MINUTES AS fired_at FROM {flows}
"""


def _duck_rules() -> str:
    rows = ", ".join(f"('{a}', '{b}', '{c}', '{d}', {e}, {f}, {g}, {str(h).upper()})"
                     for a, b, c, d, e, f, g, h in ALERT_RULES)
    return f"SELECT * FROM (VALUES {rows}) t(id, name, metric, condition, threshold, window_minutes, cooldown_minutes, enabled)"


@register("evaluate_alerts", W(METRICS_CTE + f"""
, r AS (SELECT id, name, metric, condition, threshold,
          COALESCE(NULLIF(window_minutes, 0), 5) AS window_minutes,
          COALESCE(NULLIF(cooldown_minutes, 0), 15) AS cooldown_minutes FROM ({_duck_rules()}) x WHERE enabled),
ev AS ({EVENTS_SQL.format(flows='flows')}),
j AS (SELECT r.*, m.value FROM r JOIN metrics m ON r.metric = m.metric AND r.window_minutes = m.window_minutes
      WHERE (condition = 'gt' AND value > threshold) OR (condition = 'lt' AND value < threshold))
SELECT id AS rule_id, name AS rule_name, metric, ROUND(value, 6) AS value, ROUND(threshold, 6) AS threshold,
  {NOW} AS fired_at,
  printf('[flowlens] %s: %s is %.2f (%s threshold %.2f over last %d min)', name, metric, round_even(value, 2),
    CASE condition WHEN 'gt' THEN 'exceeded' WHEN 'lt' THEN 'fell below' ELSE condition END,
    round_even(threshold, 2), window_minutes) AS message
FROM j WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.rule_id = j.id
                         AND ev.fired_at > {NOW} - j.cooldown_minutes * INTERVAL 1 MINUTE)"""))
def q_evaluate_alerts(spark, sf):
    f = td.flows(spark, sf)
    rules = spark.createDataFrame(ALERT_RULES, RULES_SCHEMA)
    events = spark.sql(EVENTS_SQL, flows=f)
    wins = WINDOWS  # distinct rule windows after defaults
    return finish(D.evaluate_alerts(rules, D.alert_metrics(f, wins), events, as_of_col(f)))


@register("rule_port_scan", W(f"""
SELECT src_ip, count(DISTINCT dst_port) AS port_count, min(ts) AS first_seen FROM flows
WHERE ts > {NOW} - INTERVAL 43200 MINUTES AND protocol IN ('TCP', 'UDP')
GROUP BY src_ip HAVING count(DISTINCT dst_port) > 9"""))
def q_rule_port_scan(spark, sf):
    return D.rule_port_scan(td.flows(spark, sf), window_minutes=43200, min_ports=9)


@register("rule_dns_tunnel", W(f"""
SELECT src_ip, hostname, dns_query, ts FROM flows
WHERE ts > {NOW} - INTERVAL 43200 MINUTES AND protocol = 'DNS' AND length(dns_query) > 60"""))
def q_rule_dns_tunnel(spark, sf):
    return D.rule_dns_tunnel(td.flows(spark, sf), window_minutes=43200)


@register("rule_cleartext_creds", W(f"""
SELECT src_ip, dst_ip, dst_port, http_path, hostname, ts FROM flows
WHERE ts > {NOW} - INTERVAL 43200 MINUTES AND protocol = 'HTTP' AND http_method = 'POST'
  AND (http_path LIKE '%/login%' OR http_path LIKE '%/auth%' OR http_path LIKE '%/signin%' OR http_path LIKE '%/password%')
  AND dst_port != 443"""))
def q_rule_cleartext_creds(spark, sf):
    return D.rule_cleartext_creds(td.flows(spark, sf), window_minutes=43200)


@register("rule_high_port", W(f"""
SELECT src_ip, dst_ip, dst_port, protocol, bytes_out, hostname, ts FROM flows
WHERE ts > {NOW} - INTERVAL 43200 MINUTES AND dst_port > 49151 AND protocol = 'TCP' AND bytes_out > 10000"""))
def q_rule_high_port(spark, sf):
    return D.rule_high_port(td.flows(spark, sf), window_minutes=43200)


@register("rule_shell_process", W(f"""
SELECT process_name, pid, src_ip, dst_ip, dst_port, hostname, ts FROM flows
WHERE ts > {NOW} - INTERVAL 43200 MINUTES AND protocol = 'TCP'
  AND process_name IN ('bash', 'sh', 'zsh', 'python', 'python3', 'powershell', 'pwsh', 'cmd', 'perl', 'ruby')
  AND dst_port NOT IN (22, 80, 443)"""))
def q_rule_shell_process(spark, sf):
    return D.rule_shell_process(td.flows(spark, sf), window_minutes=43200)


# fixed config: custom SQL rules (id, title, severity, tags, query, enabled, version)
CUSTOM_RULES = [
    ("c-1", "Long DNS names", "medium", '["dns","exfiltration"]',
     "SELECT src_ip, dst_ip, dns_query FROM flows WHERE ts > :as_of - INTERVAL 30 DAYS "
     "AND protocol = 'DNS' AND length(dns_query) > 60", True, 1),
    ("c-2", "Telnet use", "high", '["lateral","telnet"]',
     "SELECT src_ip, dst_ip, dst_port FROM flows WHERE ts > :as_of - INTERVAL 30 DAYS AND dst_port = 23", True, 2),
    ("c-2", "Telnet use (old)", "low", '["telnet"]', "SELECT src_ip FROM flows", True, 1),
    ("c-3", "Rejected non-select", "low", '[]', "DELETE FROM flows", True, 1),
    ("c-5", "Rejected insert", "low", '[]', "WITH t AS (SELECT 1 a) INSERT INTO flows SELECT * FROM t", True, 1),
    ("c-4", "Disabled", "low", '["portscan"]', "SELECT src_ip, dst_ip FROM flows", False, 1),
]
CUSTOM_SCHEMA = "id string, title string, severity string, tags string, query string, enabled boolean, version int"

MATCHES_DUCK = f"""
, matches AS (
  SELECT 'c-1' AS rule_id, 'Long DNS names' AS rule_title, 'medium' AS severity, src_ip, dst_ip FROM flows
  WHERE ts > {NOW} - INTERVAL 30 DAYS AND protocol = 'DNS' AND length(dns_query) > 60
  UNION ALL
  SELECT 'c-2', 'Telnet use', 'high', src_ip, dst_ip FROM flows WHERE ts > {NOW} - INTERVAL 30 DAYS AND dst_port = 23)
"""


def custom_matches(spark, sf):
    f = td.flows(spark, sf)
    as_of = f.agg(F.max("ts")).first()[0]  # one scalar for the rule parameter
    rules = spark.createDataFrame(CUSTOM_RULES, CUSTOM_SCHEMA)
    return D.run_rules(spark, rules, f, as_of)


@register("run_rules", W(MATCHES_DUCK + "SELECT rule_id, rule_title, severity, src_ip, dst_ip FROM matches"))
def q_run_rules(spark, sf):
    m = custom_matches(spark, sf)
    return m.select("rule_id", "rule_title", "severity",
                    F.get_json_object("match_data", "$.src_ip").alias("src_ip"),
                    F.get_json_object("match_data", "$.dst_ip").alias("dst_ip"))


@register("incidents_from_matches", W(MATCHES_DUCK + f"""
SELECT '[' || upper(severity) || '] ' || rule_title || ' — ' || src_ip || ' → ' || dst_ip AS title,
  severity, 'open' AS status, 'sigma' AS source, rule_id AS source_id, {NOW} AS created_at FROM matches"""))
def q_incidents_from_matches(spark, sf):
    return D.incidents_from_matches(custom_matches(spark, sf))


@register("rule_match_counts", W(MATCHES_DUCK + """
SELECT rule_id, severity, count(*) AS matches FROM matches GROUP BY 1, 2"""))
def q_rule_match_counts(spark, sf):
    return custom_matches(spark, sf).groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("matches"))


# fixed config: 50 row rules, one for each destination port or name length, and group rules
RULE_PORTS = [22, 23, 53, 80, 443, 4444, 5432, 6667, 8080, 9001]
ROW_SET = [(f"port-{p}-{proto}", f"{proto} to {p}", "high" if p in (23, 4444) else "low",
            f"dst_port = {p} AND protocol = '{proto}'", 60 * 24 * (7 + p % 20), ["src_ip", "dst_ip", "dst_port"])
           for p in RULE_PORTS for proto in ("TCP", "DNS", "TLS", "HTTP")]
ROW_SET += [(f"name-{n}", f"name over {n}", "medium", f"protocol = 'DNS' AND length(dns_query) > {n}", 43200, ["src_ip", "dst_ip", "dns_query"])
            for n in range(20, 110, 10)]
ROW_SET += [("broken", "no such column", "low", "nothing = 1", 5, ["src_ip"])]
GROUP_SET = [("fan-out", "many ports", "high", "protocol IN ('TCP', 'UDP')", 43200, ["src_ip"], "distinct dst_port", 9.0),
             ("talk", "much out", "medium", "true", 20160, ["src_ip"], "sum bytes_out", 100000.0),
             ("errors", "many errors", "low", "http_status >= 500", 43200, ["src_ip"], "flows", 3.0),
             ("pairs", "busy pair", "low", "protocol = 'HTTP'", 43200, ["src_ip", "dst_ip"], "flows", 2.0)]


def _duck_row_set() -> str:
    return " UNION ALL ".join(
        f"SELECT '{i}' AS rule_id, '{t}' AS rule_title, '{s}' AS severity, src_ip, dst_ip, "
        f"{'CAST(dst_port AS VARCHAR)' if 'dst_port' in c else 'dns_query'} AS detail FROM flows WHERE ({w}) AND ts > {NOW} - INTERVAL {m} MINUTES"
        for i, t, s, w, m, c in ROW_SET if i != "broken")


@register("row_rules_one_scan", W(_duck_row_set()))
def q_row_rules_one_scan(spark, sf):
    """49 row rules in one scan of the flows; a fiftieth that doesn't resolve stops none of them."""
    m, _ = RS.run_row_rules(td.flows(spark, sf), spark.createDataFrame(ROW_SET, RS.ROW_RULES))
    return m.select("rule_id", "rule_title", "severity", F.get_json_object("match_data", "$.src_ip").alias("src_ip"),
                    F.get_json_object("match_data", "$.dst_ip").alias("dst_ip"),
                    F.coalesce(F.get_json_object("match_data", "$.dst_port"), F.get_json_object("match_data", "$.dns_query")).alias("detail"))


def _duck_group_set() -> str:
    parts = []
    for i, t, s, w, m, keys, measure, over in GROUP_SET:
        kind, _, c = measure.partition(" ")
        what = {"flows": "count(*)", "sum": f"CAST(sum({c}) AS BIGINT)", "distinct": f"count(DISTINCT {c})"}[kind]
        dst = "dst_ip" if "dst_ip" in keys else "NULL"
        parts.append(f"SELECT '{i}' AS rule_id, '{s}' AS severity, src_ip, {dst} AS dst_ip, {what} AS value FROM flows "
                     f"WHERE ({w}) AND ts > {NOW} - INTERVAL {m} MINUTES GROUP BY {', '.join(keys)} HAVING {what} > {over}")
    return " UNION ALL ".join(parts)


@register("group_rules_one_pass", W(_duck_group_set()))
def q_group_rules_one_pass(spark, sf):
    m, _ = RS.run_group_rules(td.flows(spark, sf), spark.createDataFrame(GROUP_SET, RS.GROUP_RULES))
    return m.select("rule_id", "severity", F.get_json_object("match_data", "$.src_ip").alias("src_ip"),
                    F.get_json_object("match_data", "$.dst_ip").alias("dst_ip"),
                    F.get_json_object("match_data", "$.value").cast("long").alias("value"))


INCIDENT_LOG_SQL = """
SELECT CONCAT('inc-', CAST(CAST(FLOOR(o_orderkey / 8) AS BIGINT) AS STRING)) AS id,
  CASE o_orderkey % 5 WHEN 0 THEN 'create' WHEN 1 THEN 'ack' WHEN 3 THEN 'resolve' WHEN 4 THEN 'dispatch' ELSE 'note' END AS action,
  CONCAT('incident ', CAST(CAST(FLOOR(o_orderkey / 8) AS BIGINT) AS STRING)) AS title,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' ELSE 'medium' END AS severity,
  CASE WHEN o_custkey % 2 = 0 THEN 'sigma' ELSE 'manual' END AS source,
  CONCAT('rule-', CAST(o_custkey % 9 AS STRING)) AS source_id,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CONCAT('note ', CAST(o_orderkey AS STRING)) END AS note,
  CASE WHEN o_orderkey % 5 = 4 AND o_orderkey % 3 != 1 THEN CONCAT('OPS-', CAST(o_orderkey AS STRING)) ELSE '' END AS ref,
  CAST(o_orderdate AS TIMESTAMP) + CAST(o_orderkey % 1000 AS INT) * INTERVAL '1' MINUTE AS acted_at,
  o_orderkey AS version
FROM {orders}
"""


@register("incident_state", td.with_ctes("""
SELECT id,
  arg_max(title, version) FILTER (WHERE action = 'create') AS title,
  arg_max(severity, version) FILTER (WHERE action = 'create') AS severity,
  arg_max(source, version) FILTER (WHERE action = 'create') AS source,
  arg_max(source_id, version) FILTER (WHERE action = 'create') AS source_id,
  arg_max(CASE action WHEN 'create' THEN 'open' WHEN 'ack' THEN 'ack' WHEN 'resolve' THEN 'resolved' END, version)
    FILTER (WHERE action IN ('create', 'ack', 'resolve')) AS status,
  COALESCE(string_agg(chr(10) || '[' || strftime(acted_at, '%Y-%m-%d %H:%M') || '] ' || note, '' ORDER BY version)
    FILTER (WHERE action != 'create' AND note != ''), '') AS notes,
  COALESCE(string_agg(ref, ', ' ORDER BY version) FILTER (WHERE action = 'dispatch' AND ref != ''), '') AS external_ref,
  min(acted_at) AS created_at, max(acted_at) AS updated_at, max(version) AS version
FROM log GROUP BY id""", log=INCIDENT_LOG_SQL))
def q_incident_state(spark, sf):
    log = spark.sql(INCIDENT_LOG_SQL, orders=td.read_table(spark, sf, "orders"))
    return D.incident_state(log)


# fixed config: process policies (id, name, process, action, cidr, port, enabled)
POLICIES = [("p1", "bash to tor exits", "bash", "alert", "185.220.101.0/24", 0, True),
            ("p2", "curl to dns port", "curl", "deny", "", 53, True),
            ("p3", "python anywhere", "python3", "alert", "", 0, True),
            ("p4", "nginx disabled", "nginx", "deny", "", 0, False),
            ("p5", "sshd to 10.1/16 ssh", "sshd", "alert", "10.1.0.0/16", 22, True)]
POLICY_SCHEMA = "id string, name string, process_name string, action string, dst_ip_cidr string, dst_port int, enabled boolean"


@register("evaluate_policies", W(f"""
, p AS (SELECT * FROM (VALUES ('p1', 'bash to tor exits', 'bash', 'alert', 3118228736, 3118228991, 0),
          ('p2', 'curl to dns port', 'curl', 'deny', NULL, NULL, 53),
          ('p3', 'python anywhere', 'python3', 'alert', NULL, NULL, 0),
          ('p5', 'sshd to 10.1/16 ssh', 'sshd', 'alert', 167837696, 167903231, 22)) t(id, name, proc, action, lo, hi, port))
SELECT p.id AS policy_id, p.name AS policy_name, p.action, f.id AS flow_id, f.agent_id, f.hostname,
  f.process_name, f.pid, f.src_ip, f.dst_ip, f.dst_port, f.protocol, f.ts AS detected_at
FROM flows f JOIN p ON f.process_name = p.proc
  AND (p.lo IS NULL OR {duck_ipv4_long('f.dst_ip')} BETWEEN p.lo AND p.hi)
  AND (p.port = 0 OR f.dst_port = p.port)"""))
def q_evaluate_policies(spark, sf):
    return D.evaluate_policies(td.flows(spark, sf), spark.createDataFrame(POLICIES, POLICY_SCHEMA))


@register("list_audit", td.with_ctes("""
SELECT id, token_id, role, method, path, status, client_ip, latency_ms, ts FROM audit
WHERE method = 'POST' ORDER BY ts DESC, id DESC LIMIT 1000""", audit=td.AUDIT_SQL))
def q_list_audit(spark, sf):
    return D.newest(td.audit_events(spark, sf), "ts", limit=1000, method="POST")


@register("list_audit_by_token", td.with_ctes("""
SELECT id, token_id, role, method, path, status, client_ip, latency_ms, ts FROM audit
WHERE token_id = 'tok-3' AND status = 500""", audit=td.AUDIT_SQL))
def q_list_audit_by_token(spark, sf):
    return D.newest(td.audit_events(spark, sf), "ts", token_id="tok-3", status=500)


@register("list_rule_matches", W(MATCHES_DUCK + """
SELECT rule_id, severity, src_ip, dst_ip FROM matches WHERE severity = 'high'
ORDER BY src_ip DESC, dst_ip DESC LIMIT 50"""))
def q_list_rule_matches(spark, sf):
    m = custom_matches(spark, sf).withColumns({"src_ip": F.get_json_object("match_data", "$.src_ip"),
                                               "dst_ip": F.get_json_object("match_data", "$.dst_ip")})
    return D.newest(m, "fired_at", limit=50, tie=("src_ip", "dst_ip"), severity="high").select("rule_id", "severity", "src_ip", "dst_ip")


@register("list_baseline", W(BASELINE_CTE + """
SELECT agent_id, protocol, hour_of_week, ROUND(flow_count_mean, 6) AS flow_count_mean, sample_count FROM bl
WHERE agent_id = 'agent-3'"""))
def q_list_baseline(spark, sf):
    return finish(D.newest(baselines(spark, sf), "hour_of_week", agent_id="agent-3").select(
        "agent_id", "protocol", "hour_of_week", "flow_count_mean", "sample_count"))


@register("list_anomalies", W(BASELINE_CTE + f"""
, obs AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, agent_id, hostname, protocol,
            count(*) AS flow_count FROM flows WHERE agent_id != '' GROUP BY 1, 2, 3, 4),
j AS (SELECT o.*, b.flow_count_mean, b.flow_count_std FROM obs o JOIN bl b
      ON o.agent_id = b.agent_id AND o.protocol = b.protocol
      AND CAST((isodow(o.window_start) - 1) * 24 + hour(o.window_start) AS INTEGER) = b.hour_of_week
      WHERE b.sample_count >= 3),
s AS (SELECT window_start, agent_id, hostname, protocol, {_duck_score('12.0')} FROM j)
SELECT window_start, agent_id, protocol, ROUND(z_score, 6) AS z_score, severity FROM s
WHERE abs(z_score) >= 3 AND anomaly_type = 'spike' ORDER BY window_start DESC, agent_id DESC, protocol DESC LIMIT 100"""))
def q_list_anomalies(spark, sf):
    a = D.detect_anomalies_history(td.flows(spark, sf), baselines(spark, sf))
    return finish(D.newest(a, "window_start", limit=100, tie=("agent_id", "protocol"), anomaly_type="spike").select(
        "window_start", "agent_id", "protocol", "z_score", "severity"))


@register("list_violations", CATALOG["evaluate_policies"].sql.rstrip()
          + "\nWHERE p.action = 'deny' ORDER BY f.ts DESC, f.id DESC LIMIT 200")
def q_list_violations(spark, sf):
    v = D.evaluate_policies(td.flows(spark, sf), spark.createDataFrame(POLICIES, POLICY_SCHEMA))
    return D.newest(v, "detected_at", limit=200, tie="flow_id", action="deny")


@register("anomaly_stats", W(BASELINE_CTE + f"""
, obs AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, agent_id, hostname, protocol,
            count(*) AS flow_count FROM flows WHERE agent_id != '' GROUP BY 1, 2, 3, 4),
j AS (SELECT o.*, b.flow_count_mean, b.flow_count_std FROM obs o JOIN bl b
      ON o.agent_id = b.agent_id AND o.protocol = b.protocol
      AND CAST((isodow(o.window_start) - 1) * 24 + hour(o.window_start) AS INTEGER) = b.hour_of_week
      WHERE b.sample_count >= 3),
s AS (SELECT window_start, {_duck_score('12.0')} FROM j),
a AS (SELECT * FROM s WHERE abs(z_score) >= 3 AND window_start >= {NOW} - INTERVAL 168 HOURS)
SELECT count(*) AS total, count(*) FILTER (WHERE severity = 'critical') AS critical,
  count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium,
  count(*) FILTER (WHERE severity = 'low') AS low, max(window_start) AS last_seen FROM a"""))
def q_anomaly_stats(spark, sf):
    f = td.flows(spark, sf)
    an = D.detect_anomalies_history(f, baselines(spark, sf))
    return D.severity_counts(an, "window_start", as_of_col(f), hours=168)


# ---- dashboards and digests -------------------------------------------------------

DASH_SPEC = ('[{"id": "stats", "type": "stat", "config": {"metric": "total_bytes"}},'
             ' {"id": "ts", "type": "timeseries", "config": {"window": "6h"}},'
             ' {"id": "pie", "type": "protocol_pie"},'
             ' {"id": "talk", "type": "top_talkers", "config": {"window": "7d", "by": "bytes", "limit": 5}},'
             ' {"id": "alerts", "type": "alert_feed", "config": {"limit": 5}},'
             ' {"id": "anoms", "type": "anomaly_feed", "config": {"limit": 20, "severity": "medium"}}]')


def _dash_inputs(spark, sf):
    from flowlens.plans.dashboard import Inputs
    f = td.flows(spark, sf)
    an = D.detect_anomalies_history(f, baselines(spark, sf)).withColumnRenamed("window_start", "detected_at")
    return Inputs(flows=f, as_of=as_of_col(f), agents=td.agents(spark, sf), anomalies=an,
                  alert_events=spark.sql(EVENTS_SQL, flows=f))


@register("dashboard_stats", W(BASELINE_CTE + f"""
, obs AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, agent_id, hostname, protocol,
            count(*) AS flow_count FROM flows WHERE agent_id != '' GROUP BY 1, 2, 3, 4),
j AS (SELECT o.*, b.flow_count_mean, b.flow_count_std FROM obs o JOIN bl b
      ON o.agent_id = b.agent_id AND o.protocol = b.protocol
      AND CAST((isodow(o.window_start) - 1) * 24 + hour(o.window_start) AS INTEGER) = b.hour_of_week
      WHERE b.sample_count >= 3),
s AS (SELECT window_start, {_duck_score('12.0')} FROM j),
ev AS ({EVENTS_SQL.format(flows='flows')})
SELECT (SELECT count(*) FROM flows) AS total_flows,
  (SELECT CAST(COALESCE(sum(bytes_in + bytes_out), 0) AS BIGINT) FROM flows WHERE ts >= {NOW} - INTERVAL 24 HOURS) AS total_bytes,
  (SELECT count(DISTINCT agent_id) FROM agents WHERE last_seen > {NOW} - INTERVAL 5 MINUTES) AS active_agents,
  (SELECT count(*) FROM s WHERE abs(z_score) >= 3 AND window_start >= {NOW} - INTERVAL 24 HOURS) AS anomaly_count,
  (SELECT count(*) FROM ev WHERE fired_at > {NOW} - INTERVAL 24 HOURS) AS alert_count""", agents=td.AGENTS_SQL))
def q_dashboard_stats(spark, sf):
    from flowlens.plans.dashboard import stat_metrics
    return stat_metrics(_dash_inputs(spark, sf))


@register("dashboard_widgets", W(BASELINE_CTE + f"""
, obs AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, agent_id, hostname, protocol,
            count(*) AS flow_count FROM flows WHERE agent_id != '' GROUP BY 1, 2, 3, 4),
j AS (SELECT o.*, b.flow_count_mean, b.flow_count_std FROM obs o JOIN bl b
      ON o.agent_id = b.agent_id AND o.protocol = b.protocol
      AND CAST((isodow(o.window_start) - 1) * 24 + hour(o.window_start) AS INTEGER) = b.hour_of_week
      WHERE b.sample_count >= 3),
s AS (SELECT window_start, agent_id, protocol, {_duck_score('12.0')} FROM j),
ev AS ({EVENTS_SQL.format(flows='flows')})
SELECT 'stats' AS widget, 'total_bytes' AS label, CAST(COALESCE(sum(bytes_in + bytes_out), 0) AS DOUBLE) AS value
FROM flows WHERE ts >= {NOW} - INTERVAL 24 HOURS
UNION ALL SELECT 'ts', strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M'), CAST(count(*) AS DOUBLE) FROM flows
  WHERE ts >= {NOW} - INTERVAL 6 HOURS GROUP BY 2
UNION ALL SELECT 'pie', protocol, CAST(count(*) AS DOUBLE) FROM flows WHERE ts >= {NOW} - INTERVAL 1 HOUR GROUP BY 2
UNION ALL (SELECT 'talk', src_ip, CAST(sum(bytes_in + bytes_out) AS DOUBLE) AS v FROM flows WHERE ts > {NOW} - INTERVAL 7 DAYS
  GROUP BY src_ip ORDER BY v DESC, src_ip LIMIT 5)
UNION ALL (SELECT 'alerts', rule_id, CAST(epoch(fired_at) AS DOUBLE) FROM ev ORDER BY fired_at DESC, rule_id DESC LIMIT 5)
UNION ALL (SELECT 'anoms', agent_id || ' ' || protocol, ROUND(z_score, 6) FROM s WHERE abs(z_score) >= 3 AND severity = 'medium'
  ORDER BY window_start DESC, agent_id DESC, protocol DESC LIMIT 20)"""))
def q_dashboard_widgets(spark, sf):
    """The values of all widgets of a dashboard, one (widget, label, value) row each."""
    from flowlens.plans.dashboard import dashboard_widgets
    shape = {"stats": ("metric", "value"), "ts": (F.date_format("minute", "yyyy-MM-dd HH:mm"), "cnt"), "pie": ("protocol", "cnt"),
             "talk": ("src_ip", "total_bytes"), "alerts": ("rule_id", F.unix_micros("fired_at") / 1e6),
             "anoms": (F.concat_ws(" ", "agent_id", "protocol"), "z_score")}
    out = None
    for wid, df in dashboard_widgets(DASH_SPEC, _dash_inputs(spark, sf)).items():
        label, value = (F.col(c) if isinstance(c, str) else c for c in shape[wid])
        part = df.select(F.lit(wid).alias("widget"), label.alias("label"), value.cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    return finish(out)


@register("digest_daily", W(f"""
SELECT (SELECT count(*) FROM flows WHERE ts >= {NOW} - INTERVAL 7 DAYS) AS flows,
  (SELECT count(DISTINCT agent_id) FROM flows WHERE ts >= {NOW} - INTERVAL 7 DAYS) AS active_agents,
  (SELECT count(*) FROM ({EVENTS_SQL.format(flows='flows')}) e WHERE fired_at >= {NOW} - INTERVAL 7 DAYS) AS alerts"""))
def q_digest_daily(spark, sf):
    from flowlens.operators.aggregate import digest
    f = td.flows(spark, sf)
    head, _, _ = digest(f, spark.sql(EVENTS_SQL, flows=f), period="weekly")
    return head


@register("digest_top_sources", W(f"""
SELECT src_ip, CAST(sum(bytes_in + bytes_out) AS BIGINT) AS bytes FROM flows WHERE ts >= {NOW} - INTERVAL 7 DAYS
GROUP BY src_ip ORDER BY bytes DESC, src_ip LIMIT 5"""))
def q_digest_top_sources(spark, sf):
    from flowlens.operators.aggregate import digest
    _, talkers, _ = digest(td.flows(spark, sf), None, period="weekly")
    return talkers


@register("digest_protocols", W(f"""
SELECT protocol, count(*) AS flows FROM flows WHERE ts >= {NOW} - INTERVAL 24 HOURS
GROUP BY protocol ORDER BY flows DESC, protocol LIMIT 6"""))
def q_digest_protocols(spark, sf):
    from flowlens.operators.aggregate import digest
    _, _, protos = digest(td.flows(spark, sf), None, period="daily")
    return protos
