"""Registered streaming queries.

Each runs a Structured Streaming job (``availableNow``) over a file source of
several files, so there are several micro-batches, into a Parquet sink in the
shared folder, and returns the stored rows.  Windowed jobs emit a window once the
watermark has passed it; their oracles keep the windows closed by then.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flowlens.functions.timewin import as_of_col
from flowlens.operators import detect as D
from flowlens.plans import q_compliance as QC
from flowlens.plans import q_detect as QD
from flowlens.plans import q_flows as QF
from flowlens.plans.catalog import CATALOG, finish, register
from flowlens.sources import ingest as IN
from flowlens.sources import testdata as td
from flowlens.streaming import jobs as J
from flowlens.streaming import learn as L
from flowlens.streaming import state as ST

#: Files, and so micro-batches, of a source.
FILES = 4
#: The end of what the watermark has closed, in DuckDB.
CLOSED = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM flows)"


def W(body: str, **extra: str) -> str:
    return td.with_ctes(body, flows=td.FLOWS_SQL, **extra)


def fresh(kind: str) -> str:
    return f"{kind}_{uuid.uuid4().hex[:12]}"


#: Rows of one file of a source, at least, before a step in time becomes several files.
FILE_ROWS = 250_000


def in_files(spark, df, order: str, name: str) -> tuple[str, int]:
    """Write a table as steps that follow each other in ``order``, each as the same number of
    files, which is returned too; a file source reads the oldest files first."""
    path = J.stream_folder(spark, name, "in")
    at = F.unix_micros(F.col(order).cast("timestamp"))
    lo, hi = df.agg(F.min(at), F.max(at)).first()
    part = F.least(F.floor((at - lo) * FILES / max(hi - lo, 1)), F.lit(FILES - 1))
    rows = dict(df.groupBy(part.alias("part")).agg(F.count(F.lit(1))).collect())
    files = max(1, min(rows.get(i, 0) for i in range(FILES)) // FILE_ROWS)
    for i in range(FILES):
        step = df.filter(part == i)
        (step.coalesce(1) if files == 1 else step.repartition(files)).write.mode("append").parquet(path)
    return path, files


def file_stream(spark, df, order: str, name: str):
    path, files = in_files(spark, df, order, name)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def flow_stream(spark, sf, name: str):
    ev = td.read_table(spark, sf, "events")
    return spark.sql(td.FLOWS_SQL, events=file_stream(spark, ev, "ts", name))


NOW_TRIGGER = {"availableNow": True}


def finished(query) -> None:
    query.awaitTermination()


def appended(spark, df, name: str):
    path = J.stream_folder(spark, name, "out")
    finished(J.append_to(df, path, name, NOW_TRIGGER))
    return spark.read.schema(df.schema).parquet(path)


@register("stream_timeseries", W(f"""
SELECT date_trunc('minute', ts) AS minute, count(*) AS cnt, CAST(sum(bytes_in) AS BIGINT) AS bytes_in,
  CAST(sum(bytes_out) AS BIGINT) AS bytes_out FROM flows
GROUP BY 1 HAVING date_trunc('minute', ts) + INTERVAL 1 MINUTE <= {CLOSED}"""))
def q_stream_timeseries(spark, sf):
    name = fresh("timeseries")
    return appended(spark, J.stream_timeseries(flow_stream(spark, sf, name)), name)


ROW_RULES_DUCK = """
SELECT id, 'dns_tunnel' AS rule, src_ip, ts FROM flows WHERE protocol = 'DNS' AND length(dns_query) > 60
UNION ALL SELECT id, 'cleartext_creds', src_ip, ts FROM flows WHERE protocol = 'HTTP' AND http_method = 'POST' AND dst_port != 443
  AND (http_path LIKE '%/login%' OR http_path LIKE '%/auth%' OR http_path LIKE '%/signin%' OR http_path LIKE '%/password%')
UNION ALL SELECT id, 'high_port', src_ip, ts FROM flows WHERE dst_port > 49151 AND protocol = 'TCP' AND bytes_out > 10000
UNION ALL SELECT id, 'shell_process', src_ip, ts FROM flows WHERE protocol = 'TCP' AND dst_port NOT IN (22, 80, 443)
  AND process_name IN ('bash', 'sh', 'zsh', 'python', 'python3', 'powershell', 'pwsh', 'cmd', 'perl', 'ruby')"""


@register("stream_rules", W(ROW_RULES_DUCK))
def q_stream_rules(spark, sf):
    name = fresh("rules")
    rows = J.stream_rules(flow_stream(spark, sf, name))
    return appended(spark, rows.select("id", "rule", "src_ip", "ts"), name)


@register("stream_port_scans", W(f"""
SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, src_ip, count(DISTINCT dst_port) AS port_count, min(ts) AS first_seen
FROM flows WHERE protocol IN ('TCP', 'UDP') GROUP BY 1, 2
HAVING count(DISTINCT dst_port) > 1 AND time_bucket(INTERVAL '6 hours', ts) + INTERVAL 6 HOUR <= {CLOSED}"""))
def q_stream_port_scans(spark, sf):
    name = fresh("scans")
    return appended(spark, J.stream_port_scans(flow_stream(spark, sf, name), minutes=360, min_ports=1), name)


@register("stream_agent_sessions", W(f"""
, g AS (SELECT agent_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY agent_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM flows),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY agent_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT agent_id, min(ts) AS online_from, max(ts) + INTERVAL 30 MINUTE AS online_until, count(*) AS flows FROM s
GROUP BY agent_id, n HAVING max(ts) + INTERVAL 30 MINUTE <= {CLOSED}"""))
def q_stream_agent_sessions(spark, sf):
    name = fresh("sessions")
    return appended(spark, J.agent_sessions(flow_stream(spark, sf, name), gap="30 minutes"), name)


@register("stream_detect", W(QD.BASELINE_CTE + f"""
, obs AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, agent_id, hostname, protocol,
            count(*) AS flow_count FROM flows WHERE agent_id != '' GROUP BY 1, 2, 3, 4),
j AS (SELECT o.*, b.flow_count_mean, b.flow_count_std FROM obs o JOIN bl b
      ON o.agent_id = b.agent_id AND o.protocol = b.protocol
      AND CAST((isodow(o.window_start) - 1) * 24 + hour(o.window_start) AS INTEGER) = b.hour_of_week
      WHERE b.sample_count >= 3),
s AS (SELECT window_start, agent_id, hostname, protocol, {QD._duck_score('12.0')} FROM j)
SELECT window_start, agent_id, hostname, protocol, anomaly_type, ROUND(z_score, 6) AS z_score,
  ROUND(observed, 6) AS observed, ROUND(expected, 6) AS expected, description, severity
FROM s WHERE abs(z_score) >= 3 AND window_start + INTERVAL 5 MINUTE <= {CLOSED}"""))
def q_stream_detect(spark, sf):
    name = fresh("detect")
    path = J.stream_folder(spark, name, "baselines")
    QD.baselines(spark, sf).write.parquet(path)
    return finish(appended(spark, J.stream_detect(flow_stream(spark, sf, name), spark.read.parquet(path)), name))


@register("stream_live_tail", W("SELECT id, ts, src_ip, dns_query FROM flows WHERE protocol = 'DNS'"))
def q_stream_live_tail(spark, sf):
    name = fresh("tail")
    rows = J.live_tail(flow_stream(spark, sf, name), F.col("protocol") == "DNS")
    return appended(spark, rows.select("id", "ts", "src_ip", "dns_query"), name)


@register("stream_policies", CATALOG["evaluate_policies"].sql)
def q_stream_policies(spark, sf):
    name = fresh("policies")
    policies = spark.createDataFrame(QD.POLICIES, QD.POLICY_SCHEMA)
    return appended(spark, J.stream_policies(flow_stream(spark, sf, name), policies), name)


@register("stream_enrich", CATALOG["enrich_threat"].sql)
def q_stream_enrich(spark, sf):
    name = fresh("enrich")
    path = J.stream_folder(spark, name, "out")
    finished(J.stream_enrich(flow_stream(spark, sf, name), path, QF.blocklist(spark), trigger=NOW_TRIGGER, name=name))
    return spark.read.parquet(path).select("id", "dst_ip", "dst_port", "threat_score", "threat_level",
                                           F.array_join("threat_reasons", ",").alias("threat_reasons"))


@register("stream_certs", CATALOG["extract_certs"].sql)
def q_stream_certs(spark, sf):
    name = fresh("certs")
    path = J.stream_folder(spark, name, "out")
    flows = file_stream(spark, QC.cert_flows(spark, sf), "ts", name)
    finished(J.stream_certs(flows, path, trigger=NOW_TRIGGER, name=name))
    return J.cert_inventory(spark, path)


@register("stream_ingest", W("""
SELECT id, agent_id, hostname, ts, protocol, src_ip, src_port, dst_ip, dst_port, bytes_in, bytes_out, http_method, http_path,
  CAST(strftime(ts, '%Y%m') AS INTEGER) AS yyyymm FROM flows"""))
def q_stream_ingest(spark, sf):
    """Wire flows as JSON lines in several files -> the stored flow table."""
    name = fresh("ingest")
    f = td.flows(spark, sf)
    http = F.when(F.col("http_method") != "", F.struct(F.col("http_method").alias("method"), F.col("http_path").alias("path"),
                                                       F.col("http_status").alias("status")))
    wire = F.struct("id", "agent_id", "hostname", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
                    "protocol", "src_ip", "src_port", "dst_ip", "dst_port", "bytes_in", "bytes_out", "duration_ms",
                    http.alias("http"))
    path = J.stream_folder(spark, name, "in")
    f.select(F.to_json(wire).alias("value")).repartition(FILES).write.text(path)
    nested = IN.read_flow_stream(spark, fmt="json", path=path, options={"maxFilesPerTrigger": 1})
    out = J.stream_folder(spark, name, "flows")
    finished(J.stream_ingest(nested, out, J.stream_folder(spark, name, "agents"), blocklist=QF.blocklist(spark),
                             trigger=NOW_TRIGGER, name=name))
    return spark.read.parquet(out).select("id", "agent_id", "hostname", "ts", "protocol", "src_ip", "src_port", "dst_ip", "dst_port",
                                          "bytes_in", "bytes_out", "http_method", "http_path", "yyyymm")


CLOSED_EVENTS = "(SELECT date_trunc('millisecond', max(CAST(ts AS TIMESTAMP))) - INTERVAL 10 MINUTE FROM events)"
IDLE = "12 hours"


@register("stream_pair_http", td.with_ctes(f"""
, s AS (SELECT *, sum(fresh) OVER (PARTITION BY conn_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY conn_id ORDER BY ts, seq) + INTERVAL {IDLE} THEN 1 ELSE 0 END AS fresh
    FROM packets) WHERE ts <= {CLOSED_EVENTS}),
g AS (SELECT *, COALESCE(sum(CASE WHEN kind = 'response' THEN 1 ELSE 0 END) OVER (
        PARTITION BY conn_id, run ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM s),
rq AS (SELECT conn_id, run, grp, arg_min(seq, (ts, seq)) AS request_seq, min(ts) AS request_ts
       FROM g WHERE kind != 'response' GROUP BY 1, 2, 3)
SELECT rq.conn_id, request_seq, g.seq AS response_seq, request_ts, g.ts AS response_ts,
  CAST(greatest(floor((epoch_us(g.ts) - epoch_us(request_ts)) / 1000), 0) AS BIGINT) AS latency_ms
FROM rq JOIN g ON rq.conn_id = g.conn_id AND rq.run = g.run AND rq.grp = g.grp AND g.kind = 'response'""", packets=td.PACKETS_SQL))
def q_stream_pair_http(spark, sf):
    """Pairs of closed rows; connections silent for longer than 12 hours start anew."""
    name = fresh("pairs")
    packets = spark.sql(td.PACKETS_SQL, events=file_stream(spark, td.read_table(spark, sf, "events"), "ts", name))
    return appended(spark, ST.stream_pair_http(packets, idle=IDLE), name)


MAX_RTT = "2 DAYS"


@register("stream_icmp_rtt", td.with_ctes(f"""
, e AS (SELECT *, icmp_type IN (0, 129) AS is_reply, CASE WHEN icmp_type IN (0, 129) THEN dst_ip ELSE src_ip END AS host
        FROM icmp WHERE icmp_type IN (8, 128, 0, 129)),
l AS (SELECT *, lag(ts) OVER w AS b_ts, lag(seq) OVER w AS b_seq, lag(is_reply) OVER w AS b_reply
      FROM e WINDOW w AS (PARTITION BY host, echo_id, echo_seq ORDER BY ts, seq))
SELECT host, echo_id, echo_seq, b_seq AS request_seq, seq AS reply_seq,
  ROUND((epoch_us(ts) - epoch_us(b_ts)) / 1000.0, 6) AS rtt_ms
FROM l WHERE is_reply AND NOT b_reply AND ts <= b_ts + INTERVAL {MAX_RTT} AND ts <= {CLOSED_EVENTS} - INTERVAL {MAX_RTT}""",
                                           icmp=td.ICMP_SQL))
def q_stream_icmp_rtt(spark, sf):
    """Round trips of at most two days; an interval join closes its replies that much later."""
    name = fresh("rtt")
    icmp = spark.sql(td.ICMP_SQL, events=file_stream(spark, td.read_table(spark, sf, "events"), "ts", name))
    return finish(appended(spark, ST.stream_icmp_rtt(icmp, max_rtt=MAX_RTT), name))


def _alert_values() -> str:
    """DuckDB: the value of each enabled rule at each closed minute."""
    windows = sorted({r[5] or 5 for r in QD.ALERT_RULES} | {5})
    sums = ",\n  ".join(f"sum({c}) OVER (ORDER BY tick ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS {c}_{w}"
                        for w in windows for c in ("n", "http", "http_err", "dns", "nx", "lat_sum", "lat_n"))
    parts = []
    for rule, _, metric, condition, threshold, window, cooldown, enabled in QD.ALERT_RULES:
        w = window or 5
        value = {"flows_per_minute": f"n_{w} / {float(w)}", "http_error_rate": f"http_err_{w} * 100.0 / greatest(http_{w}, 1)",
                 "dns_nxdomain_rate": f"nx_{w} * 100.0 / greatest(dns_{w}, 1)",
                 "anomaly_flow_rate": "CASE WHEN COALESCE(b_std, 0) < 1 THEN 0.0 ELSE (n_5 * 12.0 - b_avg) / b_std END",
                 "anomaly_http_latency": "CASE WHEN COALESCE(l_std, 0) < 1 THEN 0.0 WHEN lat_n_5 > 0 THEN (lat_sum_5 / lat_n_5 - l_avg) / l_std END",
                 }[metric]
        if enabled:
            parts.append(f"SELECT '{rule}' AS rule_id, tick, CAST({value} AS DOUBLE) AS value FROM t WHERE ({value}) {'>' if condition == 'gt' else '<'} {threshold}")
    return f"""
, m AS (SELECT date_trunc('minute', ts) + INTERVAL 1 MINUTE AS tick, count(*) AS n, count(*) FILTER (protocol = 'HTTP') AS http,
    count(*) FILTER (protocol = 'HTTP' AND http_status >= 400) AS http_err, count(*) FILTER (protocol = 'DNS') AS dns,
    count(*) FILTER (protocol = 'DNS' AND dns_rcode = 3) AS nx,
    COALESCE(sum(duration_ms) FILTER (protocol IN ('HTTP', 'HTTPS') AND http_method != ''), 0) AS lat_sum,
    count(duration_ms) FILTER (protocol IN ('HTTP', 'HTTPS') AND http_method != '') AS lat_n FROM flows GROUP BY 1),
times AS (SELECT unnest(generate_series((SELECT min(tick) FROM m), date_trunc('minute', {CLOSED}), INTERVAL 1 MINUTE)) AS tick),
dense AS (SELECT times.tick, COALESCE(n, 0) AS n, COALESCE(http, 0) AS http, COALESCE(http_err, 0) AS http_err, COALESCE(dns, 0) AS dns,
    COALESCE(nx, 0) AS nx, COALESCE(lat_sum, 0) AS lat_sum, COALESCE(lat_n, 0) AS lat_n FROM times LEFT JOIN m USING (tick)),
h AS (SELECT date_trunc('hour', tick - INTERVAL 1 MINUTE) AS h, sum(n) AS cnt, sum(lat_sum) AS s, sum(lat_n) AS k FROM m GROUP BY 1),
r AS (SELECT tick, date_trunc('hour', tick - INTERVAL 7 DAY + INTERVAL 59 MINUTE) AS lo, date_trunc('hour', tick) - INTERVAL 2 HOUR AS hi FROM times),
b AS (SELECT lo, hi, avg(cnt) AS b_avg,
      -- from whole sums: a deviation of exactly 1 stands on the edge of the test, where merged partial moments vary by run
      sqrt(CAST(count(*) * sum(CAST(cnt AS HUGEINT) * cnt) - sum(cnt) * sum(cnt) AS DOUBLE)) / count(*) AS b_std,
      avg(s / k) FILTER (k > 0) AS l_avg, stddev_pop(s / k) FILTER (k > 0) AS l_std
      FROM (SELECT DISTINCT lo, hi FROM r) d JOIN h ON h.h >= d.lo AND h.h <= d.hi GROUP BY 1, 2),
t AS (SELECT r.tick, b.* EXCLUDE (lo, hi), w.* EXCLUDE (tick) FROM r LEFT JOIN b USING (lo, hi) JOIN (
  SELECT tick,
  {sums} FROM dense) w ON w.tick = r.tick),
breach AS ({" UNION ALL ".join(parts)})"""


@register("stream_alerts", W(_alert_values() + f"""
, rules AS (SELECT id AS rule_id, name, metric, condition, threshold, COALESCE(NULLIF(window_minutes, 0), 5) AS window_minutes,
    COALESCE(NULLIF(cooldown_minutes, 0), 15) AS cooldown FROM ({QD._duck_rules()}) x),
-- a breach fires if the last firing, the end of the list so far, is a cooldown ago
lists AS (SELECT rule_id, any_value(cooldown) * INTERVAL 1 MINUTE AS pause, list([tick] ORDER BY tick) AS ticks
  FROM breach JOIN rules USING (rule_id) GROUP BY rule_id),
fire AS (SELECT rule_id, unnest(list_reduce(ticks, lambda done, x:
    CASE WHEN x[1] >= done[len(done)] + pause THEN list_concat(done, x) ELSE done END)) AS tick FROM lists)
SELECT f.rule_id, name AS rule_name, metric, ROUND(value, 6) AS value, ROUND(threshold, 6) AS threshold, f.tick AS fired_at,
  printf('[flowlens] %s: %s is %.2f (%s threshold %.2f over last %d min)', name, metric, round_even(value, 2) + 0.0,
    CASE condition WHEN 'gt' THEN 'exceeded' ELSE 'fell below' END, round_even(threshold, 2), window_minutes) AS message
FROM fire f JOIN breach USING (rule_id, tick) JOIN rules USING (rule_id)"""))
def q_stream_alerts(spark, sf):
    """All events that the rules fired over the replay, a cooldown after the other."""
    name = fresh("alerts")
    rules = spark.createDataFrame(QD.ALERT_RULES, QD.RULES_SCHEMA)
    return finish(appended(spark, ST.stream_alerts(flow_stream(spark, sf, name), rules), name))


@register("stream_learned_baselines", W(f"""
, horizon AS (SELECT max(time_bucket(INTERVAL '5 minutes', ts)) AS h FROM flows
    WHERE agent_id != '' AND time_bucket(INTERVAL '5 minutes', ts) + INTERVAL 5 MINUTE <= {CLOSED}),
hc AS (SELECT agent_id, protocol, date_trunc('hour', ts) AS hb, count(*) AS c, sum(bytes_in) AS bi, sum(bytes_out) AS bo
       FROM flows WHERE agent_id != '' GROUP BY 1, 2, 3 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT h FROM horizon))
SELECT agent_id, protocol, CAST((isodow(hb) - 1) * 24 + hour(hb) AS INTEGER) AS hour_of_week, ROUND(avg(c), 6) AS flow_count_mean,
  ROUND(stddev_pop(c), 6) AS flow_count_std, ROUND(avg(bi), 6) AS bytes_in_mean, ROUND(avg(bo), 6) AS bytes_out_mean, count(*) AS sample_count
FROM hc GROUP BY 1, 2, 3"""))
def q_stream_learned_baselines(spark, sf):
    """The last version of baselines learnt over the replay."""
    name = fresh("learn")
    path = J.stream_folder(spark, name, "baselines")
    finished(L.stream_learn(flow_stream(spark, sf, name), path, J.stream_folder(spark, name, "events"), trigger=NOW_TRIGGER, name=name))
    return finish(L.learned_baselines(spark, path))
