"""Registered queries over sliding windows and stored sketches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flowlens.functions.timewin import as_of_col
from flowlens.operators import sketches as SK
from flowlens.operators import sweep as SW
from flowlens.plans.catalog import finish, register
from flowlens.session import ensure_checkpoint_dir
from flowlens.sources import testdata as td

NOW = "(SELECT max(ts) FROM flows)"
SCAN_MINUTES, SCAN_PORTS = 2880, 2


def W(body: str, **extra: str) -> str:
    return td.with_ctes(body, flows=td.FLOWS_SQL, **extra)


@register("port_scans_sliding", W(f"""
, p AS (SELECT src_ip, dst_port, ts FROM flows WHERE protocol IN ('TCP', 'UDP')),
c AS (SELECT DISTINCT src_ip, ts,
    count(DISTINCT dst_port) OVER (PARTITION BY src_ip ORDER BY ts
      RANGE BETWEEN INTERVAL '{SCAN_MINUTES} minutes' - INTERVAL 1 MICROSECOND PRECEDING AND CURRENT ROW) AS now,
    count(DISTINCT dst_port) OVER (PARTITION BY src_ip ORDER BY ts
      RANGE BETWEEN INTERVAL '{SCAN_MINUTES} minutes' - INTERVAL 1 MICROSECOND PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS before
  FROM p)
SELECT src_ip, ts AS at, now AS port_count FROM c WHERE now > {SCAN_PORTS} AND before <= {SCAN_PORTS}"""))
def q_port_scans_sliding(spark, sf):
    return SW.port_scans(td.flows(spark, sf), minutes=SCAN_MINUTES, min_ports=SCAN_PORTS)


def stored(spark, df, kind: str):
    """Write a table of sketches to the shared folder and read it again."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


ENDPOINTS_DUCK = """
SELECT '{w}' AS span, http_method, http_path, count(*) AS total,
  count(*) FILTER (WHERE http_status >= 200 AND http_status < 400) AS success_count,
  count(*) FILTER (WHERE http_status >= 400) AS error_count,
  ROUND(count(*) FILTER (WHERE http_status >= 400) / count(*) * 100.0, 6) AS error_rate, ROUND(avg(duration_ms), 6) AS avg_latency,
  TRUE AS p50_in_bound, TRUE AS p95_in_bound, TRUE AS p99_in_bound
FROM flows WHERE protocol IN ('HTTP', 'HTTPS') AND http_method != '' AND http_path != ''
  AND ts >= date_trunc('minute', {now}) - INTERVAL {w} AND ts < date_trunc('minute', {now})
GROUP BY http_method, http_path"""
SPANS = ("6 HOURS", "1 DAY", "7 DAYS", "30 DAYS")
RANK_ERROR = 0.01


@register("endpoint_sketches", W(" UNION ALL ".join(ENDPOINTS_DUCK.format(w=w, now=NOW) for w in SPANS)))
def q_endpoint_sketches(spark, sf):
    """Endpoint statistics of four windows from one table of stored minute sketches; each
    percentile is marked by whether its rank among the window's exact latencies is within the bound."""
    flows = td.flows(spark, sf)
    sketches = stored(spark, SK.latency_sketches(flows), "latency-sketches")
    now = F.date_trunc("minute", as_of_col(flows))
    web = flows.filter(F.col("protocol").isin("HTTP", "HTTPS") & (F.col("http_method") != "") & (F.col("http_path") != ""))
    keys = ["http_method", "http_path"]
    out = None
    for w in SPANS:
        start = now - F.expr(f"INTERVAL {w}")
        stats = SK.endpoint_stats_from_sketches(sketches, start, now)
        exact = web.filter((F.col("ts") >= start) & (F.col("ts") < now)).join(stats.select(*keys, "p50", "p95", "p99"), keys)
        marks = []
        for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            below, upto = (F.count_if(F.col("duration_ms") < F.col(name)) / F.count(F.lit(1)),
                           F.count_if(F.col("duration_ms") <= F.col(name)) / F.count(F.lit(1)))
            marks.append(((below <= p + RANK_ERROR) & (upto >= p - RANK_ERROR)).alias(f"{name}_in_bound"))
        checked = exact.groupBy(*keys).agg(*marks)
        part = stats.drop("p50", "p95", "p99").join(checked, keys).withColumn("span", F.lit(w))
        out = part if out is None else out.unionByName(part)
    return finish(out)


@register("distinct_sketches", W(f"""
, e AS (SELECT src_ip, count(*) AS flow_count, CAST(sum(bytes_out) AS BIGINT) AS bytes_out, CAST(sum(bytes_in) AS BIGINT) AS bytes_in,
    count(DISTINCT dst_ip) AS exact_values FROM flows WHERE ts >= date_trunc('hour', {NOW}) - INTERVAL 7 DAYS GROUP BY 1)
SELECT src_ip, flow_count, bytes_out, bytes_in, exact_values, TRUE AS in_bound FROM e"""))
def q_distinct_sketches(spark, sf):
    """Distinct destinations of each source in seven days, from hourly sketches, beside the exact count."""
    flows = td.flows(spark, sf)
    start = F.date_trunc("hour", as_of_col(flows)) - F.expr("INTERVAL 7 DAYS")
    est = SK.distinct_from_sketches(stored(spark, SK.distinct_sketches(flows, ["src_ip"], "dst_ip"), "distinct-sketches"), ["src_ip"], start)
    exact = flows.filter(F.col("ts") >= start).groupBy("src_ip").agg(F.count_distinct("dst_ip").alias("exact_values"))
    near = F.abs(F.col("distinct_values") - F.col("exact_values")) <= F.greatest(F.col("exact_values") * 0.04, F.lit(1))
    return est.join(exact, "src_ip").select("src_ip", "flow_count", "bytes_out", "bytes_in", "exact_values", near.alias("in_bound"))


@register("seen_in_both_sketches", W(f"""
, a AS (SELECT DISTINCT src_ip FROM flows WHERE ts < date_trunc('hour', {NOW}) - INTERVAL 7 DAYS),
b AS (SELECT DISTINCT src_ip FROM flows WHERE ts >= date_trunc('hour', {NOW}) - INTERVAL 7 DAYS)
SELECT (SELECT count(*) FROM a) AS earlier, (SELECT count(*) FROM b) AS later, (SELECT count(*) FROM a JOIN b USING (src_ip)) AS in_both,
  (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS in_either"""))
def q_seen_in_both_sketches(spark, sf):
    """Sources seen before the last seven days, since, in both; the test tables hold fewer sources
    than a sketch keeps, where its counts are exact."""
    flows = td.flows(spark, sf)
    edge = F.date_trunc("hour", as_of_col(flows)) - F.expr("INTERVAL 7 DAYS")
    sketches = stored(spark, SK.set_sketches(flows, "src_ip"), "set-sketches")
    return SK.seen_in_both(sketches, F.col("bucket") < edge, F.col("bucket") >= edge)
