"""Registered per-connection protocol queries (pairing, RTT, TCP health, headers, DNS)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import sessions as SS
from flowlens.plans.catalog import finish, register
from flowlens.sources import testdata as td

# TCP segments of 20 connections x 2 directions, sequence numbers that jump
# back and forth so all three classes occur
TCP_SQL = """
SELECT CAST(user_id % 20 AS BIGINT) AS conn_id, CASE WHEN event_id % 2 = 0 THEN 'c2s' ELSE 's2c' END AS direction,
  CAST(ts AS TIMESTAMP) AS ts, event_id AS seg_id,
  CAST((CAST(FLOOR(value) AS BIGINT) % 12) * 100 AS BIGINT) AS tcp_seq,
  CAST(CASE WHEN event_type = 'error' THEN 0 ELSE 100 END AS BIGINT) AS length
FROM {events}
"""


@register("pair_http", td.with_ctes("""
, g AS (SELECT *, COALESCE(sum(CASE WHEN kind = 'response' THEN 1 ELSE 0 END) OVER (
          PARTITION BY conn_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp
        FROM packets),
rq AS (SELECT conn_id, grp, arg_min(seq, (ts, seq)) AS request_seq, min(ts) AS request_ts
       FROM g WHERE kind != 'response' GROUP BY 1, 2),
rs AS (SELECT conn_id, grp, seq AS response_seq, ts AS response_ts FROM g WHERE kind = 'response')
SELECT rq.conn_id, request_seq, response_seq, request_ts, response_ts,
  CAST(greatest(floor((epoch_us(response_ts) - epoch_us(request_ts)) / 1000), 0) AS BIGINT) AS latency_ms
FROM rq JOIN rs ON rq.conn_id = rs.conn_id AND rq.grp = rs.grp""", packets=td.PACKETS_SQL))
def q_pair_http(spark, sf):
    return SS.pair_http(td.packet_events(spark, sf))


@register("icmp_rtt", td.with_ctes("""
, e AS (SELECT *, icmp_type IN (0, 129) AS is_reply, CASE WHEN icmp_type IN (0, 129) THEN dst_ip ELSE src_ip END AS host
        FROM icmp WHERE icmp_type IN (8, 128, 0, 129)),
g AS (SELECT *, COALESCE(sum(CASE WHEN is_reply THEN 1 ELSE 0 END) OVER (
        PARTITION BY host, echo_id, echo_seq ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp
      FROM e),
rq AS (SELECT host, echo_id, echo_seq, grp, arg_max(seq, (ts, seq)) AS request_seq, max(ts) AS request_ts
       FROM g WHERE NOT is_reply GROUP BY 1, 2, 3, 4),
rp AS (SELECT host, echo_id, echo_seq, grp, seq AS reply_seq, ts AS reply_ts FROM g WHERE is_reply)
SELECT rq.host, rq.echo_id, rq.echo_seq, request_seq, reply_seq,
  ROUND((epoch_us(reply_ts) - epoch_us(request_ts)) / 1000.0, 6) AS rtt_ms
FROM rq JOIN rp USING (host, echo_id, echo_seq, grp)""", icmp=td.ICMP_SQL))
def q_icmp_rtt(spark, sf):
    return finish(SS.icmp_rtt(td.icmp_events(spark, sf)))


@register("tcp_health", td.with_ctes("""
, s AS (SELECT conn_id, direction, tcp_seq, length,
          row_number() OVER (PARTITION BY conn_id, direction ORDER BY ts, seg_id) AS i FROM tcp WHERE length > 0),
-- what reassembly does with each segment in turn: position expected next, held segments, counters
walk AS (
  WITH RECURSIVE w AS (
    SELECT conn_id, direction, 1::BIGINT AS i, tcp_seq + length AS expected, []::BIGINT[] AS held, 0 AS again, 0 AS late
    FROM s WHERE i = 1
    UNION ALL
    SELECT n.conn_id, n.direction, n.i,
      CASE WHEN n.tcp_seq = w.expected THEN
        -- all segments are of one length: held ones follow on in whole steps
        n.tcp_seq + n.length * (1 + COALESCE(list_min(list_filter(range(1, 13), lambda x: NOT list_contains(w.held, n.tcp_seq + n.length * x))), 13) - 1)
      ELSE w.expected END,
      CASE WHEN n.tcp_seq > w.expected THEN list_append(w.held, n.tcp_seq) ELSE w.held END,
      w.again + CAST(n.tcp_seq < w.expected AS INTEGER), w.late + CAST(n.tcp_seq > w.expected AS INTEGER)
    FROM w JOIN s n ON n.conn_id = w.conn_id AND n.direction = w.direction AND n.i = w.i + 1)
  SELECT * FROM w)
SELECT conn_id, direction, max(i) AS segments, CAST(max(again) AS BIGINT) AS retransmissions, CAST(max(late) AS BIGINT) AS out_of_order
FROM walk GROUP BY 1, 2""", tcp=TCP_SQL))
def q_tcp_health(spark, sf):
    return SS.tcp_health(spark.sql(TCP_SQL, events=td.read_table(spark, sf, "events")))


def header_flows(spark, sf):
    """HTTP flows with header lists: one trace-context style per event_id % 8."""
    ev = td.read_table(spark, sf, "events")
    tid = F.lpad(F.hex("event_id"), 32, "0")
    sid = F.lpad(F.hex("user_id"), 16, "0")

    def hdr(n, v):
        return F.struct(F.lit(n).alias("name"), v.alias("value"))
    m = F.col("event_id") % 8
    headers = (F.when(m == 0, F.array(hdr("Traceparent", F.concat(F.lit("00-"), tid, F.lit("-"), sid, F.lit("-01")))))
               .when(m == 1, F.array(hdr("b3", F.concat(tid, F.lit("-"), sid, F.lit("-1")))))
               .when(m == 2, F.array(hdr("X-B3-TraceId", tid), hdr("x-b3-spanid", sid), hdr("X-B3-Sampled", F.lit("0"))))
               .when(m == 3, F.array(hdr("X-Amzn-Trace-Id", F.concat(F.lit("Self=1;Root=1-"), tid, F.lit(";Sampled=1")))))
               .when(m == 4, F.array(hdr("x-request-id", tid), hdr("X-Trace-Id", sid)))
               .when(m == 5, F.array(hdr("traceparent", F.lit("bad")), hdr("b3", F.concat(tid, F.lit("-"), sid))))
               .when(m == 6, F.array(hdr("content-type", F.lit("application/grpc+proto")),
                                     hdr("grpc-status", (F.col("user_id") % 3).cast("string"))))
               .otherwise(F.array(hdr("accept", F.lit("*/*")))))
    path = F.concat(F.lit("/pkg.Svc"), (F.col("user_id") % 3).cast("string"), F.lit("/Method"),
                    (F.col("event_id") % 4).cast("string"))
    return ev.select(F.col("event_id").alias("id"), headers.alias("headers"), path.alias("http_path"),
                     F.floor("value").cast("long").alias("duration_ms"))


@register("extract_trace_context", """
WITH e AS (SELECT event_id AS id, event_id % 8 AS m, lpad(upper(hex(event_id)), 32, '0') AS tid,
                  lpad(upper(hex(user_id)), 16, '0') AS sid FROM events)
SELECT id,
  CASE m WHEN 0 THEN tid WHEN 1 THEN tid WHEN 2 THEN tid WHEN 3 THEN '1-' || tid WHEN 4 THEN sid WHEN 5 THEN tid END AS trace_id,
  CASE m WHEN 0 THEN sid WHEN 1 THEN sid WHEN 2 THEN sid WHEN 5 THEN sid END AS span_id,
  CASE m WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN FALSE WHEN 5 THEN FALSE END AS sampled,
  CASE m WHEN 0 THEN 'traceparent' WHEN 1 THEN 'b3' WHEN 2 THEN 'x-b3-traceid' WHEN 3 THEN 'x-amzn-trace-id'
         WHEN 4 THEN 'x-trace-id' WHEN 5 THEN 'b3' END AS trace_source
FROM e""")
def q_extract_trace_context(spark, sf):
    return SS.extract_trace_context(header_flows(spark, sf)).select(
        "id", "trace_id", "span_id", "sampled", "trace_source")


@register("grpc_calls", """
SELECT 'pkg.Svc' || CAST(user_id % 3 AS VARCHAR) AS service, 'Method' || CAST(event_id % 4 AS VARCHAR) AS method,
  CAST(user_id % 3 AS VARCHAR) AS grpc_status, count(*) AS calls, ROUND(avg(floor(value)), 6) AS avg_latency_ms
FROM events WHERE event_id % 8 = 6 GROUP BY 1, 2, 3""")
def q_grpc_calls(spark, sf):
    return finish(SS.grpc_calls(header_flows(spark, sf)))


def dns_flows(spark, sf):
    """Nested DNS wire flows: queries and responses with 0-3 answers."""
    f = td.flows(spark, sf).filter("protocol = 'DNS'")
    k = F.length("dns_query") - 12
    dns = F.struct(F.col("dns_query").alias("query_name"), F.col("dns_type").alias("query_type"),
                   (F.col("src_port") % 2 == 0).alias("is_response"),
                   F.slice(F.array(F.lit("1.1.1.1"), F.lit("2.2.2.2"), F.lit("3.3.3.3")), 1, k % 4).alias("answers"),
                   F.col("dns_rcode").alias("rcode"))
    return f.select("id", "ts", dns.alias("dns"))


DNS_DUCK = """
, d AS (SELECT id, ts, dns_query AS query_name, dns_type AS query_type, src_port % 2 = 0 AS is_response,
          list_slice(['1.1.1.1', '2.2.2.2', '3.3.3.3'], 1, (length(dns_query) - 12) % 4) AS answers,
          dns_rcode AS rcode FROM flows WHERE protocol = 'DNS')
"""


@register("dns_answers", td.with_ctes(DNS_DUCK + """
SELECT id, ts, query_name, pos, answers[pos + 1] AS answer FROM (
  SELECT *, unnest(range(len(answers))) AS pos FROM d WHERE is_response)""", flows=td.FLOWS_SQL))
def q_dns_answers(spark, sf):
    return SS.dns_answers(dns_flows(spark, sf))


@register("dns_rates", td.with_ctes(DNS_DUCK + """
SELECT query_type, count(*) AS messages, count(*) FILTER (WHERE is_response) AS responses,
  count(*) FILTER (WHERE is_response AND rcode = 3) AS nxdomain,
  count(*) FILTER (WHERE is_response AND rcode = 2) AS servfail,
  ROUND(count(*) FILTER (WHERE is_response AND rcode = 3) * 100.0
        / greatest(count(*) FILTER (WHERE is_response), 1), 6) AS nxdomain_pct
FROM d GROUP BY 1""", flows=td.FLOWS_SQL))
def q_dns_rates(spark, sf):
    return finish(SS.dns_rates(dns_flows(spark, sf)))
