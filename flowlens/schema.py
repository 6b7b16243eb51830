"""Explicit schemas: flat ``flows`` table and the nested JSON wire record.

Schemas are declared, never inferred, so that reading 100 TB of JSON does not
trigger a sampling pass and so that additive schema evolution is explicit
(``conform_flows`` adds missing columns with their defaults).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, I, L, D, B, TS = (T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(),
                     T.BooleanType(), T.TimestampType())

# Flat flow table, in storage order, with the default for a missing value.
FLOW_COLUMNS: list[tuple[str, T.DataType, object]] = [
    ("id", S, ""), ("agent_id", S, ""), ("hostname", S, ""), ("ts", TS, None),
    ("protocol", S, ""), ("src_ip", S, ""), ("src_port", I, 0), ("dst_ip", S, ""),
    ("dst_port", I, 0), ("bytes_in", L, 0), ("bytes_out", L, 0), ("duration_ms", L, 0),
    ("info", S, ""), ("http_method", S, ""), ("http_path", S, ""), ("http_status", I, 0),
    ("dns_query", S, ""), ("dns_type", S, ""), ("dns_rcode", I, -1),
    ("country_code", S, ""), ("country_name", S, ""), ("as_org", S, ""),
    ("threat_score", I, 0), ("threat_level", S, ""), ("process_name", S, ""),
    ("pid", L, 0), ("pod_name", S, ""), ("k8s_namespace", S, ""), ("trace_id", S, ""),
    ("source", S, "agent"),
]
FLOW_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t, _ in FLOW_COLUMNS])
FLOW_NAMES = [n for n, _, _ in FLOW_COLUMNS]

HTTP = T.StructType([T.StructField("method", S), T.StructField("path", S),
                     T.StructField("status", I), T.StructField("latency_ms", L),
                     T.StructField("headers", T.ArrayType(T.StructType(
                         [T.StructField("name", S), T.StructField("value", S)])))])
DNS = T.StructType([T.StructField("query_name", S), T.StructField("query_type", S),
                    T.StructField("is_response", B),
                    T.StructField("answers", T.ArrayType(S)), T.StructField("rcode", I)])
TLS = T.StructType([T.StructField(n, t) for n, t in [
    ("record_type", S), ("version", S), ("sni", S), ("cipher_suites", T.ArrayType(S)),
    ("has_weak_cipher", B), ("chosen_cipher", S), ("negotiated_version", S),
    ("cert_cn", S), ("cert_sans", T.ArrayType(S)), ("cert_expiry", S),
    ("cert_expired", B), ("cert_issuer", S), ("alert_level", S),
    ("alert_description", S)]])
ICMP = T.StructType([T.StructField(n, t) for n, t in [
    ("icmp_type", I), ("icmp_code", I), ("type_str", S), ("echo_id", I),
    ("echo_seq", I), ("rtt_ms", D)]])
ARP = T.StructType([T.StructField(n, S) for n in
                    ["operation", "sender_ip", "sender_mac", "target_ip", "target_mac"]])
TCP_STATS = T.StructType([T.StructField("retransmissions", L),
                          T.StructField("out_of_order", L)])

FLOW_JSON_SCHEMA = T.StructType([T.StructField(n, t) for n, t in [
    ("id", S), ("agent_id", S), ("hostname", S), ("timestamp", S), ("protocol", S),
    ("src_ip", S), ("src_port", I), ("dst_ip", S), ("dst_port", I),
    ("bytes_in", L), ("bytes_out", L), ("duration_ms", L), ("info", S),
    ("http", HTTP), ("dns", DNS), ("tls", TLS), ("icmp", ICMP), ("arp", ARP),
    ("tcp_stats", TCP_STATS), ("process_name", S), ("pid", L), ("pod_name", S),
    ("k8s_namespace", S), ("country_code", S), ("country_name", S), ("as_org", S),
    ("threat_score", I), ("threat_level", S), ("trace_id", S), ("source", S)]])

INGEST_ENVELOPE_SCHEMA = T.StructType([
    T.StructField("agent_id", S), T.StructField("hostname", S),
    T.StructField("flows", T.ArrayType(FLOW_JSON_SCHEMA))])


def default_of(name: str) -> Column:
    for n, t, d in FLOW_COLUMNS:
        if n == name:
            return F.lit(d).cast(t)
    raise KeyError(name)


def conform_flows(df: DataFrame) -> DataFrame:
    """Project any flow-shaped frame onto FLOW_SCHEMA (missing → default, nulls → default).

    Used after unions of agent/cloud sources and for additively evolved
    Parquet (``mergeSchema``).  A pure projection: no shuffle.
    """
    have = set(df.columns)
    cols = []
    for n, t, d in FLOW_COLUMNS:
        if n in have:
            c = F.col(n).cast(t)
            cols.append((F.coalesce(c, F.lit(d).cast(t)) if d is not None else c).alias(n))
        else:
            cols.append(F.lit(d).cast(t).alias(n))
    return df.select(*cols)
