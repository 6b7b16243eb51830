"""Geo and threat enrichment of flows (joins with network tables, IPv4 and IPv6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.ip import SCORER_PRIVATE, in_networks, with_cidr
from flowlens.operators.rangejoin import lookup, network_table

# fixed values: built-in blocklist of the hub scorer
HUB_BUILTIN_BLOCKLIST = ["185.220.100.0/24", "185.220.101.0/24", "185.220.102.0/24",
                         "198.96.155.0/24", "91.108.4.0/22"]
# fixed values: hub port heuristics (points, reason)
HUB_PORT_RULES = [([4444, 4445, 1234, 31337], 50, "suspicious_port_c2"),
                  ([9001, 9030, 9150], 40, "tor_port"),
                  ([6667, 6697, 6660], 20, "irc_port"),
                  ([23, 2323], 15, "telnet_port")]
# fixed values: desktop scorer blocklist and ports
DESKTOP_BUILTIN_BLOCKLIST = ["185.220.0.0/15", "199.87.154.0/24", "5.188.206.0/24",
                             "45.142.212.0/24", "194.165.16.0/24", "80.82.77.0/24",
                             "198.20.69.0/24", "89.248.167.0/24", "91.92.109.0/24"]
DESKTOP_C2_PORTS = [4444, 1337, 31337, 6666, 6667, 4899, 8888, 9999, 50050]
DESKTOP_TOR_PORTS = [9001, 9030, 9150]
DESKTOP_TELNET_PORT = 23


def blocklist_from_lines(lines: DataFrame, col: str = "value", order_col: str | None = None) -> DataFrame:
    """Text lines -> (net, ord): one CIDR or address per line (IPv4 or IPv6), '#'
    comments and unparsable lines skipped.  ``ord`` decides between overlapping
    entries: the given list position, else the most specific network first."""
    t = lines.select(F.trim(F.col(col)).alias("net"), *([F.col(order_col)] if order_col else []))
    t = t.filter((F.col("net") != "") & ~F.col("net").startswith("#"))
    t = with_cidr(t, "net", "_net_").filter(F.col("_net_bits").isNotNull())
    return t.select("net", (F.col(order_col) if order_col else -F.col("_net_bits")).cast("bigint").alias("ord"))


def load_blocklist(spark: SparkSession, path: str) -> DataFrame:
    return blocklist_from_lines(spark.read.text(path))


def builtin_blocklist(spark: SparkSession, nets: list[str] = HUB_BUILTIN_BLOCKLIST) -> DataFrame:
    df = spark.createDataFrame([(n, i) for i, n in enumerate(nets)], "value string, i long")
    return blocklist_from_lines(df, order_col="i")


def _level(score: Column, high: int, medium: int, low: int) -> Column:
    return (F.when(score >= high, "high").when(score >= medium, "medium")
            .when(score >= low, "low").otherwise("clean"))


def enrich_threat(flows: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Hub scorer on the destination: blocklist hit (public valid IPs only) +75,
    port heuristics, cap 100, level, reasons.  Port points apply to any address."""
    table = network_table(blocklist, priority=F.col("ord"), payload=["net"])
    j = lookup(flows, ["dst_ip"], table, prefix="_bl_")
    private = F.coalesce(in_networks("dst_ip", SCORER_PRIVATE), F.lit(False))
    hit = F.col("_bl_dst_ip_net").isNotNull() & ~private
    pts = F.lit(0)
    reason = F.lit(None).cast("string")
    for ports, p, why in reversed(HUB_PORT_RULES):
        pts = F.when(F.col("dst_port").isin(ports), F.lit(p)).otherwise(pts)
        reason = F.when(F.col("dst_port").isin(ports), F.lit(why)).otherwise(reason)
    score = F.least(F.when(hit, 75).otherwise(0) + pts, F.lit(100))
    return (j.withColumn("threat_score", score.cast("int"))
             .withColumn("threat_level", _level(F.col("threat_score"), 75, 50, 20))
             .withColumn("threat_reasons", F.array_compact(F.array(
                 F.when(hit, F.lit("blocklist_hit")), reason)))
             .drop("_bl_dst_ip_net"))


def enrich_threat_bidirectional(flows: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Desktop scorer: src and dst each +75 on a blocklist hit (no private
    exemption), C2 port +40 / Tor +25 / telnet +20, cap 100; no indicator -> null."""
    table = network_table(blocklist, priority=F.col("ord"), payload=["net"])
    j = lookup(flows, ["src_ip", "dst_ip"], table, prefix="_bl_").withColumnsRenamed(
        {"_bl_src_ip_net": "_s_net", "_bl_dst_ip_net": "_d_net"})
    port = F.col("dst_port")
    pts = (F.when(port.isin(DESKTOP_C2_PORTS), 40).when(port.isin(DESKTOP_TOR_PORTS), 25)
           .when(port == DESKTOP_TELNET_PORT, 20).otherwise(0))
    preason = (F.when(port.isin(DESKTOP_C2_PORTS), F.format_string("Known C2/RAT port (%d)", port))
               .when(port.isin(DESKTOP_TOR_PORTS), F.format_string("Tor relay port (%d)", port))
               .when(port == DESKTOP_TELNET_PORT, F.lit("Cleartext Telnet (port 23)")))
    raw = (F.when(F.col("_s_net").isNotNull(), 75).otherwise(0)
           + F.when(F.col("_d_net").isNotNull(), 75).otherwise(0) + pts)
    score = F.when(raw > 0, F.least(raw, F.lit(100)))
    return (j.withColumn("desk_threat_score", score.cast("int"))
             .withColumn("desk_threat_level", F.when(score.isNotNull(), _level(score, 70, 40, 20)))
             .withColumn("desk_threat_reasons", F.when(score.isNotNull(), F.array_compact(F.array(
                 F.when(F.col("_s_net").isNotNull(),
                        F.format_string("Source IP in threat blocklist (%s)", F.col("_s_net"))),
                 F.when(F.col("_d_net").isNotNull(),
                        F.format_string("Destination IP in threat blocklist (%s)", F.col("_d_net"))),
                 preason))))
             .drop("_s_net", "_d_net"))


# fixed values: sample geo ranges for tests (network, country code, name, AS organisation)
SAMPLE_GEO = [("185.220.100.0/22", "DE", "Germany", "Tor Exit Relays"),
              ("185.0.0.0/8", "EU", "Europe", "RIPE Block"),
              ("8.8.8.0/24", "US", "United States", "GOOGLE"),
              ("91.108.4.0/22", "NL", "Netherlands", "Telegram Messenger"),
              ("172.200.0.0/16", "US", "United States", "Example Net"),
              ("203.0.113.0/24", "ZZ", "Documentation", "TEST-NET-3")]


def geo_ranges(spark: SparkSession, rows=SAMPLE_GEO) -> DataFrame:
    """(net, country_code, country_name, as_org)."""
    return spark.createDataFrame(rows, "net string, country_code string, country_name string, as_org string")


GEO_COLUMNS = ["country_code", "country_name", "as_org"]


def enrich_geo(flows: DataFrame, ranges: DataFrame) -> DataFrame:
    """Destination geo: public valid address -> most specific network that holds it; a
    found non-blank country overwrites code, name and AS org; otherwise unchanged."""
    j = lookup(flows, ["dst_ip"], network_table(ranges, payload=GEO_COLUMNS), prefix="_g_")
    private = F.coalesce(in_networks("dst_ip", SCORER_PRIVATE), F.lit(False))
    found = (F.coalesce(F.col("_g_dst_ip_country_code"), F.lit("")) != "") & ~private
    out = j
    for c in GEO_COLUMNS:
        out = out.withColumn(c, F.when(found, F.col(f"_g_dst_ip_{c}")).otherwise(F.col(c)))
    return out.drop(*[f"_g_dst_ip_{c}" for c in GEO_COLUMNS])


def derived_columns(flows: DataFrame, online_seconds: int = 120) -> DataFrame:
    """SDK convenience columns: total_bytes and is_threat (high|medium)."""
    return (flows.withColumn("total_bytes", F.col("bytes_in") + F.col("bytes_out"))
                 .withColumn("is_threat", F.col("threat_level").isin("high", "medium")))


def is_online(last_seen: Column, as_of: Column, seconds: int = 120) -> Column:
    """Agent online when seen within ``seconds`` of ``as_of``; never seen -> False."""
    return F.coalesce(last_seen > as_of - F.expr(f"INTERVAL {seconds} SECONDS"), F.lit(False))

