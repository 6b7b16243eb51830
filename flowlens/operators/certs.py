"""Certificate inventory, status classification and TLS audits.

The reference upserts one row per Certificate flow from a goroutine; here the
inventory is a group-by over TLS flows (batch) or a ``foreachBatch`` merge
(stream), keyed ``CN|expiry``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: weak cipher suites (names as the agent reports them; the NULL
# suites have no name and are reported as hex ids)
WEAK_CIPHERS = ["TLS_RSA_WITH_3DES_EDE_CBC_SHA", "TLS_RSA_WITH_RC4_128_SHA",
                "TLS_RSA_WITH_RC4_128_MD5", "0x0002", "0x0001",
                "TLS_RSA_WITH_AES_128_CBC_SHA", "TLS_RSA_WITH_AES_256_CBC_SHA",
                "TLS_RSA_WITH_AES_128_CBC_SHA256", "TLS_RSA_WITH_AES_256_CBC_SHA256",
                "TLS_RSA_WITH_AES_128_GCM_SHA256", "TLS_RSA_WITH_AES_256_GCM_SHA384"]


def extract_certs(flows: DataFrame, ts: str = "ts") -> DataFrame:
    """TLS Certificate flows with a CN -> one inventory row per ``CN|expiry``:
    first/last sighting, attributes of the latest sighting."""
    t = F.col("tls")
    c = flows.filter((t["record_type"] == "Certificate") & (F.coalesce(t["cert_cn"], F.lit("")) != ""))
    c = c.select(F.concat_ws("|", t["cert_cn"], F.coalesce(t["cert_expiry"], F.lit(""))).alias("fingerprint"),
                 t["cert_cn"].alias("cn"), F.coalesce(t["cert_issuer"], F.lit("")).alias("issuer"),
                 F.coalesce(t["cert_expiry"], F.lit("")).alias("expiry"),
                 F.coalesce(t["cert_expired"], F.lit(False)).alias("expired"),
                 F.array_join(F.coalesce(t["cert_sans"], F.array().cast("array<string>")), ",").alias("sans"),
                 "agent_id", "hostname", "src_ip", "dst_ip", F.col(ts).alias("seen"), "id")
    latest = F.struct("seen", "id")
    return c.groupBy("fingerprint").agg(
        *[F.max_by(x, latest).alias(x) for x in ("cn", "issuer", "expiry", "expired", "sans", "agent_id",
                                                  "hostname", "src_ip", "dst_ip")],
        F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"),
        F.count(F.lit(1)).alias("sightings"))


def days_left(expiry: Column, as_of: Column) -> Column:
    """int(hours until expiry-date midnight / 24), truncated toward zero like Go."""
    exp = F.try_to_timestamp(expiry, F.lit("yyyy-MM-dd"))
    hours = (F.unix_micros(exp) - F.unix_micros(as_of)) / F.lit(3_600_000_000.0)
    return F.when(exp.isNotNull(), (hours / 24).cast("int"))


def cert_status(certs: DataFrame, as_of: Column, strict: bool = False,
                critical_days: int = 7, warning_days: int = 30, inclusive: bool = True) -> DataFrame:
    """days_left + status expired/critical/warning/ok (blank expiry: 'unknown',
    or the reference's days_left=0 -> critical when ``strict``).  The desktop
    variant uses strict bounds (``inclusive=False``: < 7, < 30)."""
    d = days_left(F.col("expiry"), as_of)
    d = F.coalesce(d, F.lit(0)) if strict else d
    le = (lambda a, b: a <= b) if inclusive else (lambda a, b: a < b)
    status = (F.when(F.col("expired") | (d < 0), "expired")
              .when(d.isNull(), "unknown")
              .when(le(d, critical_days), "critical")
              .when(le(d, warning_days), "warning").otherwise("ok"))
    return certs.withColumn("days_left", d).withColumn("status", status)


def cert_summary(status_df: DataFrame) -> DataFrame:
    return status_df.agg(F.count(F.lit(1)).alias("total"),
                         *[F.count_if(F.col("status") == s).alias(s) for s in ("expired", "critical", "warning", "ok")])


def tls_audit(certs: DataFrame, as_of: Column) -> DataFrame:
    """Issue per cert: expired / expiring_critical / expiring_soon / self_signed / ok."""
    d = F.coalesce(days_left(F.col("expiry"), as_of), F.lit(0))
    issuer = F.col("issuer")
    self_signed = (F.lower(issuer).contains(F.col("cn")) | (issuer == "") | (issuer == F.col("cn")))
    issue = (F.when(F.col("expired") | (d < 0), "expired").when(d <= 7, "expiring_critical")
             .when(d <= 30, "expiring_soon").when(self_signed, "self_signed").otherwise("ok"))
    return certs.withColumn("days_left", d).withColumn("issue", issue)


def cert_sightings(flows: DataFrame, ts: str = "ts") -> DataFrame:
    """Desktop cert panel: per CN, how often seen, first and last sighting."""
    t = F.col("tls")
    c = flows.filter((t["record_type"] == "Certificate") & (F.coalesce(t["cert_cn"], F.lit("")) != ""))
    return c.groupBy(t["cert_cn"].alias("cn")).agg(
        F.count(F.lit(1)).alias("seen_count"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def weak_cipher_audit(flows: DataFrame) -> DataFrame:
    """Hello flows offering or choosing a weak suite, per SNI (or dst ip) and host."""
    t = F.col("tls")
    weak = F.array(*[F.lit(w) for w in WEAK_CIPHERS])
    offered = F.arrays_overlap(F.coalesce(t["cipher_suites"], F.array().cast("array<string>")), weak)
    chosen = F.array_contains(weak, F.coalesce(t["chosen_cipher"], F.lit("")))
    f = flows.filter(t.isNotNull() & (offered | chosen | F.coalesce(t["has_weak_cipher"], F.lit(False))))
    return f.groupBy(F.coalesce(F.nullif(t["sni"], F.lit("")), F.col("dst_ip")).alias("server"), "hostname").agg(
        F.count(F.lit(1)).alias("flows"), F.count_if(offered).alias("offered_weak"),
        F.count_if(chosen).alias("chose_weak"), F.max("ts").alias("last_seen"))
