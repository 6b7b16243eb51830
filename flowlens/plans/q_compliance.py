"""Registered compliance-report and certificate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.timewin import as_of_col
from flowlens.operators import certs as C
from flowlens.operators import compliance as CP
from flowlens.operators.latest import latest_by_key
from flowlens.operators.ordering import number_rows
from flowlens.plans.catalog import finish, register
from flowlens.plans.q_detect import CUSTOM_RULES, CUSTOM_SCHEMA, MATCHES_DUCK, custom_matches
from flowlens.sources import testdata as td

NOW = "(SELECT max(ts) FROM flows)"
SINCE = f"({NOW} - INTERVAL 1 MONTH)"


def W(body: str, **extra: str) -> str:
    return td.with_ctes(body, flows=td.FLOWS_SQL, **extra)


def inputs(spark, sf, *need: str, schedule: str = "monthly") -> CP.Inputs:
    """Only the tables that the checks at hand read."""
    f = td.flows(spark, sf)
    now = as_of_col(f)
    x = CP.Inputs(flows=f, as_of=now, since=CP.report_window(now, schedule))
    if "agents" in need:
        x.agents = td.agents(spark, sf)
    if "audit" in need:
        x.audit = td.audit_events(spark, sf)
    if "members" in need:
        x.members = td.members(spark, sf)
    if "matches" in need:
        x.matches = custom_matches(spark, sf)
        x.rules = latest_by_key(spark.createDataFrame(CUSTOM_RULES, CUSTOM_SCHEMA), ["id"], "version")
    return x


EXT = "src_ip NOT LIKE '10.%' AND src_ip NOT LIKE '172.16.%' AND src_ip NOT LIKE '192.168.%'"

# DuckDB rules table of the compliance joins (one row per rule id, as above)
RULES_DUCK = """
, rules AS (SELECT * FROM (VALUES ('c-1', 'Long DNS names', '["dns","exfiltration"]'),
   ('c-2', 'Telnet use', '["lateral","telnet"]'), ('c-3', 'Rejected non-select', '[]'),
   ('c-4', 'Disabled', '["portscan"]')) t(id, title, tags)),
mr AS (SELECT r.title AS rule, m.rule_id, r.tags, m.src_ip, m.dst_ip, m.severity, {now} AS fired_at
       FROM matches m JOIN rules r ON r.id = m.rule_id)
""".format(now=NOW)


@register("soc2_cc6_1", W(f"""
SELECT src_ip, dst_ip, dst_port, count(*) AS attempts, max(ts) AS last_seen FROM flows
WHERE ts >= {SINCE} AND dst_port IN (22, 3389, 5432, 6379, 27017) AND {EXT}
GROUP BY 1, 2, 3"""))
def q_soc2_cc6_1(spark, sf):
    return CP.soc2_cc6_1(inputs(spark, sf))


@register("soc2_cc6_7", W(f"""
SELECT dst_ip, dst_port, count(*) AS flow_count, CAST(sum(bytes_out) AS BIGINT) AS total_bytes FROM flows
WHERE ts >= {SINCE} AND protocol = 'HTTP' AND dst_port NOT IN (443, 8443) AND bytes_out > 512
GROUP BY 1, 2"""))
def q_soc2_cc6_7(spark, sf):
    return CP.soc2_cc6_7(inputs(spark, sf))


@register("soc2_cc7_2", W(MATCHES_DUCK + RULES_DUCK + """
SELECT rule, src_ip, dst_ip, severity, fired_at FROM mr"""))
def q_soc2_cc7_2(spark, sf):
    return CP.soc2_cc7_2(inputs(spark, sf, "matches"))


@register("soc2_cc8_1", W(f"""
, a AS (SELECT agent_id, arg_max(hostname, last_seen) AS hostname, arg_max(version, last_seen) AS version,
          min(registered_at) AS registered_at, max(last_seen) AS last_seen FROM agents GROUP BY agent_id)
SELECT *, CASE WHEN last_seen < {NOW} - INTERVAL 1 HOUR THEN 'OFFLINE' ELSE 'ONLINE' END AS status FROM a
WHERE registered_at >= {SINCE} OR last_seen >= {SINCE}""", agents=td.AGENTS_SQL))
def q_soc2_cc8_1(spark, sf):
    return CP.soc2_cc8_1(inputs(spark, sf, "agents"))


@register("soc2_a1_1", W(f"""
SELECT count(DISTINCT agent_id) AS active_agents, count(*) AS total_flows, min(ts) AS first_flow,
  max(ts) AS last_flow FROM flows WHERE ts >= {SINCE}"""))
def q_soc2_a1_1(spark, sf):
    return CP.soc2_a1_1(inputs(spark, sf))


@register("pci_1_3", W(f"""
SELECT src_ip, dst_ip, dst_port, protocol, count(*) AS cnt FROM flows
WHERE ts >= {SINCE} AND {EXT} AND dst_port IN (443, 8443, 3306, 5432, 1433, 6379, 27017)
GROUP BY 1, 2, 3, 4"""))
def q_pci_1_3(spark, sf):
    return CP.pci_1_3(inputs(spark, sf))


@register("pci_2_2", W(f"""
SELECT src_ip, dst_ip, dst_port, protocol, count(*) AS cnt FROM flows
WHERE ts >= {SINCE} AND protocol IN ('TELNET', 'FTP', 'HTTP') AND dst_port IN (21, 23, 80, 8080)
  AND dst_ip NOT LIKE '192.168.%'
GROUP BY 1, 2, 3, 4"""))
def q_pci_2_2(spark, sf):
    return CP.pci_2_2(inputs(spark, sf))


@register("pci_10_2", W(f"""
SELECT method || ' ' || path AS action, count(*) AS event_count, min(ts) AS first, max(ts) AS last
FROM audit WHERE ts >= {SINCE} GROUP BY 1""", audit=td.AUDIT_SQL))
def q_pci_10_2(spark, sf):
    return CP.pci_10_2(inputs(spark, sf, "audit"))


@register("pci_11_4", W(MATCHES_DUCK + RULES_DUCK + """
SELECT rule, src_ip, count(*) AS fires, max(fired_at) AS last_fired FROM mr
WHERE tags LIKE '%portscan%' OR tags LIKE '%lateral%'
GROUP BY 1, 2"""))
def q_pci_11_4(spark, sf):
    return CP.pci_11_4(inputs(spark, sf, "matches"))


@register("hipaa_312_e1", W(f"""
SELECT src_ip, dst_ip, dst_port, count(*) AS cnt, CAST(sum(bytes_out) AS BIGINT) AS bytes FROM flows
WHERE ts >= {SINCE} AND protocol = 'HTTP' AND dst_port NOT IN (443, 8443)
GROUP BY 1, 2, 3"""))
def q_hipaa_312_e1(spark, sf):
    return CP.hipaa_312_e1(inputs(spark, sf))


MEMBERS_ACTIVE = """
, ma AS (SELECT user_id, arg_max(email, version) AS email, arg_max(role, version) AS role,
           arg_max(is_active, version) AS is_active, min(created_at) AS created_at, max(last_seen) AS last_seen
         FROM members GROUP BY user_id)
"""


@register("hipaa_308_a1", W(MEMBERS_ACTIVE + f"""
SELECT email, role, created_at AS joined_at, last_seen FROM ma WHERE is_active AND created_at >= {SINCE}""",
    members=td.MEMBERS_SQL))
def q_hipaa_308_a1(spark, sf):
    return CP.hipaa_308_a1(inputs(spark, sf, "members"))


@register("hipaa_312_a1", W(MEMBERS_ACTIVE + f"""
SELECT email, role, last_seen FROM ma WHERE is_active AND last_seen < {NOW} - INTERVAL 90 DAYS""", members=td.MEMBERS_SQL))
def q_hipaa_312_a1(spark, sf):
    return CP.hipaa_312_a1(inputs(spark, sf, "members"))


@register("compliance_report_soc2", W(MATCHES_DUCK + RULES_DUCK + f"""
, a AS (SELECT agent_id, min(registered_at) AS registered_at, max(last_seen) AS last_seen FROM agents GROUP BY agent_id)
SELECT 'soc2' AS framework, 'CC6.1' AS check_name,
  CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END AS status, n AS row_count
FROM (SELECT count(*) AS n FROM (SELECT src_ip, dst_ip, dst_port FROM flows WHERE ts >= {SINCE}
      AND dst_port IN (22, 3389, 5432, 6379, 27017) AND {EXT} GROUP BY 1, 2, 3))
UNION ALL SELECT 'soc2', 'CC6.7', CASE WHEN n > 0 THEN 'warn' ELSE 'pass' END, n
FROM (SELECT count(*) AS n FROM (SELECT dst_ip, dst_port FROM flows WHERE ts >= {SINCE} AND protocol = 'HTTP'
      AND dst_port NOT IN (443, 8443) AND bytes_out > 512 GROUP BY 1, 2))
UNION ALL SELECT 'soc2', 'CC7.2', 'info', (SELECT count(*) FROM mr)
UNION ALL SELECT 'soc2', 'CC8.1', 'info', (SELECT count(*) FROM a WHERE registered_at >= {SINCE} OR last_seen >= {SINCE})
UNION ALL SELECT 'soc2', 'A1.1', 'info', 1""", agents=td.AGENTS_SQL))
def q_compliance_report_soc2(spark, sf):
    return CP.compliance_report("soc2", inputs(spark, sf, "matches", "agents"))


# evidence counts of the checks, as scalar subqueries
PCI_13 = f"""(SELECT count(*) FROM (SELECT DISTINCT src_ip, dst_ip, dst_port, protocol FROM flows WHERE ts >= {SINCE} AND {EXT}
  AND dst_port IN (443, 8443, 3306, 5432, 1433, 6379, 27017)))"""
PCI_22 = f"""(SELECT count(*) FROM (SELECT DISTINCT src_ip, dst_ip, dst_port, protocol FROM flows WHERE ts >= {SINCE}
  AND protocol IN ('TELNET', 'FTP', 'HTTP') AND dst_port IN (21, 23, 80, 8080) AND dst_ip NOT LIKE '192.168.%'))"""
PCI_102 = f"(SELECT count(DISTINCT method || ' ' || path) FROM audit WHERE ts >= {SINCE})"
PCI_114 = """(SELECT count(*) FROM (SELECT DISTINCT rule, src_ip FROM mr WHERE tags LIKE '%portscan%' OR tags LIKE '%lateral%'))"""
HIPAA_E1 = f"""(SELECT count(*) FROM (SELECT DISTINCT src_ip, dst_ip, dst_port FROM flows WHERE ts >= {SINCE}
  AND protocol = 'HTTP' AND dst_port NOT IN (443, 8443)))"""
HIPAA_B = f"""(SELECT count(*) FROM (SELECT DISTINCT split_part(path, '/', -1) AS action, token_id FROM audit WHERE ts >= {SINCE})
  WHERE action IN ('login', 'logout', 'invite_accepted', 'password_reset'))"""
HIPAA_308 = f"(SELECT count(*) FROM ma WHERE is_active AND created_at >= {SINCE})"
HIPAA_A1 = f"(SELECT count(*) FROM ma WHERE is_active AND last_seen < {NOW} - INTERVAL 90 DAYS)"


@register("hipaa_312_b", W(f"""
SELECT split_part(path, '/', -1) AS action, token_id AS actor, count(*) AS cnt, max(ts) AS last FROM audit
WHERE ts >= {SINCE} AND split_part(path, '/', -1) IN ('login', 'logout', 'invite_accepted', 'password_reset')
GROUP BY 1, 2""", audit=td.AUDIT_SQL))
def q_hipaa_312_b(spark, sf):
    return CP.hipaa_312_b(inputs(spark, sf, "audit"))


@register("compliance_report_pci", W(MATCHES_DUCK + RULES_DUCK + f"""
SELECT 'pci' AS framework, 'Req 1.3' AS check_name, CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END AS status, n AS row_count
FROM (SELECT {PCI_13} AS n)
UNION ALL SELECT 'pci', 'Req 2.2', CASE WHEN n > 0 THEN 'warn' ELSE 'pass' END, n FROM (SELECT {PCI_22} AS n)
UNION ALL SELECT 'pci', 'Req 10.2', 'info', {PCI_102}
UNION ALL SELECT 'pci', 'Req 11.4', 'info', {PCI_114}""", audit=td.AUDIT_SQL))
def q_compliance_report_pci(spark, sf):
    return CP.compliance_report("pci", inputs(spark, sf, "matches", "audit"))


@register("compliance_report_hipaa", W(MEMBERS_ACTIVE + f"""
SELECT 'hipaa' AS framework, '164.312(e)(1)' AS check_name, CASE WHEN n > 0 THEN 'warn' ELSE 'pass' END AS status,
  n AS row_count FROM (SELECT {HIPAA_E1} AS n)
UNION ALL SELECT 'hipaa', '164.312(b)', 'info', {HIPAA_B}
UNION ALL SELECT 'hipaa', '164.308(a)(1)', 'info', {HIPAA_308}
UNION ALL SELECT 'hipaa', '164.312(a)(1)', CASE WHEN n > 0 THEN 'warn' ELSE 'pass' END, n FROM (SELECT {HIPAA_A1} AS n)""",
    audit=td.AUDIT_SQL, members=td.MEMBERS_SQL))
def q_compliance_report_hipaa(spark, sf):
    return CP.compliance_report("hipaa", inputs(spark, sf, "audit", "members"))


def _csv_duck(section: int, name: str, cols: str, rows: str, order: str) -> str:
    """Header, ordered evidence rows and blank line of one check."""
    fields = " || ',' || ".join(
        f"CASE WHEN regexp_matches(COALESCE({c}, ''), '[,\"]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE COALESCE({c}, '') END"
        for c in cols.split(","))
    return f"""SELECT {section} AS section, 0 AS part, 0 AS pos, '{name},{cols}' AS line
UNION ALL SELECT {section}, 2, 0, ''
UNION ALL SELECT {section}, 1, row_number() OVER (ORDER BY {order}), ',' || {fields} FROM ({rows})"""


@register("report_csv_hipaa", W(MEMBERS_ACTIVE + ", lines AS (" + "\nUNION ALL ".join([
    _csv_duck(0, "164.312(e)(1)", "src_ip,dst_ip,dst_port,cnt,bytes", f"""SELECT src_ip, dst_ip, CAST(dst_port AS VARCHAR) AS dst_port,
      CAST(count(*) AS VARCHAR) AS cnt, CAST(CAST(sum(bytes_out) AS BIGINT) AS VARCHAR) AS bytes, sum(bytes_out) AS o, min(dst_port) AS p FROM flows WHERE ts >= {SINCE}
      AND protocol = 'HTTP' AND dst_port NOT IN (443, 8443) GROUP BY src_ip, dst_ip, flows.dst_port""", "o DESC, src_ip, dst_ip, p"),
    _csv_duck(1, "164.312(b)", "action,actor,cnt,last", f"""SELECT split_part(path, '/', -1) AS action, token_id AS actor,
      CAST(count(*) AS VARCHAR) AS cnt, CAST(max(ts) AS VARCHAR) AS last, count(*) AS o FROM audit WHERE ts >= {SINCE}
      AND split_part(path, '/', -1) IN ('login', 'logout', 'invite_accepted', 'password_reset') GROUP BY 1, 2""", "o DESC, action, actor"),
    _csv_duck(2, "164.308(a)(1)", "email,role,joined_at,last_seen", f"""SELECT email, role, CAST(created_at AS VARCHAR) AS joined_at,
      CAST(last_seen AS VARCHAR) AS last_seen FROM ma WHERE is_active AND created_at >= {SINCE}""", "joined_at DESC, email"),
    _csv_duck(3, "164.312(a)(1)", "email,role,last_seen", f"""SELECT email, role, CAST(last_seen AS VARCHAR) AS last_seen
      FROM ma WHERE is_active AND last_seen < {NOW} - INTERVAL 90 DAYS""", "last_seen, email")]) + """)
SELECT CAST(row_number() OVER (ORDER BY section, part, pos) AS BIGINT) AS n, line FROM lines""",
    audit=td.AUDIT_SQL, members=td.MEMBERS_SQL))
def q_report_csv_hipaa(spark, sf):
    """The printed report: lines numbered in their global order by a range-partitioned count."""
    lines = CP.report_csv_lines("hipaa", inputs(spark, sf, "audit", "members"))
    keys = ["section", "part", *[F.col("order_key")[i] for i in range(5)]]
    return number_rows(lines, [F.col(k) if isinstance(k, str) else k for k in keys], "n").select("n", "line")


@register("report_windows", W(f"""
SELECT s AS schedule, CASE s WHEN 'daily' THEN {NOW} - INTERVAL 1 DAY WHEN 'weekly' THEN {NOW} - INTERVAL 7 DAY
  WHEN 'monthly' THEN {NOW} - INTERVAL 1 MONTH ELSE {NOW} - INTERVAL 30 DAY END AS evidence_from,
  (SELECT count(*) FROM flows WHERE ts >= CASE s WHEN 'daily' THEN {NOW} - INTERVAL 1 DAY WHEN 'weekly' THEN {NOW} - INTERVAL 7 DAY
    WHEN 'monthly' THEN {NOW} - INTERVAL 1 MONTH ELSE {NOW} - INTERVAL 30 DAY END) AS flows
FROM (VALUES ('daily'), ('weekly'), ('monthly'), ('quarterly')) t(s)"""))
def q_report_windows(spark, sf):
    f = td.flows(spark, sf)
    now = as_of_col(f)
    names = ("daily", "weekly", "monthly", "quarterly")
    counts = f.agg(*[F.count_if(F.col("ts") >= CP.report_window(now, n)).alias(n) for n in names])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("schedule"), CP.report_window(now, n).alias("evidence_from"),
                                                      F.col(n).alias("flows")) for n in names])).alias("r")).select("r.*")


# ---- certificates ---------------------------------------------------------------

CERT_FLOWS_DUCK = """
, cf AS (SELECT 'cert-' || CAST(seen_seq AS VARCHAR) AS id, agent_id,
           'host-' || CAST(seen_seq % 8 AS VARCHAR) AS hostname, src_ip, dst_ip, seen_at AS ts,
           cn, issuer, expiry, expired, sans FROM certs),
inv AS (SELECT cn || '|' || expiry AS fingerprint, arg_max(cn, (ts, id)) AS cn, arg_max(issuer, (ts, id)) AS issuer,
          arg_max(expiry, (ts, id)) AS expiry, arg_max(expired, (ts, id)) AS expired, arg_max(sans, (ts, id)) AS sans,
          arg_max(agent_id, (ts, id)) AS agent_id, arg_max(hostname, (ts, id)) AS hostname,
          arg_max(src_ip, (ts, id)) AS src_ip, arg_max(dst_ip, (ts, id)) AS dst_ip,
          min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS sightings
        FROM cf GROUP BY 1),
st AS (SELECT *, CAST(trunc((epoch_us(CAST(expiry AS TIMESTAMP)) - epoch_us({now})) / 3600000000.0 / 24) AS INTEGER)
          AS days_left FROM inv)
""".format(now=NOW)


def cert_flows(spark, sf):
    """Nested TLS Certificate flows built from the cert fixture rows."""
    c = td.tls_certs(spark, sf)
    tls = F.struct(F.lit("Certificate").alias("record_type"), F.col("cn").alias("cert_cn"),
                   F.col("issuer").alias("cert_issuer"), F.col("expiry").alias("cert_expiry"),
                   F.col("expired").alias("cert_expired"), F.split("sans", ",").alias("cert_sans"),
                   F.lit(None).cast("array<string>").alias("cipher_suites"),
                   F.lit(None).cast("string").alias("chosen_cipher"), F.lit(None).cast("string").alias("sni"),
                   F.lit(False).alias("has_weak_cipher"))
    return c.select(F.concat(F.lit("cert-"), F.col("seen_seq").cast("string")).alias("id"), "agent_id",
                    F.concat(F.lit("host-"), (F.col("seen_seq") % 8).cast("string")).alias("hostname"),
                    "src_ip", "dst_ip", F.col("seen_at").alias("ts"), tls.alias("tls"))


@register("extract_certs", W(CERT_FLOWS_DUCK + "SELECT * EXCLUDE (days_left) FROM st", certs=td.TLS_CERTS_SQL))
def q_extract_certs(spark, sf):
    return C.extract_certs(cert_flows(spark, sf))


@register("cert_status", W(CERT_FLOWS_DUCK + """
SELECT fingerprint, days_left, CASE WHEN expired OR days_left < 0 THEN 'expired' WHEN days_left IS NULL THEN 'unknown'
  WHEN days_left <= 7 THEN 'critical' WHEN days_left <= 30 THEN 'warning' ELSE 'ok' END AS status FROM st""",
    certs=td.TLS_CERTS_SQL))
def q_cert_status(spark, sf):
    now = as_of_col(td.flows(spark, sf))
    return C.cert_status(C.extract_certs(cert_flows(spark, sf)), now).select("fingerprint", "days_left", "status")


@register("cert_summary", W(CERT_FLOWS_DUCK + """
, s AS (SELECT CASE WHEN expired OR days_left < 0 THEN 'expired' WHEN days_left <= 7 THEN 'critical'
                    WHEN days_left <= 30 THEN 'warning' ELSE 'ok' END AS status FROM st)
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'expired') AS expired,
  count(*) FILTER (WHERE status = 'critical') AS critical, count(*) FILTER (WHERE status = 'warning') AS warning,
  count(*) FILTER (WHERE status = 'ok') AS ok FROM s""", certs=td.TLS_CERTS_SQL))
def q_cert_summary(spark, sf):
    now = as_of_col(td.flows(spark, sf))
    return C.cert_summary(C.cert_status(C.extract_certs(cert_flows(spark, sf)), now))


@register("tls_audit", W(CERT_FLOWS_DUCK + """
SELECT fingerprint, COALESCE(days_left, 0) AS days_left,
  CASE WHEN expired OR COALESCE(days_left, 0) < 0 THEN 'expired' WHEN COALESCE(days_left, 0) <= 7 THEN 'expiring_critical'
       WHEN COALESCE(days_left, 0) <= 30 THEN 'expiring_soon'
       WHEN contains(lower(issuer), cn) OR issuer = '' OR issuer = cn THEN 'self_signed' ELSE 'ok' END AS issue
FROM st""", certs=td.TLS_CERTS_SQL))
def q_tls_audit(spark, sf):
    now = as_of_col(td.flows(spark, sf))
    return C.tls_audit(C.extract_certs(cert_flows(spark, sf)), now).select("fingerprint", "days_left", "issue")


@register("cert_sightings", W(CERT_FLOWS_DUCK + """
SELECT cn, count(*) AS seen_count, min(ts) AS first_seen, max(ts) AS last_seen FROM cf GROUP BY cn""",
    certs=td.TLS_CERTS_SQL))
def q_cert_sightings(spark, sf):
    return C.cert_sightings(cert_flows(spark, sf))


# ---- weak ciphers and rule seeding --------------------------------------------------

def hello_flows(spark, sf):
    """TLS ClientHello / ServerHello flows: offered suite lists and chosen suites
    drawn from strong and weak names by event id."""
    ev = td.read_table(spark, sf, "events")
    strong = F.lit("TLS_AES_128_GCM_SHA256")
    weak = F.element_at(F.array(*[F.lit(w) for w in C.WEAK_CIPHERS]), (F.col("event_id") % 11 + 1).cast("int"))
    offered = F.when(F.col("event_id") % 3 == 0, F.array(strong, weak)).otherwise(F.array(strong))
    chosen = F.when(F.col("event_id") % 5 == 0, weak).otherwise(strong)
    client = F.col("event_id") % 2 == 0
    tls = F.struct(F.when(client, "ClientHello").otherwise("ServerHello").alias("record_type"),
                   F.when(client, F.concat(F.lit("svc"), (F.col("user_id") % 9).cast("string"), F.lit(".example.com")))
                   .alias("sni"),
                   F.when(client, offered).alias("cipher_suites"), F.when(~client, chosen).alias("chosen_cipher"),
                   F.lit(False).alias("has_weak_cipher"))
    return ev.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"),
                     F.concat(F.lit("198.51.100."), (F.col("user_id") % 50).cast("string")).alias("dst_ip"),
                     F.concat(F.lit("host-"), (F.col("user_id") % 8).cast("string")).alias("hostname"), tls.alias("tls"))


WEAK_LIST = ", ".join(f"'{w}'" for w in C.WEAK_CIPHERS)


@register("weak_cipher_audit", f"""
WITH h AS (SELECT event_id % 2 = 0 AS client, CAST(ts AS TIMESTAMP) AS ts,
             'svc' || CAST(user_id % 9 AS VARCHAR) || '.example.com' AS sni,
             '198.51.100.' || CAST(user_id % 50 AS VARCHAR) AS dst_ip, 'host-' || CAST(user_id % 8 AS VARCHAR) AS hostname,
             event_id % 3 = 0 AS offers_weak, event_id % 5 = 0 AS chooses_weak FROM events),
w AS (SELECT CASE WHEN client THEN sni ELSE dst_ip END AS server, hostname, ts,
        client AND offers_weak AS offered, NOT client AND chooses_weak AS chosen FROM h)
SELECT server, hostname, count(*) AS flows, count(*) FILTER (WHERE offered) AS offered_weak,
  count(*) FILTER (WHERE chosen) AS chose_weak, max(ts) AS last_seen
FROM w WHERE offered OR chosen GROUP BY 1, 2""")
def q_weak_cipher_audit(spark, sf):
    return C.weak_cipher_audit(hello_flows(spark, sf))


# fixed config: built-in detection rules (id, title, severity, tags) seeded when absent
BUILTIN_RULES = [("builtin-001", "Port Scan Detection", "high", '["recon","portscan"]'),
                 ("builtin-002", "DNS Tunneling Indicator", "medium", '["dns","exfiltration"]'),
                 ("builtin-003", "Cleartext Credential Submission", "high", '["credentials","http"]'),
                 ("builtin-004", "Unexpected Outbound High Port", "medium", '["c2","beaconing"]'),
                 ("builtin-005", "Privileged Process Network Activity", "critical", '["process","shell"]')]


@register("seed_if_absent", """
WITH existing AS (SELECT CASE WHEN r_regionkey = 0 THEN 'builtin-002' ELSE 'custom-' || CAST(r_regionkey AS VARCHAR) END AS id,
                    r_name AS title FROM region),
b AS (SELECT * FROM (VALUES ('builtin-001', 'Port Scan Detection'), ('builtin-002', 'DNS Tunneling Indicator'),
        ('builtin-003', 'Cleartext Credential Submission'), ('builtin-004', 'Unexpected Outbound High Port'),
        ('builtin-005', 'Privileged Process Network Activity')) t(id, title))
SELECT id, title FROM existing UNION ALL SELECT id, title FROM b WHERE id NOT IN (SELECT id FROM existing)""")
def q_seed_if_absent(spark, sf):
    from flowlens.operators.latest import seed_if_absent
    region = td.read_table(spark, sf, "region")
    existing = region.select(F.when(F.col("r_regionkey") == 0, F.lit("builtin-002"))
                             .otherwise(F.concat(F.lit("custom-"), F.col("r_regionkey").cast("string"))).alias("id"),
                             F.col("r_name").alias("title"))
    builtins = spark.createDataFrame(BUILTIN_RULES, "id string, title string, severity string, tags string")
    return seed_if_absent(existing, builtins.select("id", "title"))
