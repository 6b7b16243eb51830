"""Derive the flow-analytics tables from the driver's TPC-H-ish test tables.

Each derivation is one SQL text with ``{table}`` placeholders: Spark runs it
with DataFrame arguments (``spark.sql(text, events=df)``), the DuckDB oracle
runs the same text against its registered views.  Keeping one text for both
engines means a mismatch in an oracle check is always the operator's fault,
never the fixture's.  All derivations are projections/filters of the base
tables, so their size grows with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()



def _quad(n: str) -> str:
    """The dotted form of a 32-bit number."""
    parts = [f"CAST(CAST(({n} - {n} % {256 ** i}) / {256 ** i} AS BIGINT) % 256 AS STRING)" for i in (3, 2, 1, 0)]
    return "CONCAT(" + ", '.', ".join(parts) + ")"


# flows from and to many addresses, an eighth of the destinations IPv6: one a line item
MANY_ADDRESSES_SQL = f"""
SELECT id, CASE WHEN y % 16 = 3 THEN 'unknown' ELSE {_quad('y')} END AS src_ip,
  CASE WHEN x % 8 = 0 THEN CONCAT('2001:db8:', CAST(x % 10000 AS STRING), '::', CAST(x % 7 AS STRING)) ELSE {_quad('x')} END AS dst_ip,
  CAST(CASE WHEN x % 32 = 1 THEN 23 WHEN x % 32 = 2 THEN 9001 ELSE x % 65536 END AS INT) AS dst_port
FROM (SELECT l_orderkey * 8 + l_linenumber AS id, (l_orderkey * 2654435761 + l_linenumber * 40503) % 4294967296 AS x,
        (CAST(l_partkey AS BIGINT) * 2246822519) % 4294967296 AS y FROM {{lineitem}}) t
"""

# a threat list as stored text, one line an order, in order of `ord`: networks of /12 to /28 that overlap and repeat,
# IPv6 /48, comments, lines that are no network
LONG_BLOCKLIST_SQL = f"""
SELECT ord, CASE WHEN ord % 50 = 0 THEN CONCAT('# list of order ', CAST(ord AS STRING)) WHEN ord % 50 = 1 THEN 'host.example'
  WHEN ord % 50 < 6 THEN CONCAT('2001:db8:', CAST((ord * 7) % 10000 AS STRING), '::/48')
  ELSE CONCAT({_quad('(z - z % size)')}, '/', CAST(bits AS STRING)) END AS value
FROM (SELECT ord, z, bits, CAST(POWER(2, 32 - bits) AS BIGINT) AS size
      FROM (SELECT CAST(o_orderkey AS BIGINT) AS ord, (CAST(o_orderkey AS BIGINT) * 3266489917) % 4294967296 AS z,
              CAST(12 + (o_orderkey * 5) % 17 AS INT) AS bits FROM {{orders}}) a) b
"""

# flows: one flow per event (see FIXTURES.md).  Columns the derivation does not
# know get the flat-table defaults; threat/geo names come from enrichment.
FLOWS_SQL = """
SELECT
  CONCAT('00000000-0000-0000-0000-', LPAD(CAST(event_id AS STRING), 12, '0')) AS id,
  CONCAT('agent-', CAST(user_id % 8 AS STRING)) AS agent_id,
  CONCAT('host-', CAST(user_id % 8 AS STRING)) AS hostname,
  CAST(ts AS TIMESTAMP) AS ts,
  CASE event_type WHEN 'view' THEN 'HTTP' WHEN 'click' THEN 'HTTPS' WHEN 'purchase' THEN 'TCP'
                  WHEN 'signup' THEN 'DNS' ELSE CASE WHEN k % 3 = 0 THEN 'TLS' ELSE 'HTTP' END END AS protocol,
  CASE WHEN user_id % 10 = 0 THEN CONCAT('203.0.113.', CAST(user_id % 256 AS STRING))
       ELSE CONCAT('10.0.', CAST(user_id % 8 AS STRING), '.', CAST(user_id % 256 AS STRING)) END AS src_ip,
  CAST(1024 + event_id % 60000 AS INT) AS src_port,
  CASE k % 7 WHEN 0 THEN CONCAT('185.220.101.', CAST(k AS STRING)) WHEN 1 THEN CONCAT('10.1.0.', CAST(k AS STRING))
             WHEN 2 THEN CONCAT('192.168.1.', CAST(k AS STRING)) WHEN 3 THEN CONCAT('172.16.9.', CAST(k AS STRING))
             WHEN 4 THEN CONCAT('8.8.8.', CAST(k AS STRING)) WHEN 5 THEN CONCAT('91.108.5.', CAST(k AS STRING))
             ELSE CONCAT('172.200.1.', CAST(k AS STRING)) END AS dst_ip,
  CAST(CASE k % 11 WHEN 0 THEN 22 WHEN 1 THEN 80 WHEN 2 THEN 443 WHEN 3 THEN 8080 WHEN 4 THEN 53 WHEN 5 THEN 4444
             WHEN 6 THEN 9001 WHEN 7 THEN 23 WHEN 8 THEN 6667 WHEN 9 THEN 5432 ELSE 49152 + k END AS INT) AS dst_port,
  CAST(FLOOR(value * 10) AS BIGINT) AS bytes_in,
  CAST(FLOOR(value * 100) AS BIGINT) AS bytes_out,
  CAST(FLOOR(value) AS BIGINT) AS duration_ms,
  '' AS info,
  CASE WHEN event_type IN ('view','click','error') THEN CASE WHEN k % 4 = 0 THEN 'POST' ELSE 'GET' END ELSE '' END AS http_method,
  CASE WHEN event_type IN ('view','click','error') THEN CASE k % 5 WHEN 0 THEN '/login' WHEN 1 THEN '/api/items'
       WHEN 2 THEN '/auth/token' WHEN 3 THEN '/' ELSE CONCAT('/p/', CAST(k % 10 AS STRING)) END ELSE '' END AS http_path,
  CAST(CASE event_type WHEN 'error' THEN 500 + k % 4 WHEN 'view' THEN 200 + (k % 3) * 100 WHEN 'click' THEN 200 ELSE 0 END AS INT) AS http_status,
  CASE WHEN event_type = 'signup' THEN CONCAT(REPEAT('x', CAST(k AS INT)), '.example.com') ELSE '' END AS dns_query,
  CASE WHEN event_type = 'signup' THEN CASE k % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'AAAA' ELSE 'TXT' END ELSE '' END AS dns_type,
  CAST(CASE WHEN event_type = 'signup' AND k % 6 = 0 THEN 3 WHEN event_type = 'signup' THEN 0 ELSE -1 END AS INT) AS dns_rcode,
  CASE k % 7 WHEN 0 THEN 'DE' WHEN 4 THEN 'US' WHEN 5 THEN 'NL' WHEN 6 THEN 'US' ELSE '' END AS country_code,
  '' AS country_name,
  '' AS as_org,
  CAST(0 AS INT) AS threat_score,
  '' AS threat_level,
  CASE k % 6 WHEN 0 THEN 'bash' WHEN 1 THEN 'nginx' WHEN 2 THEN 'python3' WHEN 3 THEN 'curl' WHEN 4 THEN 'sshd' ELSE '' END AS process_name,
  CAST(100 + user_id AS BIGINT) AS pid,
  '' AS pod_name,
  '' AS k8s_namespace,
  '' AS trace_id,
  'agent' AS source
FROM (SELECT *, CAST(REGEXP_EXTRACT(props, '([0-9]+)', 1) AS BIGINT) AS k FROM {events}) e
"""

# agents version log: every signup event is one upsert; every 4th carries a
# blank version (the flow-driven upsert of the reference writes blanks).
AGENTS_SQL = """
SELECT CONCAT('agent-', CAST(user_id % 8 AS STRING)) AS agent_id,
  CASE WHEN event_id % 5 = 0 THEN CONCAT('10.0.', CAST(user_id % 8 AS STRING), '.', CAST(user_id % 8 AS STRING))
       ELSE CONCAT('host-', CAST(user_id % 8 AS STRING)) END AS hostname,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE CONCAT('v0.', CAST(event_id % 3 AS STRING)) END AS version,
  CASE WHEN event_id % 4 = 0 THEN '' WHEN user_id % 2 = 0 THEN 'linux' ELSE 'darwin' END AS os,
  CASE user_id % 8 WHEN 0 THEN 'prod-eu' WHEN 1 THEN 'prod-eu' WHEN 2 THEN 'staging' ELSE '' END AS cluster,
  CASE WHEN user_id % 3 = 0 THEN 'ebpf' ELSE 'pcap' END AS capture_mode,
  (user_id % 3 = 0) AS ebpf_enabled,
  CAST(ts AS TIMESTAMP) AS last_seen,
  CAST(ts AS TIMESTAMP) AS registered_at,
  event_id AS version_seq
FROM {events} WHERE event_type = 'signup'
"""

TLS_CERTS_SQL = """
SELECT CONCAT('svc-', CAST(p_partkey % 150 AS STRING), '.example.com') AS cn,
  CASE WHEN p_size % 10 = 0 THEN '' ELSE p_brand END AS issuer,
  CAST(CAST(TIMESTAMP '2024-01-30 00:00:00' + CAST(p_size - 10 AS INT) * INTERVAL '1' DAY AS DATE) AS STRING) AS expiry,
  (p_size % 13 = 0) AS expired,
  CONCAT('svc-', CAST(p_partkey % 150 AS STRING), '.example.com,alt-', CAST(p_partkey % 7 AS STRING), '.example.com') AS sans,
  CONCAT('agent-', CAST(p_partkey % 8 AS STRING)) AS agent_id,
  CONCAT('10.0.', CAST(p_partkey % 8 AS STRING), '.1') AS src_ip,
  CONCAT('198.51.100.', CAST(p_partkey % 200 AS STRING)) AS dst_ip,
  TIMESTAMP '2024-01-01 00:00:00' + CAST(p_partkey % 29 AS INT) * INTERVAL '1' DAY AS seen_at,
  p_partkey AS seen_seq
FROM {part}
"""

AUDIT_SQL = """
SELECT CAST(o_orderkey AS STRING) AS id, CONCAT('tok-', CAST(o_custkey % 10 AS STRING)) AS token_id,
  CASE o_orderstatus WHEN 'F' THEN 'admin' ELSE 'viewer' END AS role,
  CASE WHEN o_orderkey % 3 = 0 THEN 'POST' ELSE 'GET' END AS method,
  CASE o_orderkey % 13 WHEN 0 THEN '/api/v1/auth/login' WHEN 1 THEN '/api/v1/auth/logout' WHEN 2 THEN '/api/v1/users/password_reset'
       ELSE CONCAT('/api/v1/r', CAST(o_orderkey % 7 AS STRING)) END AS path,
  CAST(CASE o_orderkey % 10 WHEN 0 THEN 500 WHEN 1 THEN 404 ELSE 200 END AS INT) AS status,
  CONCAT('10.9.', CAST(o_custkey % 200 AS STRING), '.1') AS client_ip,
  CAST(o_orderkey % 900 AS INT) AS latency_ms,
  TIMESTAMP '2023-12-01 00:00:00' + CAST(o_orderkey * 7919 % 86400 AS INT) * INTERVAL '1' MINUTE AS ts
FROM {orders}
"""

PACKETS_SQL = """
SELECT event_id AS seq, user_id AS conn_id, CAST(ts AS TIMESTAMP) AS ts,
  CASE WHEN event_type IN ('view','click') THEN 'request' ELSE 'response' END AS kind
FROM {events}
"""

# org members version log (one upsert per customer row), teams, memberships
MEMBERS_SQL = """
SELECT CONCAT('u-', CAST(c_custkey % 300 AS STRING)) AS user_id,
  CONCAT('user', CAST(c_custkey % 300 AS STRING), '@example.com') AS email,
  c_name AS display_name,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'admin' WHEN 'MACHINERY' THEN 'analyst' ELSE 'viewer' END AS role,
  (c_custkey % 11 != 0) AS is_active,
  TIMESTAMP '2023-10-01 00:00:00' + CAST(c_custkey % 300 % 120 AS INT) * INTERVAL '1' DAY AS created_at,
  TIMESTAMP '2023-08-01 00:00:00' + CAST(c_custkey % 300 % 170 + c_nationkey % 3 AS INT) * INTERVAL '1' DAY AS last_seen,
  c_custkey AS version
FROM {customer}
"""

TEAMS_SQL = """
SELECT CONCAT('t-', CAST(n_nationkey AS STRING)) AS team_id, n_name AS name,
  TIMESTAMP '2023-01-01 00:00:00' + CAST(n_nationkey AS INT) * INTERVAL '1' DAY AS created_at
FROM {nation}
"""

TEAM_MEMBERS_SQL = """
SELECT CONCAT('t-', CAST(c_nationkey AS STRING)) AS team_id, CONCAT('u-', CAST(c_custkey % 300 AS STRING)) AS user_id,
  TIMESTAMP '2023-06-01 00:00:00' + CAST(c_custkey % 90 AS INT) * INTERVAL '1' DAY AS added_at
FROM {customer} WHERE c_custkey % 3 = 0
"""

SAVED_QUERIES_SQL = """
SELECT CONCAT('sq-', CAST(n_regionkey AS STRING)) AS id, CONCAT('query ', n_name) AS name,
  CASE n_nationkey % 3 WHEN 0 THEN '{{"protocol":"HTTP","src_ip":"10.0.1.1"}}' WHEN 1 THEN '{{"protocol":"DNS"}}'
       ELSE '{{"dst_ip":"8.8.8.4","from":"2024-01-10T00:00"}}' END AS filters,
  (n_nationkey % 5 = 4) AS deleted, CAST(n_nationkey AS BIGINT) AS version
FROM {nation}
"""

# ICMP echo traffic: requests from hosts to a gateway and replies back
ICMP_SQL = """
SELECT event_id AS seq, CAST(ts AS TIMESTAMP) AS ts,
  CAST(CASE WHEN event_type IN ('view', 'click', 'signup') THEN 8 ELSE 0 END AS INT) AS icmp_type,
  CASE WHEN event_type IN ('view', 'click', 'signup') THEN CONCAT('10.0.', CAST(user_id % 4 AS STRING), '.1')
       ELSE '10.255.0.1' END AS src_ip,
  CASE WHEN event_type IN ('view', 'click', 'signup') THEN '10.255.0.1'
       ELSE CONCAT('10.0.', CAST(user_id % 4 AS STRING), '.1') END AS dst_ip,
  CAST(user_id % 16 AS INT) AS echo_id,
  CAST(CAST(FLOOR(value) AS BIGINT) % 8 AS INT) AS echo_seq
FROM {events}
"""

# Fixed rule/config tables used together with the derived flows.
# fixed values: blocklist networks (net, lo, hi) with IPv4 bounds as integers
BLOCKLIST_ROWS = [("185.220.101.0/24", 3118228736, 3118228991),
                  ("91.108.4.0/22", 1533805568, 1533806591)]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _derive(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    return spark.sql(sql, **{t: read_table(spark, sf_dir, t) for t in tables})


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, FLOWS_SQL, "events")


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, AGENTS_SQL, "events")


def tls_certs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, TLS_CERTS_SQL, "part")


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, AUDIT_SQL, "orders")


def many_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, MANY_ADDRESSES_SQL, "lineitem")


def long_blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, LONG_BLOCKLIST_SQL, "orders")


def packet_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derive(spark, sf_dir, PACKETS_SQL, "events")


def members(spark, sf_dir):
    return _derive(spark, sf_dir, MEMBERS_SQL, "customer")


def teams(spark, sf_dir):
    return _derive(spark, sf_dir, TEAMS_SQL, "nation")


def team_members(spark, sf_dir):
    return _derive(spark, sf_dir, TEAM_MEMBERS_SQL, "customer")


def saved_queries(spark, sf_dir):
    return _derive(spark, sf_dir, SAVED_QUERIES_SQL, "nation")


def icmp_events(spark, sf_dir):
    return _derive(spark, sf_dir, ICMP_SQL, "events")


def duck(sql: str) -> str:
    """The same derivation text for DuckDB's pre-registered views."""
    return sql.format(**{t: t for t in TABLES})


def with_ctes(body: str, **ctes: str) -> str:
    """``WITH name AS (derivation), ... body`` for an oracle query."""
    parts = [f"{n} AS ({duck(s)})" for n, s in ctes.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body
