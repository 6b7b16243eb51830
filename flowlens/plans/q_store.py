"""Registered queries over stored data: object pulls, table upkeep, saved sessions, list files."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from flowlens.operators import enrich as E
from flowlens.operators import export as X
from flowlens.operators import maintain as M
from flowlens.plans import q_io as IO
from flowlens.plans.catalog import register
from flowlens.session import ensure_checkpoint_dir
from flowlens.sources import cloud as CL
from flowlens.sources import ingest as IN
from flowlens.sources import pulls as PU
from flowlens.sources import testdata as td


def folder(spark, kind: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def W(body: str, **extra: str) -> str:
    return td.with_ctes(body, flows=td.FLOWS_SQL, **extra)


OBJECT_SQL = IO.AWS_SQL.replace("END AS value", "END AS value, event_id % 3 AS object", 1)


@register("pull_ledger", td.with_ctes(f"""
, p AS (SELECT object, string_split_regex(regexp_replace(value, '^\\s+|\\s+$', '', 'g'), '\\s+') AS f FROM aws),
q AS (SELECT CASE WHEN object = 2 THEN 3 ELSE 1 END AS pull, {IO._duck_uint('f[10]')} AS b FROM p
      WHERE len(f) >= 14 AND f[1] != 'version' AND f[14] NOT IN ('NODATA', 'SKIPDATA')
        AND regexp_full_match(f[4], '{IO.V4RE}') AND regexp_full_match(f[5], '{IO.V4RE}'))
SELECT CAST(n AS BIGINT) AS pull, CAST(CASE n WHEN 1 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS BIGINT) AS objects,
  count(b) AS rows, count(b) AS stored_rows, CAST(COALESCE(sum(b), 0) AS BIGINT) AS stored_bytes
FROM range(1, 5) t(n) LEFT JOIN q ON q.pull = n GROUP BY n""", aws=OBJECT_SQL))
def q_pull_ledger(spark, sf):
    """Four pulls of a folder that gets two objects, nothing, a third, and nothing: what each took and stored."""
    src, out = folder(spark, "objects"), folder(spark, "pulls")
    lines = spark.sql(OBJECT_SQL, events=td.read_table(spark, sf, "events"))

    def arrive(n: int) -> None:
        lines.filter(F.col("object") == n).select("value").coalesce(1).write.text(f"{src}/object-{n}")

    def take() -> None:
        PU.pull(spark, "aws-1", src, out, lambda df: CL.parse_aws_vpc(df, "aws-1", "vpc-logs", ingest_time=IO.INGEST_TIME), pattern="*.txt")

    arrive(0)
    arrive(1)
    take()
    take()
    arrive(2)
    take()
    take()
    stored = PU.pulled_rows(spark, out).groupBy("pull").agg(
        F.count(F.lit(1)).alias("stored_rows"), F.sum(F.col("bytes_in") + F.col("bytes_out")).alias("stored_bytes"))
    return PU.pull_log(spark, out).select("pull", "objects", "rows").join(stored, "pull", "left").fillna(0)


AS_OF = dt.datetime(2024, 1, 31)


@register("table_upkeep", W("""
SELECT CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS day, count(*) AS flows, CAST(sum(bytes_in) AS BIGINT) AS bytes_in, count(DISTINCT id) AS ids
FROM flows WHERE ts >= TIMESTAMP '2024-01-11 00:00:00' GROUP BY 1"""))
def q_table_upkeep(spark, sf):
    """Flows written as epochs, packed, cut to 25 and then 20 days, with an epoch that came in between."""
    path = folder(spark, "flow-table")
    flows = td.flows(spark, sf)
    part = F.abs(F.hash("id")) % 4
    for e in range(3):
        X.write_flows(flows.filter(part == e), path, epoch=e)
    M.maintain(spark, path, AS_OF, days=25)
    X.write_flows(flows.filter(part == 3), path, epoch=3)
    M.maintain(spark, path, AS_OF, days=20)
    t = M.read_table(spark, path)
    return t.groupBy(F.date_format("ts", "yyyyMMdd").cast("int").alias("day")).agg(
        F.count(F.lit(1)).alias("flows"), F.sum("bytes_in").alias("bytes_in"), F.count_distinct("id").alias("ids"))


@register("saved_session", W("SELECT id, ts, protocol, src_ip, dst_ip, bytes_in FROM flows WHERE agent_id = 'agent-3'"))
def q_saved_session(spark, sf):
    """Two captures saved, one of them twice and with repeated flows; the other one's flows don't show."""
    path = folder(spark, "sessions")
    flows = td.flows(spark, sf)
    mine = flows.filter(F.col("agent_id") == "agent-3")
    IN.save_session(mine, path, "capture-3")
    IN.save_session(flows.filter(F.col("agent_id") == "agent-4"), path, "capture-4")
    IN.save_session(mine.unionByName(mine), path, "capture-3")
    return IN.load_session(spark, path, "capture-3").select("id", "ts", "protocol", "src_ip", "dst_ip", "bytes_in")


LIST_SQL = """
SELECT c_custkey AS n, CASE c_custkey % 8
  WHEN 0 THEN CONCAT('198.51.', CAST(c_custkey % 256 AS STRING), '.0/24')
  WHEN 1 THEN CONCAT('# note ', c_name)
  WHEN 2 THEN CONCAT('  2001:db8:', CAST(c_custkey % 1000 AS STRING), '::/48 ')
  WHEN 3 THEN CONCAT('203.0.113.', CAST(c_custkey % 300 AS STRING))
  WHEN 4 THEN CONCAT('10.', CAST(c_custkey % 200 AS STRING), '.0.0/40')
  WHEN 5 THEN 'no network' WHEN 6 THEN ''
  ELSE CONCAT('fe80::', CAST(c_custkey % 5000 AS STRING)) END AS value FROM {customer}
"""


@register("blocklist_file", td.with_ctes("""
SELECT trim(value) AS net, CAST(-CASE n % 8 WHEN 0 THEN 120 WHEN 2 THEN 48 ELSE 128 END AS BIGINT) AS ord
FROM lines WHERE n % 8 IN (0, 2, 7) OR (n % 8 = 3 AND n % 300 < 256)""", lines=LIST_SQL))
def q_blocklist_file(spark, sf):
    """A list file of IPv4 and IPv6 networks and addresses, notes, blank and bad lines."""
    path = folder(spark, "blocklist")
    spark.sql(LIST_SQL, customer=td.read_table(spark, sf, "customer")).select("value").write.text(path)
    return E.load_blocklist(spark, path)
