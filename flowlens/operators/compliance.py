"""Compliance evidence reports (SOC 2, PCI DSS, HIPAA).

Each check is one DataFrame of evidence rows; a report stacks the checks'
row counts with one ``unionByName`` + aggregate, so a framework is evaluated as
a single Spark job instead of one query per check.  The driver only iterates
over the fixed list of check *definitions*.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.timewin import interval

# fixed values: source prefixes the compliance SQL treats as internal
INTERNAL_PREFIXES = ["10.", "172.16.", "192.168."]


@dataclass
class Inputs:
    flows: DataFrame
    as_of: Column
    since: Column
    agents: DataFrame | None = None
    audit: DataFrame | None = None       # id, method, path, status, ts, token_id ...
    matches: DataFrame | None = None     # rule_id, match_data, fired_at, severity
    rules: DataFrame | None = None       # id, title, tags
    members: DataFrame | None = None     # user_id, email, role, is_active, created_at, last_seen, version


def report_window(as_of: Column, schedule: str) -> Column:
    """Evidence start: daily -1 d, weekly -7 d, monthly -1 month, other -30 d."""
    return {"daily": as_of - interval("1 DAY"), "weekly": as_of - interval("7 DAYS"),
            "monthly": as_of - interval("1 MONTH")}.get(schedule, as_of - interval("30 DAYS"))


def _external_src() -> Column:
    c = F.lit(True)
    for p in INTERNAL_PREFIXES:
        c = c & ~F.col("src_ip").startswith(p)
    return c


def _recent(x: Inputs) -> DataFrame:
    return x.flows.filter(F.col("ts") >= x.since)


def soc2_cc6_1(x: Inputs) -> DataFrame:
    f = _recent(x).filter(F.col("dst_port").isin(22, 3389, 5432, 6379, 27017) & _external_src())
    return f.groupBy("src_ip", "dst_ip", "dst_port").agg(
        F.count(F.lit(1)).alias("attempts"), F.max("ts").alias("last_seen"))


def soc2_cc6_7(x: Inputs) -> DataFrame:
    f = _recent(x).filter((F.col("protocol") == "HTTP") & ~F.col("dst_port").isin(443, 8443)
                          & (F.col("bytes_out") > 512))
    return f.groupBy("dst_ip", "dst_port").agg(
        F.count(F.lit(1)).alias("flow_count"), F.sum("bytes_out").alias("total_bytes"))


def _matches_with_rules(x: Inputs) -> DataFrame:
    m = x.matches.filter(F.col("fired_at") >= x.since)
    r = x.rules.select(F.col("id").alias("rule_id"), F.col("title").alias("rule"), "tags")
    return m.join(r, "rule_id").select(
        "rule", "rule_id", "tags", F.get_json_object("match_data", "$.src_ip").alias("src_ip"),
        F.get_json_object("match_data", "$.dst_ip").alias("dst_ip"), "severity", "fired_at")


def soc2_cc7_2(x: Inputs) -> DataFrame:
    return _matches_with_rules(x).select("rule", "src_ip", "dst_ip", "severity", "fired_at")


def soc2_cc8_1(x: Inputs) -> DataFrame:
    a = x.agents.groupBy("agent_id").agg(
        F.max_by("hostname", "last_seen").alias("hostname"), F.max_by("version", "last_seen").alias("version"),
        F.min("registered_at").alias("registered_at"), F.max("last_seen").alias("last_seen"))
    a = a.filter((F.col("registered_at") >= x.since) | (F.col("last_seen") >= x.since))
    return a.withColumn("status", F.when(F.col("last_seen") < x.as_of - interval("1 HOUR"), "OFFLINE")
                        .otherwise("ONLINE"))


def soc2_a1_1(x: Inputs) -> DataFrame:
    return _recent(x).agg(F.count_distinct("agent_id").alias("active_agents"),
                          F.count(F.lit(1)).alias("total_flows"),
                          F.min("ts").alias("first_flow"), F.max("ts").alias("last_flow"))


def pci_1_3(x: Inputs) -> DataFrame:
    f = _recent(x).filter(_external_src() & F.col("dst_port").isin(443, 8443, 3306, 5432, 1433, 6379, 27017))
    return f.groupBy("src_ip", "dst_ip", "dst_port", "protocol").agg(F.count(F.lit(1)).alias("cnt"))


def pci_2_2(x: Inputs) -> DataFrame:
    f = _recent(x).filter(F.col("protocol").isin("TELNET", "FTP", "HTTP") & F.col("dst_port").isin(21, 23, 80, 8080)
                          & ~F.col("dst_ip").startswith("192.168."))
    return f.groupBy("src_ip", "dst_ip", "dst_port", "protocol").agg(F.count(F.lit(1)).alias("cnt"))


def _audit_actions(x: Inputs) -> DataFrame:
    # action = "METHOD path" (the audit table has no action column)
    return x.audit.filter(F.col("ts") >= x.since).withColumn(
        "action", F.concat_ws(" ", "method", "path"))


def pci_10_2(x: Inputs) -> DataFrame:
    return _audit_actions(x).groupBy("action").agg(
        F.count(F.lit(1)).alias("event_count"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def pci_11_4(x: Inputs) -> DataFrame:
    m = _matches_with_rules(x).filter(F.col("tags").contains("portscan") | F.col("tags").contains("lateral"))
    return m.groupBy("rule", "src_ip").agg(F.count(F.lit(1)).alias("fires"), F.max("fired_at").alias("last_fired"))


def hipaa_312_e1(x: Inputs) -> DataFrame:
    f = _recent(x).filter((F.col("protocol") == "HTTP") & ~F.col("dst_port").isin(443, 8443))
    return f.groupBy("src_ip", "dst_ip", "dst_port").agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("bytes_out").alias("bytes"))


# fixed values: authentication audit actions of the HIPAA audit-controls check
AUTH_ACTIONS = ["login", "logout", "invite_accepted", "password_reset"]


def hipaa_312_b(x: Inputs) -> DataFrame:
    a = _audit_actions(x).withColumn("action", F.element_at(F.split("path", "/"), -1))
    a = a.filter(F.col("action").isin(AUTH_ACTIONS))
    return a.groupBy("action", F.col("token_id").alias("actor")).agg(
        F.count(F.lit(1)).alias("cnt"), F.max("ts").alias("last"))


def _active_members(x: Inputs) -> DataFrame:
    from flowlens.operators.latest import active_members
    return active_members(x.members)


def hipaa_308_a1(x: Inputs) -> DataFrame:
    return _active_members(x).filter(F.col("created_at") >= x.since).select(
        "email", "role", F.col("created_at").alias("joined_at"), "last_seen")


def hipaa_312_a1(x: Inputs) -> DataFrame:
    return _active_members(x).filter(F.col("last_seen") < x.as_of - interval("90 DAYS")).select(
        "email", "role", "last_seen")


@dataclass(frozen=True)
class Check:
    """A check: its evidence, the order it is printed in, and how its row count is judged."""

    name: str
    fn: Callable[[Inputs], DataFrame]
    order: tuple[str, ...]       # "-col" for descending
    fail_on_rows: bool = False
    pass_on_rows: bool = False
    info_only: bool = False

    def sort_columns(self) -> list[Column]:
        return [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in self.order]


FRAMEWORKS: dict[str, list[Check]] = {
    "soc2": [Check("CC6.1", soc2_cc6_1, ("-attempts", "src_ip", "dst_ip", "dst_port"), fail_on_rows=True),
             Check("CC6.7", soc2_cc6_7, ("-total_bytes", "dst_ip", "dst_port")),
             Check("CC7.2", soc2_cc7_2, ("-fired_at", "rule", "src_ip", "dst_ip"), info_only=True),
             Check("CC8.1", soc2_cc8_1, ("-registered_at", "agent_id"), info_only=True),
             Check("A1.1", soc2_a1_1, ("first_flow",), pass_on_rows=True, info_only=True)],
    "pci": [Check("Req 1.3", pci_1_3, ("-cnt", "src_ip", "dst_ip", "dst_port", "protocol"), fail_on_rows=True),
            Check("Req 2.2", pci_2_2, ("-cnt", "src_ip", "dst_ip", "dst_port", "protocol")),
            Check("Req 10.2", pci_10_2, ("-event_count", "action"), pass_on_rows=True, info_only=True),
            Check("Req 11.4", pci_11_4, ("-fires", "rule", "src_ip"), info_only=True)],
    "hipaa": [Check("164.312(e)(1)", hipaa_312_e1, ("-bytes", "src_ip", "dst_ip", "dst_port")),
              Check("164.312(b)", hipaa_312_b, ("-cnt", "action", "actor"), pass_on_rows=True, info_only=True),
              Check("164.308(a)(1)", hipaa_308_a1, ("-joined_at", "email"), info_only=True),
              Check("164.312(a)(1)", hipaa_312_a1, ("last_seen", "email"))],
}


def _status(n: Column, fail_on: bool, pass_on: bool, info: bool) -> Column:
    if info:
        return F.lit("info")
    if fail_on:
        return F.when(n > 0, "fail").otherwise("pass")
    if pass_on:
        return F.when(n == 0, "warn").otherwise("pass")
    return F.when(n > 0, "warn").otherwise("pass")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compliance_report(framework: str, x: Inputs) -> DataFrame:
    """(framework, check_name, status, row_count); counts are taken over all evidence."""
    parts = []
    for c in FRAMEWORKS[framework]:
        n = c.fn(x).agg(F.count(F.lit(1)).alias("row_count"))
        parts.append(n.select(F.lit(framework).alias("framework"), F.lit(c.name).alias("check_name"),
                              _status(F.col("row_count"), c.fail_on_rows, c.pass_on_rows, c.info_only).alias("status"),
                              "row_count"))
    return _union(parts)


def report_evidence(framework: str, x: Inputs) -> DataFrame:
    """All evidence rows of every check as (check_name, evidence JSON)."""
    return _union([c.fn(x).select(F.lit(c.name).alias("check_name"), F.to_json(F.struct("*")).alias("evidence"))
                   for c in FRAMEWORKS[framework]])


def _csv_field(c: Column) -> Column:
    """Text of a value, quoted where it holds a comma, a quote or a line end."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(t.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def report_csv_lines(framework: str, x: Inputs, limit: int | None = None) -> DataFrame:
    """Report as (section, part, order key, line): sort by the first three to print it.

    Per check a header line (part 0), its evidence rows (part 1) and a blank line
    (part 2).  The order key is a struct of sort texts, so ordering stays a
    distributed range sort; `limit` keeps the first rows of each check.
    """
    parts = []
    spark = x.flows.sparkSession
    for i, c in enumerate(FRAMEWORKS[framework]):
        ev = c.fn(x)
        if limit is not None:
            ev = ev.orderBy(*c.sort_columns()).limit(limit)
        keys = [_sort_text(ev, o) for o in c.order]
        pad = [F.lit("")] * (5 - len(keys))
        body = ev.select(F.lit(i).alias("section"), F.lit(1).alias("part"), F.array(*keys, *pad).alias("order_key"),
                         F.concat_ws(",", F.lit(""), *[_csv_field(F.col(k)) for k in ev.columns]).alias("line"))
        blank = F.array_repeat(F.lit(""), 5)
        for part, line in ((0, f"{c.name}," + ",".join(ev.columns)), (2, "")):
            parts.append(spark.range(1).select(F.lit(i).alias("section"), F.lit(part).alias("part"),
                                               blank.alias("order_key"), F.lit(line).alias("line")))
        parts.append(body)
    return _union(parts)


def _sort_text(df: DataFrame, order: str) -> Column:
    """A text that sorts as the column does: numbers and times padded, descending ones complemented."""
    name = order.lstrip("-")
    kind = dict(df.dtypes)[name]
    if kind == "string":
        return F.coalesce(F.col(name), F.lit(""))
    n = F.unix_micros(name) if kind == "timestamp" else F.col(name).cast("long")
    n = F.coalesce(n, F.lit(0))
    return F.lpad((F.lit(2**62) - n if order.startswith("-") else F.lit(2**61) + n).cast("string"), 20, "0")
