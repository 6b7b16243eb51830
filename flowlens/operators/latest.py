"""Versioned dimensions: latest row per key, and the agent / fleet / team views on top.

``latest_by_key`` replaces ClickHouse's ReplacingMergeTree FINAL / argMax with
``max_by`` over a (version, tie-break) struct.  It is a partial aggregate: each
task keeps one candidate per key, so a key with millions of versions never
materialises as a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.timewin import as_of_col, interval
from flowlens.operators.aggregate import positive


def _order(version: str | list[str]) -> Column:
    cols = [version] if isinstance(version, str) else list(version)
    return F.struct(*[F.col(c) for c in cols])


def latest_by_key(df: DataFrame, keys: list[str], version: str | list[str],
                  skip_blank: bool | list[str] = False) -> DataFrame:
    """Last version of every non-key column per key.

    ``skip_blank``: for these string columns (all strings when True) take the
    latest *non-blank* value (blank upserts do not erase known attributes).
    """
    order = _order(version)
    vcols = [version] if isinstance(version, str) else list(version)
    strings = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    blanks = (strings if skip_blank is True else set(skip_blank or [])) - set(keys)
    aggs = []
    for c in df.columns:
        if c in keys:
            continue
        if c in vcols:
            aggs.append(F.max(c).alias(c))
        elif c in blanks:
            ok = F.col(c) != ""
            aggs.append(F.coalesce(F.max_by(F.when(ok, F.col(c)), F.when(ok, order)), F.lit("")).alias(c))
        else:
            aggs.append(F.max_by(c, order).alias(c))
    return df.groupBy(*keys).agg(*aggs)


def latest_agents(agents: DataFrame, skip_blank: bool = True) -> DataFrame:
    """Agent attributes by latest ``last_seen``; first registration kept."""
    base = latest_by_key(agents.drop("registered_at"), ["agent_id"], ["last_seen", "version_seq"],
                         skip_blank=["version", "os", "cluster", "hostname"] if skip_blank else False)
    first = agents.groupBy("agent_id").agg(F.min("registered_at").alias("registered_at"))
    return base.join(first, "agent_id").drop("version_seq")


def agent_flow_counts(flows: DataFrame, hours: int = 1, as_of=None) -> DataFrame:
    """Flows per agent in the last ``hours`` (the ``/agents/stats`` view)."""
    now = as_of_col(flows, as_of)
    return flows.filter(F.col("ts") >= now - interval(f"{hours} HOURS")) \
                .groupBy("agent_id").agg(F.count(F.lit(1)).alias("flow_count"))


def agent_inventory(agents: DataFrame, flows: DataFrame, hours: int = 1, as_of=None) -> DataFrame:
    """Latest attributes per agent LEFT JOIN its pre-aggregated flow count (0 if none).

    The flow side is reduced to one row per agent *before* the join, so the
    join never sees raw flows.
    """
    counts = agent_flow_counts(flows, hours, as_of).withColumnRenamed("flow_count", "flow_count_window")
    inv = latest_agents(agents).join(counts, "agent_id", "left") \
        .withColumn("flow_count_window", F.coalesce(F.col("flow_count_window"), F.lit(0).cast("bigint")))
    return inv.orderBy(F.desc("last_seen"), "agent_id")


def fleet_totals(inventory: DataFrame, as_of, online_minutes: int = 5) -> DataFrame:
    """Agents, online agents (seen within ``online_minutes``), eBPF-enabled agents."""
    return inventory.agg(
        F.count(F.lit(1)).alias("agents"),
        F.count_if(F.col("last_seen") > as_of - interval(f"{online_minutes} MINUTES")).alias("online"),
        F.count_if(F.col("ebpf_enabled")).alias("ebpf"))


def cluster_summary(agents: DataFrame, flows: DataFrame, hours: int = 1, as_of=None,
                    online_minutes: int = 5) -> DataFrame:
    """Per cluster ('' -> 'default'): agents, online, distinct versions, flows in window."""
    now = as_of_col(flows, as_of)
    counts = agent_flow_counts(flows, hours, as_of)
    a = latest_agents(agents).join(counts, "agent_id", "left")
    out = a.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("agent_count"),
        F.count_if(F.col("last_seen") > now - interval(f"{online_minutes} MINUTES")).alias("online_count"),
        F.array_sort(F.collect_set(F.nullif(F.col("version"), F.lit("")))).alias("versions"),
        F.coalesce(F.sum("flow_count"), F.lit(0)).cast("bigint").alias("flows_window"))
    return out.withColumn("cluster", F.when(F.col("cluster") == "", "default").otherwise(F.col("cluster")))


def fleet_search(flows: DataFrame, agents: DataFrame, cluster: str = "", src_ip: str = "",
                 dst_ip: str = "", protocol: str = "", limit: int = 200) -> DataFrame:
    """Flows of agents whose latest cluster is ``cluster``, newest first, with the
    agent's cluster attached.  Semi join on the per-agent table; AQE broadcasts it
    when its runtime size is small."""
    a = latest_by_key(agents.select("agent_id", "cluster", "last_seen", "version_seq"),
                      ["agent_id"], ["last_seen", "version_seq"]).select(
        "agent_id", F.col("cluster").alias("agent_cluster"))
    f = flows
    if cluster:
        f = f.join(a.filter(F.col("agent_cluster") == cluster).select("agent_id"), "agent_id", "left_semi")
    if src_ip:
        f = f.filter(F.col("src_ip") == src_ip)
    if dst_ip:
        f = f.filter(F.col("dst_ip") == dst_ip)
    if protocol:
        f = f.filter(F.col("protocol") == protocol.upper())
    f = f.join(a, "agent_id", "left").select(
        "id", "agent_id", "hostname", "ts", "protocol", "src_ip", "src_port", "dst_ip", "dst_port",
        "bytes_in", "bytes_out", "duration_ms", "process_name",
        F.coalesce(F.col("agent_cluster"), F.lit("")).alias("cluster"))
    return f.orderBy(F.desc("ts"), F.desc("id")).limit(positive("limit", limit))


def enrich_graph_nodes(nodes: DataFrame, agents: DataFrame) -> DataFrame:
    """Mark service-graph nodes that are known agents (ip = agent_id OR hostname).

    The OR condition becomes an equi-join on one exploded key column.  When
    several agents match, the one listed last by the reference (oldest
    last_seen) wins.
    """
    a = agents.groupBy("agent_id").agg(F.max_by("hostname", F.col("last_seen")).alias("hostname"),
                                       F.max("last_seen").alias("last_seen"))
    keys = a.select(F.explode(F.array("agent_id", "hostname")).alias("ip"),
                    F.col("hostname").alias("agent_hostname"), "last_seen").filter(F.col("ip") != "")
    hit = keys.groupBy("ip").agg(F.min_by("agent_hostname", F.col("last_seen")).alias("agent_hostname"))
    out = nodes.join(hit, "ip", "left")
    return out.withColumn("is_known", F.col("agent_hostname").isNotNull()) \
              .withColumn("hostname", F.coalesce(F.col("agent_hostname"), F.lit(""))).drop("agent_hostname")


def active_members(members: DataFrame) -> DataFrame:
    """Latest member profile per user, active only."""
    m = latest_by_key(members.drop("created_at", "last_seen"), ["user_id"], "version")
    firsts = members.groupBy("user_id").agg(F.min("created_at").alias("created_at"),
                                           F.max("last_seen").alias("last_seen"))
    return m.join(firsts, "user_id").filter(F.col("is_active"))


def team_rollup(teams: DataFrame, team_members: DataFrame) -> DataFrame:
    """Teams LEFT JOIN member counts (counted before the join)."""
    counts = team_members.groupBy("team_id").agg(F.count("user_id").alias("member_count"))
    return teams.join(counts, "team_id", "left").withColumn(
        "member_count", F.coalesce(F.col("member_count"), F.lit(0).cast("bigint")))


def team_members_view(team_members: DataFrame, members: DataFrame) -> DataFrame:
    """Memberships joined to the latest active profile of each user."""
    m = latest_by_key(members.select("user_id", "email", "display_name", "role", "is_active", "version"),
                      ["user_id"], "version").filter(F.col("is_active"))
    return team_members.join(m.drop("is_active", "version"), "user_id")


def seed_if_absent(existing: DataFrame, builtins: DataFrame, key: str = "id") -> DataFrame:
    """INSERT ... WHERE NOT EXISTS: built-ins whose key is absent, plus the existing rows."""
    missing = builtins.join(existing.select(key), key, "left_anti")
    return existing.unionByName(missing, allowMissingColumns=True)
