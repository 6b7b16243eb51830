"""Detection: traffic baselines + Z-score anomalies, threshold alerts, detection
rules, process policies, incidents.

The reference runs these as tickers that pull rows into Go maps and loop; here
every detector is one DataFrame plan (join + column math), written once and
usable in batch or inside ``foreachBatch`` of a stream.
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.ip import ip_key, is_v4_key, with_cidr
from flowlens.functions.timewin import as_of_col, bounded, hour_of_week, interval
from flowlens.session import ensure_checkpoint_dir

LOG = logging.getLogger(__name__)

# fixed values: anomaly detector constants
Z_THRESHOLD = 3.0
MIN_SAMPLES = 3
MIN_MEAN_FLOOR = 5.0


# ---- baselines and anomalies ------------------------------------------------

def hourly_counts(flows: DataFrame, lookback_days: int = 7, as_of=None) -> DataFrame:
    now = as_of_col(flows, as_of)
    f = flows.filter((F.col("ts") >= now - interval(f"{lookback_days} DAYS")) & (F.col("agent_id") != ""))
    return f.groupBy("agent_id", "protocol", F.date_trunc("hour", "ts").alias("hour_bucket")).agg(
        F.count(F.lit(1)).alias("hourly_count"), F.sum("bytes_in").alias("bytes_in_sum"),
        F.sum("bytes_out").alias("bytes_out_sum"))


def compute_baselines(flows: DataFrame, lookback_days: int = 7, as_of=None) -> DataFrame:
    """Per (agent, protocol, hour_of_week): mean / population std of hourly
    counts, mean bytes, number of observed hours (empty hours not counted)."""
    h = hourly_counts(flows, lookback_days, as_of)
    return h.groupBy("agent_id", "protocol", hour_of_week(F.col("hour_bucket")).alias("hour_of_week")).agg(
        F.avg("hourly_count").alias("flow_count_mean"),
        F.stddev_pop("hourly_count").alias("flow_count_std"),
        F.avg("bytes_in_sum").alias("bytes_in_mean"),
        F.avg("bytes_out_sum").alias("bytes_out_mean"),
        F.count(F.lit(1)).alias("sample_count"))


def _score(obs: DataFrame, per_hour: float) -> DataFrame:
    """Z-score columns on an (observation ⋈ baseline) frame."""
    observed = F.col("flow_count") * F.lit(per_hour)
    floor = F.greatest(F.col("flow_count_std"), F.col("flow_count_mean") * 0.1, F.lit(MIN_MEAN_FLOOR))
    z = (observed - F.col("flow_count_mean")) / floor
    out = obs.withColumn("observed", observed.cast("double")).withColumn("z_score", z)
    kind = F.when(F.col("z_score") < 0, "drop").otherwise("spike")
    out = out.withColumn("anomaly_type", kind).withColumn(
        "severity", F.when(F.abs("z_score") >= 6, "high").when(F.abs("z_score") >= 4, "medium").otherwise("low"))
    ratio = F.abs(F.col("observed") / F.greatest(F.col("flow_count_mean"), F.lit(1.0)))
    # fixed value: the message format
    desc = F.format_string(
        "%s: %s traffic on agent %s is %.1fx %s than usual (observed: %.0f flows/hr, expected: ~%.0f, σ=%.1f)",
        F.initcap(F.col("anomaly_type")), F.col("protocol"), F.col("hostname"), F.bround(ratio, 1),
        F.when(F.col("anomaly_type") == "spike", "higher").otherwise("lower"),
        F.bround("observed", 0), F.bround("flow_count_mean", 0), F.bround("z_score", 1) + F.lit(0.0))
    return out.withColumn("description", desc).withColumnRenamed("flow_count_mean", "expected")


def latest_hosts(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """(agent_id, hostname): the latest host name that isn't blank; blank if there is none."""
    named = F.col("hostname") != ""
    return rows.groupBy("agent_id").agg(F.coalesce(
        F.max_by(F.when(named, F.col("hostname")), F.when(named, F.struct(ts, "hostname"))), F.lit("")).alias("hostname"))


def detect_anomalies(flows: DataFrame, baselines: DataFrame, as_of=None, window_minutes: int = 5,
                     min_samples: int = MIN_SAMPLES, z_threshold: float = Z_THRESHOLD,
                     include_silent: bool = False, agents: DataFrame | None = None) -> DataFrame:
    """Latest window vs the baseline of the current hour-of-week (reference form).

    Only what was observed is tested, so traffic that stopped never shows.  With
    ``include_silent`` a baseline without a flow in the window is tested with no
    flows, under its agent's host name in ``agents`` (one row per agent_id) or,
    without that, in the agent's flows.
    """
    now = as_of_col(flows, as_of)
    obs = flows.filter((F.col("ts") >= now - interval(f"{window_minutes} MINUTES")) & (F.col("agent_id") != "")) \
               .groupBy("agent_id", "hostname", "protocol").agg(F.count(F.lit(1)).alias("flow_count"))
    bl = baselines.filter((F.col("hour_of_week") == hour_of_week(now)) & (F.col("sample_count") >= min_samples))
    if include_silent:
        quiet = bl.select("agent_id", "protocol").join(obs, ["agent_id", "protocol"], "left_anti")
        hosts = (agents if agents is not None else latest_hosts(flows)).select("agent_id", "hostname")
        obs = obs.unionByName(quiet.join(hosts, "agent_id", "left").select(
            "agent_id", F.coalesce("hostname", F.lit("")).alias("hostname"), "protocol",
            F.lit(0).cast("long").alias("flow_count")))
    j = obs.join(bl.select("agent_id", "protocol", "flow_count_mean", "flow_count_std"),
                 ["agent_id", "protocol"])
    out = _score(j, 60.0 / window_minutes).filter(F.abs("z_score") >= z_threshold)
    return out.withColumn("detected_at", now).select(
        "agent_id", "hostname", "protocol", "anomaly_type", "z_score", "observed", "expected",
        "description", "severity", "detected_at")


def silent_windows(obs: DataFrame, baselines: DataFrame, window_minutes: int) -> DataFrame:
    """The windows without a flow, as rows of ``obs`` with flow_count 0.

    ``obs`` also holds the first and last flow of its windows.  Each (agent,
    protocol) of ``baselines`` is looked for in the windows of its hour-of-week
    that start after the agent's first flow, up to the last flow of all agents.
    """
    step = interval(f"{window_minutes} MINUTES")
    seen = (obs.groupBy("agent_id").agg(F.min("first").alias("first_seen")).join(latest_hosts(obs, "last"), "agent_id")
            .withColumn("until", obs.select(F.max("last")).scalar()))
    # the weeks of a baseline's hour first, then the windows of these hours: only what is tested is made
    hours = (baselines.select("agent_id", "protocol", "hour_of_week").join(seen, "agent_id")
             .withColumn("week", F.explode(F.sequence(
                 F.date_trunc("week", "first_seen"), F.date_trunc("week", "until"), interval("7 DAYS"))))
             .withColumn("hour", F.col("week") + F.make_dt_interval(hours=F.col("hour_of_week")))
             .filter((F.col("hour") <= F.col("until")) & (F.col("hour") + interval("1 HOUR") > F.col("first_seen"))))
    grid = (hours.withColumn("at", F.explode(F.sequence("hour", F.col("hour") + interval("1 HOUR") + step, step)))
            .withColumn("window_start", F.window("at", f"{window_minutes} minutes").start)
            .filter((F.col("window_start") > F.col("first_seen")) & (F.col("window_start") <= F.col("until"))
                    & (F.date_trunc("hour", "window_start") == F.col("hour"))))
    return (grid.select("window_start", "agent_id", "hostname", "protocol").distinct()
            .join(obs, ["window_start", "agent_id", "protocol"], "left_anti")
            .withColumn("flow_count", F.lit(0).cast("long")))


def detect_anomalies_history(flows: DataFrame, baselines: DataFrame, window_minutes: int = 5,
                             min_samples: int = MIN_SAMPLES, z_threshold: float = Z_THRESHOLD,
                             include_silent: bool = False) -> DataFrame:
    """The same test over *every* tumbling window of the table (backfill form).

    One group-by on (window, agent, hostname, protocol), then a join with the
    baseline on (agent, protocol, hour_of_week of the window start).  With
    ``include_silent`` windows that start after an agent's first flow and hold
    none of a baseline's protocol are tested too; the rows are then one per
    window and baseline, whatever the number of flows.
    """
    obs = flows.filter(F.col("agent_id") != "").groupBy(
        F.window("ts", f"{window_minutes} minutes").start.alias("window_start"),
        "agent_id", "hostname", "protocol").agg(F.count(F.lit(1)).alias("flow_count"),
                                                F.min("ts").alias("first"), F.max("ts").alias("last"))
    if include_silent:
        # the flows are read once; all else comes from their windows
        ensure_checkpoint_dir(flows.sparkSession)
        obs = obs.checkpoint()
        known = baselines.filter(F.col("sample_count") >= min_samples)
        obs = obs.drop("first", "last").unionByName(silent_windows(obs, known, window_minutes))
    return detect_windows(obs, baselines, window_minutes, min_samples, z_threshold)


def detect_windows(obs: DataFrame, baselines: DataFrame, window_minutes: int = 5, min_samples: int = MIN_SAMPLES,
                   z_threshold: float = Z_THRESHOLD) -> DataFrame:
    """The test over counted windows (window_start, agent_id, hostname, protocol, flow_count)."""
    obs = obs.withColumn("hour_of_week", hour_of_week(F.col("window_start")))
    bl = baselines.filter(F.col("sample_count") >= min_samples).select(
        "agent_id", "protocol", "hour_of_week", "flow_count_mean", "flow_count_std")
    j = obs.join(bl, ["agent_id", "protocol", "hour_of_week"])
    out = _score(j, 60.0 / window_minutes).filter(F.abs("z_score") >= z_threshold)
    return out.select("window_start", "agent_id", "hostname", "protocol", "anomaly_type", "z_score",
                      "observed", "expected", "description", "severity")


# ---- threshold alerts -------------------------------------------------------

METRICS = ("flows_per_minute", "http_error_rate", "dns_nxdomain_rate", "anomaly_flow_rate",
           "anomaly_http_latency")


def _web_latency() -> Column:
    return F.when(F.col("protocol").isin("HTTP", "HTTPS") & (F.col("http_method") != ""), F.col("duration_ms"))


def hourly_load(flows: DataFrame) -> DataFrame:
    """(h, cnt, lat_sum, lat_n): flows and web latency per hour, mergeable by sums."""
    lat = _web_latency()
    return flows.groupBy(F.date_trunc("hour", "ts").alias("h")).agg(
        F.count(F.lit(1)).alias("cnt"), F.coalesce(F.sum(lat), F.lit(0)).alias("lat_sum"), F.count(lat).alias("lat_n"))


def alert_metrics(flows: DataFrame, windows: list[int], as_of=None, baseline_days: int = 7,
                  hourly: DataFrame | None = None) -> DataFrame:
    """(window_minutes, metric, value) for every metric and requested window.

    One scan: an aggregate by hour carries the windowed counts and the load of
    the baseline range (``baseline_days``, without the last hour), and a second
    aggregate over its few rows gives all metrics.  With ``hourly`` (stored
    ``hourly_load`` rows of whole hours) only the windows' rows are read.
    """
    now = as_of_col(flows, as_of)
    look = max(max(windows), 5)
    http, dns, lat = F.col("protocol") == "HTTP", F.col("protocol") == "DNS", _web_latency()
    counts = {}
    for w in sorted(set(windows)):
        inw = F.col("ts") > now - interval(f"{w} MINUTES")
        counts |= {f"n_{w}": inw, f"http_{w}": inw & http, f"http_err_{w}": inw & http & (F.col("http_status") >= 400),
                   f"dns_{w}": inw & dns, f"nx_{w}": inw & dns & (F.col("dns_rcode") == 3)}
    last5 = F.col("ts") >= now - interval("5 MINUTES")
    counts["n_last5"] = last5
    aggs = [F.count_if(c).alias(n) for n, c in counts.items()]
    aggs += [F.sum(F.when(last5, lat)).alias("lat5_sum"), F.count(F.when(last5, lat)).alias("lat5_n")]
    oldest, newest = now - interval(f"{baseline_days} DAYS"), now - interval("1 HOUR")
    in_base = (F.col("ts") >= oldest) & (F.col("ts") < newest)
    reach = look if hourly is not None else max(look, 60 * 24 * baseline_days)
    recent = bounded(flows, now - interval(f"{reach} MINUTES"))
    per_hour = recent.groupBy(F.date_trunc("hour", "ts").alias("h")).agg(
        *aggs, F.count_if(in_base).alias("cnt"), F.sum(F.when(in_base, lat)).alias("lat_sum"),
        F.count(F.when(in_base, lat)).alias("lat_n"))
    whole = [*counts, "lat5_sum", "lat5_n"]
    if hourly is not None:
        whole_hour = (F.col("h") >= oldest) & (F.col("h") + interval("1 HOUR") <= newest)
        stored = hourly.filter(whole_hour).groupBy("h").agg(
            *[F.sum(c).alias(c) for c in ("cnt", "lat_sum", "lat_n")])
        per_hour = per_hour.drop("cnt", "lat_sum", "lat_n").unionByName(stored, allowMissingColumns=True)
    cnt = F.when(F.col("cnt") > 0, F.col("cnt"))
    avg_lat = F.when(F.col("lat_n") > 0, F.col("lat_sum") / F.col("lat_n"))
    row = per_hour.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in whole],
                       F.avg(cnt).alias("b_avg"), F.stddev_pop(cnt).alias("b_std"),
                       F.avg(avg_lat).alias("l_avg"), F.stddev_pop(avg_lat).alias("l_std"))
    row = row.withColumn("lat_last5", F.when(F.col("lat5_n") > 0, F.col("lat5_sum") / F.col("lat5_n")))
    flow_sigma = F.when(F.coalesce(F.col("b_std"), F.lit(0.0)) < 1, F.lit(0.0)).otherwise(
        (F.col("n_last5") * 12.0 - F.col("b_avg")) / F.col("b_std"))
    lat_sigma = F.when(F.coalesce(F.col("l_std"), F.lit(0.0)) < 1, F.lit(0.0)).otherwise(
        (F.col("lat_last5") - F.col("l_avg")) / F.col("l_std"))

    def m(w, name, value):
        return F.struct(F.lit(w).alias("window_minutes"), F.lit(name).alias("metric"),
                        value.cast("double").alias("value"))

    stacks = []
    for w in sorted(set(windows)):
        stacks += [m(w, "flows_per_minute", F.col(f"n_{w}") / F.lit(float(w))),
                   m(w, "http_error_rate", F.col(f"http_err_{w}") * 100.0 / F.greatest(F.col(f"http_{w}"), F.lit(1))),
                   m(w, "dns_nxdomain_rate", F.col(f"nx_{w}") * 100.0 / F.greatest(F.col(f"dns_{w}"), F.lit(1))),
                   m(w, "anomaly_flow_rate", flow_sigma),
                   m(w, "anomaly_http_latency", lat_sigma)]
    return row.select(F.explode(F.array(*stacks)).alias("m")).select("m.*")


def alert_message(name: Column, metric: Column, condition: Column, value: Column, threshold: Column, minutes: Column) -> Column:
    """Text of an alert event."""
    verb = F.when(condition == "gt", "exceeded").when(condition == "lt", "fell below").otherwise(condition)
    # fixed value: the message format
    return F.format_string("[flowlens] %s: %s is %.2f (%s threshold %.2f over last %d min)",
                           name, metric, F.bround(value, 2), verb, F.bround(threshold, 2), minutes)


def evaluate_alerts(rules: DataFrame, metrics: DataFrame, events: DataFrame | None, as_of) -> DataFrame:
    """Fire enabled rules whose metric is strictly gt/lt the threshold and that
    have not fired within their cooldown; returns the new event rows."""
    r = rules.filter(F.col("enabled")).withColumn(
        "window_minutes", F.coalesce(F.nullif(F.col("window_minutes"), F.lit(0)), F.lit(5))).withColumn(
        "cooldown_minutes", F.coalesce(F.nullif(F.col("cooldown_minutes"), F.lit(0)), F.lit(15)))
    j = r.join(metrics, ["metric", "window_minutes"])
    fire = ((F.col("condition") == "gt") & (F.col("value") > F.col("threshold"))) | \
           ((F.col("condition") == "lt") & (F.col("value") < F.col("threshold")))
    j = j.filter(fire)
    if events is not None:
        recent = events.join(r.select(F.col("id").alias("rule_id"), "cooldown_minutes"), "rule_id") \
            .filter(F.col("fired_at") > as_of - F.make_dt_interval(mins=F.col("cooldown_minutes"))) \
            .select(F.col("rule_id").alias("id")).distinct()
        j = j.join(recent, "id", "left_anti")
    msg = alert_message(F.col("name"), F.col("metric"), F.col("condition"), F.col("value"), F.col("threshold"), F.col("window_minutes"))
    return j.select(F.col("id").alias("rule_id"), F.col("name").alias("rule_name"), "metric", "value",
                    "threshold", as_of.alias("fired_at"), msg.alias("message"))


# ---- detection rules --------------------------------------------------------

def _since(flows: DataFrame, minutes: int, as_of) -> DataFrame:
    lo = as_of_col(flows, as_of) - interval(f"{minutes} MINUTES")
    return bounded(flows, lo).filter(F.col("ts") > lo)


def rule_port_scan(flows: DataFrame, window_minutes: int = 5, min_ports: int = 50, as_of=None) -> DataFrame:
    """Sources probing more than ``min_ports`` distinct destination ports (TCP/UDP).

    Spark plans the exact distinct as a two-level aggregate ((src, port) first),
    so one scanning host with a third of the rows is spread over many tasks.
    """
    f = _since(flows, window_minutes, as_of).filter(F.col("protocol").isin("TCP", "UDP"))
    return f.groupBy("src_ip").agg(F.count_distinct("dst_port").alias("port_count"),
                                   F.min("ts").alias("first_seen")).filter(F.col("port_count") > min_ports)


# fixed values: authentication path fragments of the cleartext-credentials rule
CRED_PATHS = ["/login", "/auth", "/signin", "/password"]
# fixed values: shell / interpreter process names and the allowed ports
SHELL_PROCESSES = ["bash", "sh", "zsh", "python", "python3", "powershell", "pwsh", "cmd", "perl", "ruby"]
SHELL_ALLOWED_PORTS = [22, 80, 443]


def is_dns_tunnel(min_len: int = 60) -> Column:
    return (F.col("protocol") == "DNS") & (F.length("dns_query") > min_len)


def is_cleartext_login() -> Column:
    path = F.lit(False)
    for p in CRED_PATHS:
        path = path | F.col("http_path").contains(p)
    return (F.col("protocol") == "HTTP") & (F.col("http_method") == "POST") & path & (F.col("dst_port") != 443)


def is_high_port(min_port: int = 49151, min_bytes: int = 10000) -> Column:
    return (F.col("dst_port") > min_port) & (F.col("protocol") == "TCP") & (F.col("bytes_out") > min_bytes)


def is_shell_process() -> Column:
    return ((F.col("protocol") == "TCP") & F.col("process_name").isin(SHELL_PROCESSES)
            & ~F.col("dst_port").isin(SHELL_ALLOWED_PORTS))


def row_rules() -> dict[str, Column]:
    """The rules that look at one flow at a time."""
    return {"dns_tunnel": is_dns_tunnel(), "cleartext_creds": is_cleartext_login(), "high_port": is_high_port(),
            "shell_process": is_shell_process()}


def rule_dns_tunnel(flows: DataFrame, window_minutes: int = 10, min_len: int = 60, as_of=None) -> DataFrame:
    return _since(flows, window_minutes, as_of).filter(is_dns_tunnel(min_len)).select(
        "src_ip", "hostname", "dns_query", "ts")


def rule_cleartext_creds(flows: DataFrame, window_minutes: int = 15, as_of=None) -> DataFrame:
    return _since(flows, window_minutes, as_of).filter(is_cleartext_login()).select(
        "src_ip", "dst_ip", "dst_port", "http_path", "hostname", "ts")


def rule_high_port(flows: DataFrame, window_minutes: int = 5, min_port: int = 49151,
                   min_bytes: int = 10000, as_of=None) -> DataFrame:
    return _since(flows, window_minutes, as_of).filter(is_high_port(min_port, min_bytes)).select(
        "src_ip", "dst_ip", "dst_port", "protocol", "bytes_out", "hostname", "ts")


def rule_shell_process(flows: DataFrame, window_minutes: int = 5, as_of=None) -> DataFrame:
    return _since(flows, window_minutes, as_of).filter(is_shell_process()).select(
        "process_name", "pid", "src_ip", "dst_ip", "dst_port", "hostname", "ts")


MATCH_SCHEMA = "rule_id string, rule_title string, severity string, match_data string, fired_at timestamp"


def rule_frame(spark: SparkSession, query: str, flows: DataFrame, as_of) -> DataFrame:
    """Plan of one rule: a query over the table name ``flows``, ``:as_of`` bound.

    The text stands inside a subquery, where Spark's grammar takes queries only:
    commands and inserts, also behind a WITH, fail to parse and never run.  The
    name ``flows`` is a common table expression, so no view is made or replaced.
    """
    text = query.strip().rstrip(";").replace("{", "{{").replace("}", "}}")
    return spark.sql(f"WITH flows AS (SELECT * FROM {{rule_flows}}) SELECT * FROM (\n{text}\n) AS rule_query",
                     args={"as_of": as_of}, rule_flows=flows)


def _enabled(rules: DataFrame) -> list:
    from flowlens.operators.latest import latest_by_key
    return (latest_by_key(rules, ["id"], "version").filter(F.col("enabled"))
            .select("id", "title", "severity", "query").orderBy("id").collect())


def rule_errors(spark: SparkSession, rules: DataFrame, flows: DataFrame, as_of) -> DataFrame:
    """(rule_id, rule_title, error): enabled rules that ``run_rules`` skips, and why."""
    rows = []
    for d in _enabled(rules):
        try:
            rule_frame(spark, d["query"], flows, as_of)
        except (ParseException, AnalysisException) as e:
            rows.append((d["id"], d["title"], e.getCondition() or type(e).__name__))
    return spark.createDataFrame(rows, "rule_id string, rule_title string, error string")


def run_rules(spark: SparkSession, rules: DataFrame, flows: DataFrame, as_of, limit: int | None = None) -> DataFrame:
    """Run the enabled custom SQL rules over ``flows``; one match row per result row.

    The loop runs over rule *definitions* (a small table read once on the
    driver); each rule is one plan.  ``match_data`` is the result row as JSON.
    Rules that aren't a query, or that don't resolve, are logged and skipped
    (``rule_errors`` lists them); without a usable rule the result is empty.  ``limit`` keeps that many rows of
    each rule.
    """
    defs = _enabled(rules)
    out = spark.createDataFrame([], MATCH_SCHEMA)
    for d in defs:
        try:
            res = rule_frame(spark, d["query"], flows, as_of)
        except (ParseException, AnalysisException) as e:
            LOG.warning("rule %s is skipped: %s", d["id"], e.getCondition())
            continue
        if limit is not None:
            res = res.limit(limit)
        out = out.unionByName(res.select(
            F.lit(d["id"]).alias("rule_id"), F.lit(d["title"]).alias("rule_title"), F.lit(d["severity"]).alias("severity"),
            F.to_json(F.struct(*[F.col(f"`{c}`") for c in res.columns])).alias("match_data"),
            F.lit(as_of).cast("timestamp").alias("fired_at")))
    return out


def incidents_from_matches(matches: DataFrame) -> DataFrame:
    """Open incident per match: ``[SEV] rule — src → dst``."""
    src = F.coalesce(F.get_json_object("match_data", "$.src_ip"), F.lit(""))
    dst = F.coalesce(F.get_json_object("match_data", "$.dst_ip"), F.lit(""))
    return matches.select(
        F.format_string("[%s] %s — %s → %s", F.upper("severity"), F.col("rule_title"), src, dst).alias("title"),
        "severity", F.lit("open").alias("status"), F.lit("sigma").alias("source"),
        F.col("rule_id").alias("source_id"), F.col("fired_at").alias("created_at"))


# fixed values: status an action sets
ACTION_STATUS = {"create": "open", "ack": "ack", "resolve": "resolved"}


def incident_state(log: DataFrame) -> DataFrame:
    """Current state from an action log (id, action, title, severity, source,
    source_id, note, ref, acted_at, version).

    create sets title, severity, source and source_id and opens the incident, ack
    and resolve set its status; notes of other actions are appended in version
    order as ``\\n[yyyy-MM-dd HH:mm] text``, references of dispatch actions joined
    by ', '.  The texts are one value of an incident by definition; rows reach
    it already cut to (version, text) and only where there is a text.
    """
    status = F.coalesce(*[F.when(F.col("action") == a, F.lit(s)) for a, s in ACTION_STATUS.items()])
    created = F.when(F.col("action") == "create", F.col("version"))

    def at_creation(name: str) -> Column:
        return F.max_by(name, created).alias(name)

    def joined(when: Column, text: Column) -> Column:
        return F.collect_list(F.when(when, F.struct("version", text.alias("text"))))

    has_note = (F.col("action") != "create") & (F.coalesce(F.col("note"), F.lit("")) != "")
    note = F.concat(F.lit("\n["), F.date_format("acted_at", "yyyy-MM-dd HH:mm"), F.lit("] "), F.col("note"))
    has_ref = (F.col("action") == "dispatch") & (F.coalesce(F.col("ref"), F.lit("")) != "")
    agg = log.groupBy("id").agg(
        *[at_creation(c) for c in ("title", "severity", "source", "source_id")],
        F.max_by(status, F.when(status.isNotNull(), F.col("version"))).alias("status"),
        joined(has_note, note).alias("_notes"), joined(has_ref, F.col("ref")).alias("_refs"),
        F.min("acted_at").alias("created_at"), F.max("acted_at").alias("updated_at"), F.max("version").alias("version"))

    def text(c: str, sep: str) -> Column:
        return F.array_join(F.transform(F.array_sort(c), lambda n: n["text"]), sep)

    return (agg.withColumn("notes", text("_notes", "")).withColumn("external_ref", text("_refs", ", "))
            .drop("_notes", "_refs"))


# ---- process policies -------------------------------------------------------

def evaluate_policies(flows: DataFrame, policies: DataFrame) -> DataFrame:
    """Violations: enabled policy, same process name, destination in the policy
    CIDR ('' = any; IPv4 or IPv6) and port equal (0 = any).  An equi-join on the
    process name with the address and port tests as residual; Spark broadcasts
    the policies when it knows them small, else the skew join splits a hot name."""
    p = with_cidr(policies.filter(F.col("enabled")), "dst_ip_cidr", "p_").select(
        F.col("id").alias("policy_id"), F.col("name").alias("policy_name"),
        F.col("process_name").alias("p_process"), "action", F.col("dst_ip_cidr"),
        F.col("dst_port").alias("p_port"), "p_lo", "p_hi",
        (is_v4_key(F.col("p_lo")) & (F.col("p_bits") >= 96)).alias("p_v4"))
    # the plain tests come first: an address key is made only where a policy of the process has a network
    key = ip_key("dst_ip")
    inside = key.between(F.col("p_lo"), F.col("p_hi")) & (is_v4_key(key) == F.col("p_v4"))
    cond = ((F.col("process_name") == F.col("p_process")) & ((F.col("p_port") == 0) | (F.col("dst_port") == F.col("p_port")))
            & F.when(F.col("dst_ip_cidr") == "", F.lit(True)).otherwise(inside))
    return flows.join(p, cond).select(
        "policy_id", "policy_name", "action", F.col("id").alias("flow_id"), "agent_id", "hostname",
        "process_name", "pid", "src_ip", "dst_ip", "dst_port", "protocol", F.col("ts").alias("detected_at"))


# ---- list views ---------------------------------------------------------------

def newest(df: DataFrame, ts_col: str, limit: int | None = None, tie: str | tuple[str, ...] = "id",
           **equals) -> DataFrame:
    """A list view: rows that equal the given parameters (blank ones don't filter).

    With ``limit`` the newest rows, ties by ``tie`` downwards; without, all rows in
    no order."""
    for k, v in equals.items():
        if v not in (None, ""):
            df = df.filter(F.col(k) == v)
    if limit is None:
        return df
    ties = (tie,) if isinstance(tie, str) else tie
    return df.orderBy(F.desc(ts_col), *[F.desc(t) for t in ties if t in df.columns]).limit(limit)


def severity_counts(df: DataFrame, ts_col: str, as_of, hours: int = 24,
                    levels=("critical", "high", "medium", "low")) -> DataFrame:
    """Counts per severity in the last ``hours`` plus the latest event time."""
    f = df.filter(F.col(ts_col) >= as_of - interval(f"{hours} HOURS"))
    return f.agg(F.count(F.lit(1)).alias("total"),
                 *[F.count_if(F.col("severity") == lv).alias(lv) for lv in levels],
                 F.max(ts_col).alias("last_seen"))
