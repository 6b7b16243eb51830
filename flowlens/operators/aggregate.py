"""Dashboard / analytics aggregations over the flat ``flows`` table.

All operators are single-scan group-bys: Spark does a map-side partial
aggregate, so the shuffle carries one row per (task, group), not per flow, and
a hot key (one src_ip with a third of the rows) costs no more than a cold one.
Top-k uses ``orderBy(...).limit(k)``, which plans as TakeOrderedAndProject
(per-partition top-k, then merge) instead of a global sort.  Every order has a
full tie-break so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.ip import is_external_like
from flowlens.functions.timewin import as_of_col, interval, since, window_interval
from flowlens.session import ensure_checkpoint_dir


def _top(df: DataFrame, k: int | None, *order: Column) -> DataFrame:
    out = df.orderBy(*order)
    return out.limit(positive("k", k)) if k is not None else out


def positive(name: str, value: int) -> int:
    """A count parameter as given; anything below one is an error, nothing is clamped."""
    if int(value) < 1:
        raise ValueError(f"{name} must be at least 1, not {value}")
    return int(value)


def smallest_values(df: DataFrame, keys: list[str], value: str, n: int | None, out: str) -> DataFrame:
    """(keys, out): the ``n`` smallest distinct values of each key, nulls left out; all values without ``n``.

    Values are made distinct first, so a hot key is spread over its values; the
    rank limit then runs before the shuffle, and an array holds ``n`` at most.
    """
    v = df.filter(F.col(value).isNotNull()).select(*keys, value).distinct()
    if n is not None:
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
        v = v.withColumn("_nth", nth).filter(F.col("_nth") <= n)
    return v.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(out))


def endpoint_stats(flows: DataFrame, window: str = "1h", as_of=None, k: int | None = None,
                   exact: bool = True) -> DataFrame:
    """Per (method, path) of HTTP/HTTPS flows: counts, error rate, latency percentiles.

    ``exact`` percentiles are interpolated between ranks.  The flows are read once,
    as counts of (endpoint, latency), and the ranks come from running sums over these,
    so a hot endpoint costs its distinct latencies and can spill.  Otherwise they
    are off by at most a ten-thousandth of the ranks, from summaries of fixed size.
    """
    f = since(flows, window, as_of).filter(
        F.col("protocol").isin("HTTP", "HTTPS") & (F.col("http_method") != "")
        & (F.col("http_path") != ""))
    keys, points = ["http_method", "http_path"], {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    ok, error = (F.col("http_status") >= 200) & (F.col("http_status") < 400), F.col("http_status") >= 400
    if exact:
        c = f.groupBy(*keys, F.col("duration_ms").alias("_v")).agg(
            F.count(F.lit(1)).alias("_n"), F.count_if(ok).alias("_ok"), F.count_if(error).alias("_error"))
        timed = F.when(F.col("_v").isNotNull(), F.col("_n")).otherwise(0)
        up_to = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        c = c.withColumn("_timed", timed)
        c = c.withColumn("_upto", F.sum("_timed").over(up_to)).withColumn("_all", F.sum("_timed").over(Window.partitionBy(*keys)))
        parts = []
        for name, point in points.items():
            at = F.lit(point) * (F.col("_all") - 1)
            parts += [F.max(at).alias(f"_{name}"),
                      F.min(F.when(F.col("_upto") > F.floor(at), F.col("_v"))).alias(f"_{name}_lo"),
                      F.min(F.when(F.col("_upto") > F.ceil(at), F.col("_v"))).alias(f"_{name}_hi")]
        agg = c.groupBy(*keys).agg(
            F.sum("_n").alias("total"), F.sum("_ok").alias("success_count"), F.sum("_error").alias("error_count"),
            (F.sum(F.col("_v") * F.col("_timed")) / F.nullif(F.sum("_timed"), F.lit(0))).cast("double").alias("avg_latency"), *parts)
        for name in points:
            lo, hi, share = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), F.col(f"_{name}") - F.floor(f"_{name}")
            agg = agg.withColumn(name, (lo + (hi - lo) * share).cast("double"))
    else:
        agg = f.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("success_count"), F.count_if(error).alias("error_count"),
            F.avg("duration_ms").alias("avg_latency"),
            *[F.percentile_approx("duration_ms", p, 10000).cast("double").alias(n) for n, p in points.items()])
    agg = agg.withColumn("error_rate", F.col("error_count") / F.col("total") * 100.0)
    return _top(agg, k, F.desc("total"), "http_method", "http_path").select(
        "http_method", "http_path", "total", "success_count", "error_count", "error_rate",
        "avg_latency", "p50", "p95", "p99")


def endpoint_summary(endpoints: DataFrame) -> DataFrame:
    """Page header over all of ``endpoint_stats`` (taken before any top-k): totals, mean
    error rate, count-weighted latency.

    Also returns the unweighted means used by the desktop pane.
    """
    return endpoints.agg(
        F.sum("total").alias("total_requests"),
        F.sum("error_count").alias("total_errors"),
        F.avg("error_rate").alias("avg_error_rate"),
        (F.sum(F.col("avg_latency") * F.col("total")) / F.sum("total")).alias("weighted_avg_latency"),
        F.avg("p95").alias("mean_p95"),
        F.count(F.lit(1)).alias("endpoints"))


def nearest_rank_percentiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """(keys, one column per point): the value at rank ceil(p * n) of each group.

    Rows are counted per (group, value) first; the running count over a group's
    distinct values is what the ranks are read from, so a group's size in rows
    doesn't matter.
    """
    c = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    up_to = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumn("_upto", F.sum("_n").over(up_to)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    at = {n: F.greatest(F.ceil(F.col("_all") * F.lit(p)), F.lit(1)) for n, p in points.items()}
    return c.groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") >= r, F.col(value))).cast("double").alias(n)
                                  for n, r in at.items()])


def endpoint_stats_nearest_rank(flows: DataFrame, latency: str = "duration_ms") -> DataFrame:
    """Desktop variant: per host+method+path, host falls back to dst_ip;
    nearest-rank percentiles (index ceil(p*n)-1); null latency only excluded
    from the percentiles."""
    keys = ["host", "http_method", "http_path"]
    f = flows.filter(F.col("http_method") != "").withColumn(
        "host", F.coalesce(F.nullif(F.col("hostname"), F.lit("")), F.col("dst_ip")))
    counts = f.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.count_if(F.col("http_status") >= 400).alias("errors"),
        F.avg(latency).alias("avg_latency"))
    ranks = nearest_rank_percentiles(f, keys, latency, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return counts.join(ranks, keys, "left").select(*keys, "count", "errors", "p50", "p95", "p99", "avg_latency")


def traffic_stats(flows: DataFrame, agents: DataFrame | None = None, as_of=None,
                  online_minutes: int = 5) -> DataFrame:
    """Total flows, flows in the last 60 s, active agents — one scan of each table."""
    now = as_of_col(flows, as_of)
    out = flows.agg(F.count(F.lit(1)).alias("total_flows"),
                    F.count_if(F.col("ts") > now - interval("60 SECONDS")).alias("flows_per_minute"))
    src = agents if agents is not None else flows.withColumnRenamed("ts", "last_seen")
    active = src.filter(F.col("last_seen") > now - interval(f"{online_minutes} MINUTES")).agg(
        F.count_distinct("agent_id").alias("active_agents"))
    return out.crossJoin(active)  # 1 row x 1 row


def top_protocols(flows: DataFrame, k: int = 5, hours: int | None = None, as_of=None) -> DataFrame:
    """Flow count per protocol, with share %, over the last ``hours`` or all rows."""
    f = flows
    if hours is not None:
        h = positive("hours", hours)
        f = f.filter(F.col("ts") >= as_of_col(flows, as_of) - interval(f"{h} HOURS"))
    agg = f.groupBy("protocol").agg(F.count(F.lit(1)).alias("cnt"))
    total = agg.agg(F.sum("cnt").alias("all_cnt"))
    agg = agg.crossJoin(total).withColumn("share_pct", F.col("cnt") * 100.0 / F.col("all_cnt")).drop("all_cnt")
    return _top(agg, k, F.desc("cnt"), "protocol")


def top_sources(flows: DataFrame, k: int = 5) -> DataFrame:
    agg = flows.groupBy("src_ip").agg(F.count(F.lit(1)).alias("cnt"))
    return _top(agg, k, F.desc("cnt"), "src_ip")


def top_talkers(flows: DataFrame, window: str = "1h", by: str = "flows", k: int = 10,
                as_of=None) -> DataFrame:
    """Dashboard top talkers: window in {1h,6h,24h,7d} (else 1h), strict ``ts >``,
    by flows|bytes, the first ``k``."""
    iv = {"6h": "6 HOURS", "24h": "24 HOURS", "7d": "7 DAYS"}.get(window, "1 HOUR")
    f = flows.filter(F.col("ts") > as_of_col(flows, as_of) - interval(iv))
    agg = f.groupBy("src_ip").agg(F.count(F.lit(1)).alias("flow_count"),
                                  F.sum(F.col("bytes_in") + F.col("bytes_out")).alias("total_bytes"))
    key = "total_bytes" if by == "bytes" else "flow_count"
    return _top(agg, k, F.desc(key), "src_ip")


def exfil_talkers(flows: DataFrame, window: str = "24h", as_of=None, k: int = 20,
                  approx: bool = False) -> DataFrame:
    """Hosts by outbound bytes with exact distinct destinations.

    The exact distinct count is planned by Spark as a two-level aggregate
    (group by (src, dst) first), so a hot src_ip is spread over many tasks.
    """
    f = since(flows, window, as_of)
    distinct = F.approx_count_distinct("dst_ip") if approx else F.count_distinct("dst_ip")
    agg = f.groupBy("src_ip").agg(
        F.min("hostname").alias("hostname"),
        F.sum("bytes_out").alias("bytes_out"),
        F.sum("bytes_in").alias("bytes_in"),
        F.count(F.lit(1)).alias("flow_count"),
        distinct.alias("unique_destinations"))
    return _top(agg, k, F.desc("bytes_out"), "src_ip")


def timeseries(flows: DataFrame, hours: int = 1, as_of=None, fill: bool = False) -> DataFrame:
    """Per-minute count and bytes for the last ``hours``; ``fill`` adds empty minutes."""
    h = positive("hours", hours)
    now = as_of_col(flows, as_of)
    f = flows.filter(F.col("ts") >= now - interval(f"{h} HOURS"))
    agg = f.groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("bytes_in").alias("bytes_in"),
        F.sum("bytes_out").alias("bytes_out"))
    if fill:
        span = f.agg(F.date_trunc("minute", F.min("ts")).alias("lo"),
                     F.date_trunc("minute", F.max("ts")).alias("hi"))
        grid = span.select(F.explode(F.sequence("lo", "hi", interval("1 MINUTE"))).alias("minute"))
        agg = grid.join(agg, "minute", "left").fillna(0, ["cnt", "bytes_in", "bytes_out"])
    return agg.orderBy("minute")


def service_edges(flows: DataFrame, window: str = "1h", as_of=None, k: int | None = 300) -> DataFrame:
    f = since(flows, window, as_of)
    agg = f.groupBy("src_ip", "dst_ip", "protocol").agg(
        F.count(F.lit(1)).alias("flow_count"),
        F.avg("duration_ms").alias("avg_latency_ms"),
        F.sum(F.col("bytes_in") + F.col("bytes_out")).alias("bytes_total"))
    return _top(agg, k, F.desc("flow_count"), "src_ip", "dst_ip", "protocol")


def service_nodes(edges: DataFrame) -> DataFrame:
    """Per ip: sum of counts of the kept edges it touches (self-edges count twice)."""
    ends = edges.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip"), "flow_count")
    return ends.filter(F.col("ip") != "").groupBy("ip").agg(
        F.sum("flow_count").alias("flow_count"))


def service_map_nodes(flows: DataFrame) -> DataFrame:
    """Desktop service map: per endpoint ip, bytes, flows, protocol set and the
    first-seen non-blank country and AS organisation (of the destination side)."""
    src = flows.select(F.col("src_ip").alias("ip"), "ts", "protocol",
                       (F.col("bytes_in") + F.col("bytes_out")).alias("bytes"),
                       F.lit("").alias("country_code"), F.lit("").alias("as_org"))
    dst = flows.select(F.col("dst_ip").alias("ip"), "ts", "protocol",
                       (F.col("bytes_in") + F.col("bytes_out")).alias("bytes"),
                       "country_code", "as_org")
    both = src.unionByName(dst).filter(F.col("ip") != "")
    known, org = F.col("country_code") != "", F.col("as_org") != ""
    return both.groupBy("ip").agg(
        F.count(F.lit(1)).alias("flows"), F.sum("bytes").alias("bytes"),
        F.array_join(F.array_sort(F.collect_set("protocol")), ",").alias("protocols"),
        F.min_by(F.when(known, F.col("country_code")), F.when(known, F.struct("ts", "country_code"))).alias("country_code"),
        F.min_by(F.when(org, F.col("as_org")), F.when(org, F.struct("ts", "as_org"))).alias("as_org"))


def external_destinations(flows: DataFrame, window: str = "24h", as_of=None, k: int = 100,
                          max_sources: int = 5) -> DataFrame:
    """Per public-looking dst (reference LIKE test): port/protocol of the latest
    flow, flows, bytes out, last seen and up to 5 sources (smallest first)."""
    f = since(flows, window, as_of).filter(is_external_like("dst_ip") & (F.col("dst_ip") != "::1"))
    # the flows are read once: rows of (destination, source) hold the totals and the sources
    ensure_checkpoint_dir(flows.sparkSession)
    pair = f.groupBy("dst_ip", "src_ip").agg(
        F.max(F.struct("ts", "id", "dst_port", "protocol")).alias("last"),
        F.count(F.lit(1)).alias("flow_count"), F.sum("bytes_out").alias("bytes_out")).checkpoint()
    agg = pair.groupBy("dst_ip").agg(F.max("last").alias("last"), F.sum("flow_count").alias("flow_count"),
                                     F.sum("bytes_out").alias("bytes_out"))
    agg = agg.select("dst_ip", "last.dst_port", "last.protocol", "flow_count", "bytes_out", F.col("last.ts").alias("last_seen"))
    top = _top(agg, k, F.desc("bytes_out"), "dst_ip")
    sources = smallest_values(pair.join(top.select("dst_ip"), "dst_ip", "left_semi"), ["dst_ip"], "src_ip", max_sources, "src_ips")
    return top.join(sources, "dst_ip", "left").withColumn("src_ips", F.coalesce("src_ips", F.array().cast("array<string>")))


def geo_summary(flows: DataFrame, window: str = "24h", as_of=None, k: int = 50) -> DataFrame:
    f = since(flows, window, as_of).filter(F.col("country_code") != "")
    agg = f.groupBy("country_code").agg(
        F.max("country_name").alias("country_name"),
        F.count(F.lit(1)).alias("connections"),
        F.sum("bytes_out").alias("bytes_out"),
        F.count_distinct("src_ip").alias("unique_sources"),
        F.max("threat_score").alias("max_threat_score"))
    return _top(agg, k, F.desc("connections"), "country_code")


def compliance_summary(flows: DataFrame, certs: DataFrame, window: str = "24h",
                       as_of=None) -> DataFrame:
    """Total connections, public-looking sources and their share, expired certs."""
    f = since(flows, window, as_of)
    a = f.agg(F.count(F.lit(1)).alias("total_connections"),
              F.count_if(is_external_like("src_ip")).alias("external_connections"))
    a = a.withColumn("external_pct", F.when(F.col("total_connections") > 0,
                                            F.col("external_connections") * 100.0 / F.col("total_connections"))
                     .otherwise(F.lit(0.0)))
    c = certs.agg(F.count_if(F.col("expired")).alias("tls_issues"))
    return a.crossJoin(c)


def threat_summary(flows: DataFrame, window: str = "24h", as_of=None, k: int = 50,
                   max_processes: int = 10) -> tuple[DataFrame, DataFrame]:
    """(per-dst threats top-k, level counts over *all* threatening dsts)."""
    f = since(flows, window, as_of).filter(F.col("threat_score") > 0)
    # the flows are read once: rows of (destination, process) hold the totals and the names
    ensure_checkpoint_dir(flows.sparkSession)
    when = F.struct("ts", "id")
    pair = f.groupBy("dst_ip", "process_name").agg(
        F.max(F.struct("threat_score", "ts", "id", "threat_level")).alias("worst"),
        F.max_by(F.struct("ts", "id", "country_code", "country_name", "as_org"), when).alias("last"),
        F.count(F.lit(1)).alias("flow_count"), F.max("ts").alias("last_seen")).checkpoint()
    per = pair.groupBy("dst_ip").agg(
        F.max("worst").alias("worst"), F.max_by("last", F.struct("last.ts", "last.id")).alias("last"),
        F.sum("flow_count").alias("flow_count"), F.max("last_seen").alias("last_seen"))
    per = per.select("dst_ip", F.col("worst.threat_score").alias("score"), F.col("worst.threat_level").alias("level"),
                     "last.country_code", "last.country_name", "last.as_org", "flow_count", "last_seen")
    top = _top(per, k, F.desc("score"), F.desc("flow_count"), "dst_ip")
    named = pair.filter(F.col("process_name") != "").join(top.select("dst_ip"), "dst_ip", "left_semi")
    processes = smallest_values(named, ["dst_ip"], "process_name", max_processes, "processes")
    top = top.join(processes, "dst_ip", "left").withColumn(
        "processes", F.coalesce("processes", F.array().cast("array<string>")))
    counts = per.agg(F.count(F.lit(1)).alias("total"),
                     F.count_if(F.col("level") == "high").alias("high"),
                     F.count_if(F.col("level") == "medium").alias("medium"),
                     F.count_if(F.col("level") == "low").alias("low"))
    return top, counts


def threat_offenders(flows: DataFrame, min_hits: int = 3, max_samples: int = 5) -> DataFrame:
    """SDK hunt: high-level flows per src -> hits, distinct dsts, priority P1/P2/P3."""
    # read once, as rows of (source, destination); protocols are a handful of names
    ensure_checkpoint_dir(flows.sparkSession)
    pair = flows.filter(F.col("threat_level") == "high").groupBy("src_ip", "dst_ip").agg(
        F.count(F.lit(1)).alias("hits"), F.collect_set("protocol").alias("protocols"),
        F.sum(F.col("bytes_in") + F.col("bytes_out")).alias("total_bytes")).checkpoint()
    known = pair.groupBy("src_ip").agg(
        F.sum("hits").alias("hits"), F.count("dst_ip").alias("distinct_dsts"),
        F.sum("total_bytes").alias("total_bytes")).filter(F.col("hits") >= min_hits)
    protocols = smallest_values(pair.select("src_ip", F.explode("protocols").alias("protocol")), ["src_ip"], "protocol",
                                None, "protocols")
    samples = smallest_values(pair, ["src_ip"], "dst_ip", max_samples, "sample_dsts")
    agg = (known.join(protocols, "src_ip", "left").join(samples, "src_ip", "left")
           .withColumn("protocols", F.coalesce("protocols", F.array().cast("array<string>"))))
    return agg.withColumn("priority", F.when(F.col("hits") >= 20, "P1")
                          .when(F.col("hits") >= 10, "P2").otherwise("P3"))


def digest(flows: DataFrame, alert_events: DataFrame | None, period: str = "daily",
           as_of=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Daily/weekly report: (headline counts, top-5 sources by bytes, top-6 protocols)."""
    iv = "7 DAYS" if period == "weekly" else "24 HOURS"
    now = as_of_col(flows, as_of)
    f = flows.filter(F.col("ts") >= now - interval(iv))
    head = f.agg(F.count(F.lit(1)).alias("flows"), F.count_distinct("agent_id").alias("active_agents"))
    if alert_events is not None:
        alerts = alert_events.filter(F.col("fired_at") >= now - interval(iv)).agg(
            F.count(F.lit(1)).alias("alerts"))
    else:
        alerts = flows.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("alerts"))
    head = head.crossJoin(alerts)
    talkers = _top(f.groupBy("src_ip").agg(F.sum(F.col("bytes_in") + F.col("bytes_out")).alias("bytes")),
                   5, F.desc("bytes"), "src_ip")
    protos = _top(f.groupBy("protocol").agg(F.count(F.lit(1)).alias("flows")), 6,
                  F.desc("flows"), "protocol")
    return head, talkers, protos
