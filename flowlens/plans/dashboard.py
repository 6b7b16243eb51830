"""Dashboards: a JSON widget spec -> one DataFrame per widget.

The spec (a handful of widgets) is configuration and is read on the driver;
each widget becomes a plan over the shared inputs, so a dashboard refresh is
N small Spark jobs over the same (cacheable) flow scan.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.timewin import interval
from flowlens.operators import aggregate as A
from flowlens.operators import detect as D

# fixed values: widget types and stat metrics of the dashboard builder
WIDGET_TYPES = ("stat", "timeseries", "protocol_pie", "top_talkers", "alert_feed", "anomaly_feed")
STAT_METRICS = ("total_flows", "active_agents", "total_bytes", "anomaly_count", "alert_count")


@dataclass
class Inputs:
    flows: DataFrame
    as_of: Column
    agents: DataFrame | None = None
    anomalies: DataFrame | None = None      # with detected_at / window_start and severity
    alert_events: DataFrame | None = None   # with fired_at


def stat_metrics(x: Inputs, anomaly_ts: str = "detected_at") -> DataFrame:
    """All five stat-widget values in one row (one scan per input table)."""
    day = x.as_of - interval("24 HOURS")
    f = x.flows.agg(F.count(F.lit(1)).alias("total_flows"),
                    F.coalesce(F.sum(F.when(F.col("ts") >= day, F.col("bytes_in") + F.col("bytes_out"))),
                               F.lit(0)).cast("bigint").alias("total_bytes"))
    ag = (x.agents.filter(F.col("last_seen") > x.as_of - interval("5 MINUTES"))
          .agg(F.count_distinct("agent_id").alias("active_agents")))
    an = x.anomalies.filter(F.col(anomaly_ts) >= day).agg(F.count(F.lit(1)).alias("anomaly_count"))
    al = x.alert_events.filter(F.col("fired_at") > day).agg(F.count(F.lit(1)).alias("alert_count"))
    return f.crossJoin(ag).crossJoin(an).crossJoin(al)


def _window_hours(w: str) -> int:
    return {"1h": 1, "6h": 6, "24h": 24}.get(w, 1)


def dashboard_widgets(spec: str | list, x: Inputs) -> dict[str, DataFrame]:
    """widget id -> DataFrame for every widget of a JSON spec
    ``[{"id", "type", "config": {...}}, ...]``; unknown types are skipped."""
    widgets = json.loads(spec) if isinstance(spec, str) else spec
    out: dict[str, DataFrame] = {}
    for i, w in enumerate(widgets):
        wid, kind, cfg = w.get("id", f"w{i}"), w.get("type"), w.get("config") or {}
        if kind == "stat":
            metric = cfg.get("metric", "total_flows")
            if metric in STAT_METRICS:
                out[wid] = stat_metrics(x).select(F.lit(metric).alias("metric"), F.col(metric).cast("double").alias("value"))
        elif kind == "timeseries":
            out[wid] = A.timeseries(x.flows, hours=_window_hours(cfg.get("window", "1h")), as_of=x.as_of)
        elif kind == "protocol_pie":
            out[wid] = A.top_protocols(x.flows, k=20, hours=1, as_of=x.as_of)
        elif kind == "top_talkers":
            out[wid] = A.top_talkers(x.flows, window=cfg.get("window", "1h"), by=cfg.get("by", "flows"),
                                     k=int(cfg.get("limit", 10)), as_of=x.as_of)
        elif kind == "alert_feed":
            out[wid] = D.newest(x.alert_events, "fired_at", limit=int(cfg.get("limit", 10)), tie="rule_id")
        elif kind == "anomaly_feed":
            sev = cfg.get("severity", "all")
            a = x.anomalies if sev in (None, "", "all") else x.anomalies.filter(F.col("severity") == sev)
            out[wid] = D.newest(a, "window_start" if "window_start" in a.columns else "detected_at",
                                limit=int(cfg.get("limit", 10)), tie=("agent_id", "protocol"))
    return out
