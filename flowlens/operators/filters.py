"""Flow search / audit filters and paging.

Filters are plain ``filter`` calls, so Catalyst pushes the equality and ts
bounds into the Parquet scan (``PushedFilters``) and prunes row groups via
min/max statistics of a ts-sorted table.  Parameter parsing (timestamps,
CIDRs, saved-query JSON) happens on the driver because it is configuration,
never data.
"""

from __future__ import annotations

import datetime as dt
import ipaddress
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.ip import cidr_match, is_external
from flowlens.operators.aggregate import positive
from flowlens.functions.timewin import as_of_col, interval, since

LIST_COLUMNS = ["id", "agent_id", "hostname", "ts", "protocol", "src_ip", "src_port", "dst_ip",
                "dst_port", "bytes_in", "bytes_out", "duration_ms", "info", "http_method",
                "http_path", "http_status", "dns_query", "dns_type", "process_name", "pid",
                "pod_name", "k8s_namespace", "threat_score", "threat_level", "trace_id"]


def parse_time(text: str | None) -> dt.datetime | None:
    """RFC3339 or 'yyyy-MM-ddTHH:mm' (browser datetime-local); unparsable -> None."""
    if not text:
        return None
    for fmt in ("%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%dT%H:%M"):
        try:
            t = dt.datetime.strptime(text.replace("Z", "+00:00"), fmt)
        except ValueError:
            continue
        if t.tzinfo is not None:
            t = t.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return t
    return None


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("ts"), F.desc("id"))


def query_flows(flows: DataFrame, protocol: str = "", src_ip: str = "", dst_ip: str = "",
                hostname: str = "", trace_id: str = "", from_: str | None = None,
                to: str | None = None, limit: int = 100, offset: int = 0,
                columns: list[str] | None = LIST_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """(page of ``limit`` rows newest first, total count)."""
    f = flows
    for col, val in (("protocol", protocol), ("src_ip", src_ip), ("dst_ip", dst_ip),
                     ("hostname", hostname), ("trace_id", trace_id)):
        if val:
            f = f.filter(F.col(col) == val)
    lo, hi = parse_time(from_), parse_time(to)
    if lo is not None:
        f = f.filter(F.col("ts") >= F.lit(lo))
    if hi is not None:
        f = f.filter(F.col("ts") <= F.lit(hi))
    total = f.agg(F.count(F.lit(1)).alias("total"))
    page = newest_first(f.select(*columns) if columns else f)
    if offset:
        page = page.offset(offset)
    return page.limit(positive("limit", limit)), total


def _ip_filter(col: str, value: str) -> Column:
    if "/" in value:
        ipaddress.ip_network(value, strict=False)  # validate parameter
        return cidr_match(col, [value])
    return F.col(col) == value


def search_flows(flows: DataFrame, protocol: str | None = None, src_ip: str | None = None,
                 dst_ip: str | None = None, port: int | None = None, country: str | None = None,
                 threat_level: str | None = None, agent_id: str | None = None,
                 hours: int | None = None, as_of=None, limit: int | None = 200,
                 offset: int = 0) -> DataFrame:
    """SDK filter set: exact or CIDR ips, port on either side, country, level, agent."""
    f = flows
    if protocol:
        f = f.filter(F.col("protocol") == protocol)
    if src_ip:
        f = f.filter(_ip_filter("src_ip", src_ip))
    if dst_ip:
        f = f.filter(_ip_filter("dst_ip", dst_ip))
    if port is not None:
        f = f.filter((F.col("src_port") == port) | (F.col("dst_port") == port))
    if country:
        f = f.filter(F.col("country_code") == country)
    if threat_level:
        f = f.filter(F.col("threat_level") == threat_level)
    if agent_id:
        f = f.filter(F.col("agent_id") == agent_id)
    if hours is not None:
        f = f.filter(F.col("ts") >= as_of_col(flows, as_of) - interval(f"{int(hours)} HOURS"))
    page = newest_first(f)
    if offset:
        page = page.offset(offset)
    return page.limit(positive("limit", limit)) if limit is not None else page


def page_after(df: DataFrame, cursor_ts, cursor_id: str, n: int) -> DataFrame:
    """Keyset paging (newest first): rows strictly after the (ts, id) cursor.

    Unlike OFFSET this does not re-sort and skip the earlier pages, so deep
    pages cost the same as the first one.
    """
    ts = F.lit(cursor_ts).cast("timestamp")
    after = (F.col("ts") < ts) | ((F.col("ts") == ts) & (F.col("id") < cursor_id))
    return newest_first(df.filter(after)).limit(n)


def connection_audit(flows: DataFrame, window: str = "24h", as_of=None, src_ip: str = "",
                     dst_ip: str = "", protocol: str = "", external_only: bool = False,
                     limit: int | None = None) -> DataFrame:
    """Audit list with ``is_external``, newest first where ``limit`` keeps a page;
    external_only is applied before it."""
    f = since(flows, window, as_of)
    for col, val in (("src_ip", src_ip), ("dst_ip", dst_ip), ("protocol", protocol)):
        if val:
            f = f.filter(F.col(col) == val)
    f = f.select("id", "agent_id", "hostname", "ts", "protocol", "src_ip", "src_port", "dst_ip",
                 "dst_port", "bytes_in", "bytes_out", "duration_ms", "info", "process_name", "pid",
                 is_external("dst_ip").alias("is_external"))
    if external_only:
        f = f.filter("is_external")
    return newest_first(f).limit(positive("limit", limit)) if limit is not None else f


# fixed values: named quick filters of the capture view
QUICK_FILTERS = ("http", "dns", "tls", "errors", "threats", "hub")


def quick_filter(flows: DataFrame, text: str) -> DataFrame:
    """Named filter (http/dns/tls/errors/threats/hub) or case-insensitive substring search."""
    if not text.strip():
        return flows
    q = text.lower()
    proto = F.lower(F.col("protocol"))
    if q == "http":
        return flows.filter(proto.startswith("http"))
    if q == "dns":
        return flows.filter(proto == "dns")
    if q == "tls":
        return flows.filter(proto == "tls")
    if q == "errors":
        return flows.filter(F.coalesce(F.col("http_status"), F.lit(0)) >= 400)
    if q == "threats":
        return flows.filter(F.col("threat_score") > 0)
    if q == "hub":
        return flows.filter(F.col("source") == "hub")
    cond = (F.col("src_ip").contains(q) | F.col("dst_ip").contains(q) | proto.contains(q)
            | F.lower(F.col("info")).contains(q)
            | F.col("src_port").cast("string").contains(q)
            | F.col("dst_port").cast("string").contains(q)
            | F.lower(F.col("country_name")).contains(q) | F.lower(F.col("as_org")).contains(q))
    return flows.filter(cond)


# fixed values: filter keys a saved query may carry
SAVED_QUERY_KEYS = ("protocol", "src_ip", "dst_ip", "hostname", "trace_id", "from", "to")


def apply_saved_query(flows: DataFrame, saved_queries: DataFrame, query_id: str,
                      limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Run the latest non-deleted version of a saved query.

    The saved-query table is a version log; its latest row per id is picked
    in Spark, then the one definition (a small JSON object) is read on the
    driver and turned into filters.
    """
    from flowlens.operators.latest import latest_by_key
    latest = latest_by_key(saved_queries, ["id"], "version")
    row = latest.filter((F.col("id") == query_id) & ~F.coalesce(F.col("deleted"), F.lit(False))) \
                .select("filters").first()
    if row is None:
        raise KeyError(f"saved query {query_id!r} not found")
    spec = json.loads(row["filters"] or "{}")
    kw = {k: str(spec[k]) for k in SAVED_QUERY_KEYS if spec.get(k)}
    if "from" in kw:
        kw["from_"] = kw.pop("from")
    return query_flows(flows, limit=limit, **kw)
