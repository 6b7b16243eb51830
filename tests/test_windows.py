"""Sliding port scans against a plain count, sketches against exact values, many rules in one scan, learnt baselines."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from flowlens.operators import aggregate as A
from flowlens.operators import detect as D
from flowlens.operators import rulesets as RS
from flowlens.operators import sketches as SK
from flowlens.operators import sweep as SW
from flowlens.plans import q_detect as QD
from flowlens.plans import q_stream as QS
from flowlens.sources import testdata as td
from flowlens.streaming import jobs as J
from flowlens.streaming import learn as L

T0 = dt.datetime(2024, 1, 1)
PROBES = "src_ip string, dst_port int, ts timestamp, protocol string"


def plain_scans(rows, minutes, min_ports):
    w = dt.timedelta(minutes=minutes)
    out = []
    for src in {r[0] for r in rows} - {None}:
        mine = [r for r in rows if r[0] == src and r[3] in ("TCP", "UDP") and r[1] is not None and r[2] is not None]
        for t in sorted({r[2] for r in mine}):
            now = len({r[1] for r in mine if t - w < r[2] <= t})
            before = len({r[1] for r in mine if t - w < r[2] < t})
            if now > min_ports >= before:
                out.append((src, t, now))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_port_scans_match_a_plain_count(spark, seed):
    rng = random.Random(seed)
    # whole half-minutes, so that sightings fall on each other and on the window's edge
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, 3, 4, 5, 6, None]), T0 + dt.timedelta(seconds=30 * rng.randrange(200)),
             rng.choice(["TCP", "UDP", "DNS"])) for _ in range(250)]
    got = SW.port_scans(spark.createDataFrame(rows, PROBES), minutes=5, min_ports=2).collect()
    assert sorted(map(tuple, got), key=repr) == plain_scans(rows, 5, 2)


def test_a_scan_over_the_edge_of_tumbling_windows(spark):
    rows = [("x", p, T0 + dt.timedelta(minutes=3, seconds=p * 2), "TCP") for p in range(1, 101)]
    f = spark.createDataFrame(rows, PROBES)
    tumbling = f.groupBy("src_ip", F.window("ts", "5 minutes")).agg(F.count_distinct("dst_port").alias("n"))
    assert tumbling.filter("n > 60").count() == 0
    (hit,) = SW.port_scans(f, minutes=5, min_ports=60).collect()
    assert (hit["at"], hit["port_count"]) == (rows[60][2], 61)
    assert SW.port_scans(f.limit(0)).count() == 0


def test_sketches_merge_over_any_windows(spark):
    f = td.flows(spark, SMALL)
    by_minute = SK.endpoint_stats_from_sketches(SK.latency_sketches(f, "1 minute"))
    by_day = SK.endpoint_stats_from_sketches(SK.latency_sketches(f, "1 day"))
    exact = {(r["http_method"], r["http_path"]): r for r in A.endpoint_stats(f, window="30d").collect()}
    for table in (by_minute, by_day):
        rows = table.collect()
        assert len(rows) == len(exact)
        for r in rows:
            e = exact[r["http_method"], r["http_path"]]
            assert [r[c] for c in ("total", "success_count", "error_count")] == [e[c] for c in ("total", "success_count", "error_count")]
            assert abs(r["avg_latency"] - e["avg_latency"]) < 1e-9
            # fewer values than the sketch keeps: percentiles are values at their rank
            assert r["p50"] <= e["p50"] + 30 and r["p99"] >= e["p95"] - 30
    assert SK.endpoint_stats_from_sketches(SK.latency_sketches(f.limit(0))).count() == 0


def test_quantile_rank_error_on_many_values(spark):
    df = spark.range(200_000).select((F.col("id") % 50_000).alias("duration_ms"), F.lit("HTTP").alias("protocol"), F.lit("GET").alias("http_method"),
                                     F.lit("/").alias("http_path"), F.lit(200).alias("http_status"),
                                     (F.lit(T0) + F.make_dt_interval(mins=(F.col("id") % 500).cast("int"))).alias("ts"))
    (r,) = SK.endpoint_stats_from_sketches(SK.latency_sketches(df)).collect()
    for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        assert abs(r[name] / 50_000 - p) < 0.01


def test_distinct_sketches_stay_in_their_error(spark):
    df = spark.range(300_000).select(F.lit("s").alias("src_ip"), (F.col("id") % 60_000).cast("string").alias("dst_ip"), F.lit(1).alias("bytes_out"),
                                     F.lit(2).alias("bytes_in"), (F.lit(T0) + F.make_dt_interval(mins=(F.col("id") % 5000).cast("int"))).alias("ts"))
    (r,) = SK.distinct_from_sketches(SK.distinct_sketches(df, ["src_ip"], "dst_ip"), ["src_ip"]).collect()
    assert abs(r["distinct_values"] / 60_000 - 1) < 0.04 and (r["flow_count"], r["bytes_in"]) == (300_000, 600_000)
    half = SK.set_sketches(df, "dst_ip")
    mid = F.lit(T0 + dt.timedelta(hours=40))
    (b,) = SK.seen_in_both(half, F.col("bucket") < mid, F.col("bucket") >= mid).collect()
    exact = [df.filter(c).select("dst_ip").distinct() for c in (F.col("ts") < mid, F.col("ts") >= mid)]
    assert abs(b["earlier"] / exact[0].count() - 1) < 0.08 and abs(b["in_either"] / 60_000 - 1) < 0.08
    assert abs(b["in_both"] - exact[0].intersect(exact[1]).count()) < 0.1 * 60_000
    (none,) = SK.seen_in_both(half.limit(0), F.col("bucket") < mid, F.col("bucket") >= mid).collect()
    assert tuple(none) == (0, 0, 0, 0)


def test_many_rules_scan_once(spark, tmp_path):
    path = str(tmp_path / "flows")
    td.flows(spark, SMALL).write.parquet(path)
    f = spark.read.parquet(path)
    as_of = f.agg(F.max("ts")).first()[0]
    matches, errors = RS.run_row_rules(f, spark.createDataFrame(QD.ROW_SET, RS.ROW_RULES), as_of)
    plan = matches._jdf.queryExecution().executedPlan().toString()
    assert len(QD.ROW_SET) == 50 and plan.count("FileScan parquet") == 1
    assert [tuple(r) for r in errors.collect()] == [("broken", "UNRESOLVED_COLUMN.WITH_SUGGESTION")]
    one = matches.select("rule_id", "rule_title", "severity", "match_data", "fired_at")
    as_queries = [(i, t, s, "[]", f"SELECT {', '.join(c)} FROM flows WHERE ({w}) AND ts > :as_of - INTERVAL {m} MINUTES", True, 1)
                  for i, t, s, w, m, c in QD.ROW_SET]
    each = D.run_rules(spark, spark.createDataFrame(as_queries, QD.CUSTOM_SCHEMA), f, as_of)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, each.collect()))


def test_group_rules_report_what_they_cannot_run(spark):
    f = td.flows(spark, SMALL)
    bad = [("x", "x", "low", "true", 5, ["no_such"], "flows", 1.0), ("y", "y", "low", "1 +", 5, ["src_ip"], "flows", 1.0),
           ("z", "z", "low", "true", 5, ["src_ip"], "median bytes_in", 1.0)]
    m, errors = RS.run_group_rules(f, spark.createDataFrame(bad, RS.GROUP_RULES))
    assert m.count() == 0 and sorted(r["rule_id"] for r in errors.collect()) == ["x", "y", "z"]


def test_moments_merge_as_one_set(spark):
    rows = [("a", "TCP", T0 + dt.timedelta(hours=h, days=7 * w), 1 + (h * 7 + w * 3) % 11, 10 * h, w) for h in range(30) for w in range(4)]
    schema = "agent_id string, protocol string, hour timestamp, flow_count long, bytes_in long, bytes_out long"
    whole = L.baselines_of(L.moments_of(spark.createDataFrame(rows, schema)))
    parts = L.merged(L.moments_of(spark.createDataFrame(rows[:50], schema)), L.moments_of(spark.createDataFrame(rows[50:], schema)))
    want = {tuple(r)[:3]: tuple(r)[3:] for r in whole.collect()}
    got = {tuple(r)[:3]: tuple(r)[3:] for r in L.baselines_of(parts).collect()}
    assert want.keys() == got.keys()
    assert all(abs(a - b) < 1e-9 for k in want for a, b in zip(want[k], got[k]))


def test_a_batch_is_tested_against_the_version_before_it(spark):
    hour = dt.timedelta(hours=1)
    week = dt.timedelta(days=7)
    # three quiet weeks of an hour, then one of four hundred flows in twenty minutes; a file a week
    rows = [(f"{w}-{i}-{k}", "a1", "h", "TCP", T0 + w * week + i * hour + dt.timedelta(seconds=(3 if (w, i) == (3, 1) else 720) * k), 1, 1)
            for w in range(4) for i in range(3) for k in range(400 if (w, i) == (3, 1) else 5)]
    f = spark.createDataFrame(rows, "id string, agent_id string, hostname string, protocol string, ts timestamp, bytes_in long, bytes_out long")
    name = f"learn_{uuid.uuid4().hex[:8]}"
    stream = QS.file_stream(spark, f, "ts", name)
    path, events = J.stream_folder(spark, name, "baselines"), J.stream_folder(spark, name, "events")
    L.stream_learn(stream, path, events, trigger={"availableNow": True}, name=name).awaitTermination()
    seen = spark.read.parquet(events).collect()
    assert {r["window_start"].replace(minute=0) for r in seen} == {T0 + 3 * week + hour}
    assert all(r["baseline_epoch"] < r["epoch"] and r["anomaly_type"] == "spike" for r in seen)
    # two versions are kept, and the hour of the spike is learnt with the others
    assert len({r["epoch"] for r in spark.read.parquet(f"{path}/open").select("epoch").distinct().collect()}) <= 2
    by = {r["hour_of_week"]: r for r in L.learned_baselines(spark, path).collect()}
    assert by[1]["sample_count"] == 4 and by[1]["flow_count_mean"] == (5 * 3 + 400) / 4
