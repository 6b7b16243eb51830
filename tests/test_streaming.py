"""Streaming jobs agree with their batch operators on the same input."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SMALL
from flowlens.operators import detect as D
from flowlens.plans import q_detect as QD
from flowlens.plans import q_stream as QS
from flowlens.schema import conform_flows
from flowlens.sources import testdata as td
from flowlens.streaming import jobs as J
from flowlens.streaming import state as ST


def test_sources_make_several_batches(spark):
    name = QS.fresh("batches")
    stream = QS.flow_stream(spark, SMALL, name)
    q = J.append_to(stream.select("id"), J.stream_folder(spark, name, "out"), name, {"availableNow": True})
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == QS.FILES


def test_a_flow_may_match_two_rules(spark):
    row = [("f1", "TCP", "bash", 50000, 20000, dt.datetime(2024, 1, 1)), ("f2", "TCP", "bash", 22, 20000, dt.datetime(2024, 1, 1))]
    f = conform_flows(spark.createDataFrame(row, "id string, protocol string, process_name string, dst_port int, bytes_out long, ts timestamp"))
    name = f"two_{uuid.uuid4().hex[:8]}"
    stream = QS.file_stream(spark, f, "ts", name)
    out = J.stream_folder(spark, name, "out")
    J.append_to(J.stream_rules(stream).select("id", "rule"), out, name, {"availableNow": True}).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [("f1", "high_port"), ("f1", "shell_process")]


def test_late_rows_are_left_out_of_closed_windows(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 10, 0)
    # the fourth file comes an hour late; a batch drops what the watermark before it had passed
    for minutes in (0, 60, 65, 1, 120):
        rows = [("a", t + dt.timedelta(minutes=minutes))]
        conform_flows(spark.createDataFrame(rows, "id string, ts timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"late_{uuid.uuid4().hex[:8]}"
    J.append_to(J.stream_timeseries(stream), str(tmp_path / "out"), name, {"availableNow": True}).awaitTermination()
    got = sorted(r["minute"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [t + dt.timedelta(minutes=m) for m in (0, 60, 65)]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n long, s string")
    for _ in range(2):
        J.write_epoch(df, str(tmp_path / "t"), 7)
    J.write_epoch(df.limit(1), str(tmp_path / "t"), 8)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    assert J.stored(spark, str(tmp_path / "none")) is None


def test_alerts_respect_the_cooldown_across_batches(spark):
    got = E.queries()["stream_alerts"](spark, SMALL).collect()
    minutes = {r[0]: (r[6] or 15) for r in QD.ALERT_RULES}
    by = {}
    for r in sorted(got, key=lambda r: r["fired_at"]):
        last = by.get(r["rule_id"])
        assert last is None or r["fired_at"] - last >= dt.timedelta(minutes=minutes[r["rule_id"]])
        by[r["rule_id"]] = r["fired_at"]


def test_stored_hours_give_the_same_metrics(spark):
    f = td.flows(spark, SMALL)
    now = f.agg(F.max("ts")).first()[0].replace(minute=0, second=0, microsecond=0)
    f = f.filter(F.col("ts") <= F.lit(now))
    whole = {tuple(r) for r in D.alert_metrics(f, [5, 60], as_of=now).collect()}
    assert {tuple(r) for r in D.alert_metrics(f, [5, 60], as_of=now, hourly=D.hourly_load(f)).collect()} == whole


def replay(spark, job, batches, schema, tmp_path, name):
    """Run a job over a file a batch, in order; rows of its sink and the progress of its batches."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    df = job(stream)
    name = f"{name}_{uuid.uuid4().hex[:8]}"
    q = J.append_to(df, str(tmp_path / "out"), name, {"availableNow": True})
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(str(tmp_path / "out")).collect(), q.recentProgress


T0 = dt.datetime(2024, 1, 1)
PACKETS = "seq long, conn_id long, ts timestamp, kind string"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_http_pairs_in_any_order_inside_the_watermark(spark, tmp_path):
    # the response's file comes before its request's, eight minutes of event time apart from the newest row
    batches = [[(2, 1, at(2), "response"), (9, 2, at(9), "request")], [(1, 1, at(1), "request"), (3, 1, at(3), "request")],
               [(4, 1, at(4), "response"), (10, 2, at(30), "response")], [(11, 3, at(200), "request")]]
    rows, _ = replay(spark, ST.stream_pair_http, batches, PACKETS, tmp_path, "order")
    assert sorted((r["conn_id"], r["request_seq"], r["response_seq"], r["latency_ms"]) for r in rows) == [
        (1, 1, 2, 60_000), (1, 3, 4, 60_000), (2, 9, 10, 21 * 60_000)]


def test_late_packets_are_dropped(spark, tmp_path):
    batches = [[(1, 1, at(1), "request")], [(5, 2, at(60), "request")], [(6, 2, at(61), "request")], [(2, 1, at(2), "response")],
               [(7, 2, at(120), "response")], [(8, 3, at(300), "request")]]
    rows, _ = replay(spark, ST.stream_pair_http, batches, PACKETS, tmp_path, "late")
    assert [(r["conn_id"], r["request_seq"]) for r in rows] == [(2, 5)]


def test_silent_connections_are_freed(spark, tmp_path):
    batches = [[(i, i, at(0), "request") for i in range(50)], [(100, 99, at(30), "request")], [(101, 99, at(200), "request")],
               [(102, 99, at(400), "request")], [(103, 0, at(390), "response")], [(104, 99, at(500), "request")]]
    rows, progress = replay(spark, ST.stream_pair_http, batches, PACKETS, tmp_path, "silent")
    assert rows == []  # the response finds no request: its connection was silent for more than an hour
    states = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert max(states) >= 50 and states[-1] < 10


ICMP = "seq long, ts timestamp, icmp_type int, src_ip string, dst_ip string, echo_id int, echo_seq int"


def test_echo_state_shrinks(spark, tmp_path):
    ask = lambda s, m: (s, at(m), 8, "10.0.0.1", "9.9.9.9", 1, s % 50)
    reply = lambda s, m, q: (s, at(m), 0, "9.9.9.9", "10.0.0.1", 1, q)
    batches = [[ask(i, 0) for i in range(50)] + [reply(100, 5, 7), reply(101, 6, 7)], [ask(57, 10), reply(102, 11, 7), reply(103, 100, 8)],
               [ask(60, 300)], [ask(61, 600)]]
    rows, progress = replay(spark, ST.stream_icmp_rtt, batches, ICMP, tmp_path, "echo")
    # the second reply finds the first one's request taken; the one after 100 minutes is past the longest round trip
    assert sorted((r["request_seq"], r["reply_seq"], r["rtt_ms"]) for r in rows) == [(7, 100, 300_000.0), (57, 102, 60_000.0)]
    total = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress if p["stateOperators"]]
    assert max(total) > 50 and total[-1] < 10


def test_alert_state_is_bounded_and_silence_is_evaluated(spark, tmp_path):
    rules = spark.createDataFrame([("low", "quiet", "flows_per_minute", "lt", 0.5, 5, 60, True),
                                   ("off", "off", "flows_per_minute", "gt", 0.0, 5, 1, False)], QD.RULES_SCHEMA)
    rows = [[(f"f{b}-{i}", at(b * 100 + i)) for i in range(20)] for b in range(6)]
    frames = [[tuple(r) for r in conform_flows(spark.createDataFrame(r, "id string, ts timestamp")).collect()] for r in rows]
    schema = conform_flows(spark.createDataFrame(rows[0], "id string, ts timestamp")).schema
    got, progress = replay(spark, lambda s: ST.stream_alerts(s, rules), frames, schema, tmp_path, "quiet")
    # quiet is less than three flows in five minutes; a burst holds a flow a minute for 20 minutes of each hundred
    assert [(r["rule_id"], r["fired_at"]) for r in sorted(got, key=lambda r: r["fired_at"])] == [
        ("low", at(m)) for m in (1, 61, 123, 183, 243, 323, 383, 443)]
    held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress if p["stateOperators"]]
    assert max(held) < 120


def test_a_minute_is_saved_once_for_all_rules(spark, tmp_path):
    rules = spark.createDataFrame([(f"r{i}", "any", "flows_per_minute", "gt", 0.0, 5, 60, True) for i in range(8)], QD.RULES_SCHEMA)
    rows = [[(f"f{b}-{i}", at(b * 100 + i)) for i in range(20)] for b in range(3)]
    frames = [[tuple(r) for r in conform_flows(spark.createDataFrame(r, "id string, ts timestamp")).collect()] for r in rows]
    schema = conform_flows(spark.createDataFrame(rows[0], "id string, ts timestamp")).schema
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # where the rules don't count as small, each of their partitions had the minutes aggregated, and their state saved, anew
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, progress = replay(spark, lambda s: ST.stream_alerts(s, rules), frames, schema, tmp_path, "once")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted((r["rule_id"], r["fired_at"]) for r in got) == [(f"r{i}", at(m)) for i in range(8) for m in (1, 101, 201)]
    saved = [o["numRowsUpdated"] for p in progress for o in p["stateOperators"] if o["operatorName"] == "stateStoreSave"]
    assert saved == [20, 20, 20, 0]


def test_a_busy_echo_key_holds_one_event(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(seconds=i), 8 if i % 2 else 0, *(("10.0.0.1", "9.9.9.9") if i % 2 else ("9.9.9.9", "10.0.0.1")), 1, 1)
            for i in range(400)]
    batches = [rows[:200], rows[200:], [(900, at(600), 8, "10.0.0.1", "9.9.9.9", 1, 1)]]
    got, progress = replay(spark, ST.stream_icmp_rtt, batches, ICMP, tmp_path, "busy")
    assert sorted((r["request_seq"], r["reply_seq"], r["rtt_ms"]) for r in got) == [(i - 1, i, 1000.0) for i in range(2, 400, 2)]
    # a join over the longest round trip held all events
    assert max(sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress if p["stateOperators"]) < 10


def test_connections_share_the_states_of_their_buckets(spark, tmp_path):
    batches = [[(2 * i, i, at(0), "request") for i in range(2000)] + [(1, None, at(0), "request")],
               [(2 * i + 1, i, at(1), "response") for i in range(2000)] + [(3, None, at(1), "response")], [(9000, 1, at(60), "request")]]
    got, progress = replay(spark, ST.stream_pair_http, batches, PACKETS, tmp_path, "shared")
    assert sorted((-1 if r["conn_id"] is None else r["conn_id"], r["request_seq"], r["response_seq"], r["latency_ms"]) for r in got) == [
        (-1, 1, 3, 60_000)] + [(i, 2 * i, 2 * i + 1, 60_000) for i in range(2000)]
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]) <= 3 * ST.BUCKETS


def test_a_large_step_is_several_files_of_one_batch(spark, monkeypatch):
    monkeypatch.setattr(QS, "FILE_ROWS", 10)
    name = QS.fresh("files")
    stream = QS.flow_stream(spark, SMALL, name)
    q = J.append_to(stream.select("id"), J.stream_folder(spark, name, "out"), name, {"availableNow": True})
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == QS.FILES
    assert len(spark.read.parquet(J.stream_folder(spark, name, "in")).inputFiles()) > QS.FILES
    assert spark.read.parquet(J.stream_folder(spark, name, "out")).count() == td.flows(spark, SMALL).count()
