"""Hand-written edge rows for thresholds and classifications (FIXTURES §4)."""

import datetime as dt
import ipaddress

from pyspark.sql import functions as F

from flowlens.functions.ip import address_key, cidr_match, ip_key, is_external, is_external_like, is_private, is_valid_ip, with_cidr
from flowlens.operators import certs as C
from flowlens.operators import detect as D
from flowlens.operators import enrich as E
from flowlens.operators import sessions as SS
from flowlens.operators.rangejoin import lookup, network_table
from flowlens.schema import conform_flows


def _flows(spark, rows):
    df = spark.createDataFrame(rows, "id string, dst_ip string, dst_port int, src_ip string")
    return conform_flows(df.withColumn("ts", F.lit(dt.datetime(2024, 1, 30, 12, 0))))


def test_ip_classes(spark):
    rows = [("10.0.0.1", True, False), ("172.15.255.255", False, True), ("172.16.0.0", True, False),
            ("172.31.255.255", True, False), ("172.32.0.0", False, True), ("172.200.1.1", False, True),
            ("127.0.0.1", True, False), ("169.254.1.1", True, True), ("::1", True, False),
            ("fc00::1", True, False), ("fe80::1", True, True), ("", False, False), ("not-an-ip", False, False)]
    df = spark.createDataFrame([(r[0],) for r in rows], "ip string")
    got = {r["ip"]: (r["p"], r["e"]) for r in
           df.select("ip", is_private("ip").alias("p"), is_external("ip").alias("e")).collect()}
    for ip, priv, ext in rows:
        assert got[ip] == (priv, ext), ip
    # LIKE form hides 172.200.x (reference quirk), CIDR form does not
    assert df.filter(F.col("ip") == "172.200.1.1").select(is_external_like("ip")).first()[0] is False


def test_ip_validity_and_cidr(spark):
    df = spark.createDataFrame([("1.2.3.04",), ("256.1.1.1",), ("2001:db8::1",), ("1::2::3",)], "ip string")
    assert [r[0] for r in df.select(is_valid_ip("ip")).collect()] == [False, False, True, False]
    v6 = ["2001:db8::1", "2001:DB8:0:0:0::1", "::", "1::", "::1:2", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "0:0:0:0:0:FFFF:1.2.3.4",
          "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8"]
    bad = ["1:2:3:4:5:6:7", "1::2::3", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "g::", "::ffff:1.2.3.256", "1.2.3.4::",
           "1:2:3:4::5:6:7:8", ":", ":::", ""]
    df = spark.createDataFrame([(x,) for x in v6 + bad + ["1.2.3.4"]], "ip string")
    got = {r[0]: r[1] for r in df.select("ip", ip_key("ip")).collect()}
    assert {r[0]: r[1] for r in df.select("ip", address_key("ip")).collect()} == got
    assert {r[0]: r[1] for r in df.select("ip", is_valid_ip("ip")).collect()} == {k: v is not None for k, v in got.items()}
    some = ["2001:db8::/32", "::/0", "1.2.0.0/15", "fe80::/10", "::1"]
    inside = lambda x: any(ipaddress.ip_address(x) in ipaddress.ip_network(n) for n in some)
    for x, hit in df.select("ip", cidr_match("ip", some)).collect():
        mapped = x in v6 and ipaddress.ip_address(x).ipv4_mapped
        assert hit == (x in v6 + ["1.2.3.4"] and inside(str(mapped) if mapped else x)), x
    for x in v6:
        a = ipaddress.ip_address(x)
        assert got[x] == f"{int(a):032x}", x
    assert got["1.2.3.4"] == got["::ffff:1.2.3.4"] and [got[x] for x in bad] == [None] * len(bad)
    nets = ["10.0.0.0/8", "192.168.1.7", "2001:db8::/33", "fe80::/10", "2001:db8::7", "1.2.3.4/0", "::/0", "5.6.7.8/31",
            "2001:db8:ffff::/47", "9.9.9.9/21"]
    c = spark.createDataFrame([(n,) for n in nets + ["bad/99", "1.2.3.4/33", "::/129", "1.2.3.4/", "1.2.3.4/8/9"]], "n string")
    for n, lo, hi, bits in with_cidr(c, "n").select("n", "lo", "hi", "bits").collect():
        if n not in nets:
            assert (lo, hi, bits) == (None, None, None), n
            continue
        net = ipaddress.ip_network(n, strict=False)
        head, width = ("0" * 20 + "ffff", 8) if net.version == 4 else ("", 32)
        assert lo == head + f"{int(net.network_address):0{width}x}" and hi == head + f"{int(net.broadcast_address):0{width}x}"
        assert bits == net.prefixlen + (96 if net.version == 4 else 0)


def test_networks_of_both_versions(spark):
    lines = spark.createDataFrame([(x,) for x in ["2001:db8::/32", "2001:db8::7", "1.2.3.0/24", "::/0", "# no", "junk", ""]],
                                  "value string")
    bl = E.blocklist_from_lines(lines)
    assert sorted(r["net"] for r in bl.collect()) == ["1.2.3.0/24", "2001:db8::/32", "2001:db8::7", "::/0"]
    f = _flows(spark, [("a", "2001:db8::7", 80, "1.2.3.9"), ("b", "2001:DB8:1::", 80, "x"), ("c", "1.2.3.4", 80, "::1"),
                       ("d", "::ffff:1.2.3.4", 80, ""), ("e", "9.9.9.9", 80, "2001:db8::7"), ("f", "fe80::1", 80, "1.1.1.1")])
    table = network_table(bl, priority=F.col("ord"), payload=["net"])
    got = {r["id"]: (r["dst_ip_net"], r["src_ip_net"]) for r in lookup(f, ["dst_ip", "src_ip"], table).collect()}
    assert got == {"a": ("2001:db8::7", "1.2.3.0/24"), "b": ("2001:db8::/32", None), "c": ("1.2.3.0/24", "::/0"),
                   "d": ("1.2.3.0/24", None), "e": (None, "2001:db8::7"), "f": ("::/0", None)}
    score = {r["id"]: r["threat_score"] for r in E.enrich_threat(f, bl).collect()}
    assert score == {"a": 75, "b": 75, "c": 75, "d": 75, "e": 0, "f": 0}  # link-local is private


def test_policies_match_ipv6(spark):
    f = _flows(spark, [("a", "2001:db8::7", 80, "x"), ("b", "1.2.3.4", 80, "x"), ("c", "2001:db9::", 80, "x")]) \
        .withColumn("process_name", F.lit("curl"))
    p = spark.createDataFrame([("p1", "v6", "curl", "deny", "2001:db8::/32", 0, True), ("p2", "all v6", "curl", "deny", "::/0", 80, True),
                               ("p3", "junk", "curl", "deny", "junk", 0, True)],
                              "id string, name string, process_name string, action string, dst_ip_cidr string, dst_port int, enabled boolean")
    got = sorted((r["policy_id"], r["flow_id"]) for r in D.evaluate_policies(f, p).collect())
    assert got == [("p1", "a"), ("p2", "a"), ("p2", "c")]


def test_threat_scores(spark):
    bl = E.builtin_blocklist(spark, ["185.220.101.0/24", "# comment", "10.9.9.0/24", "junk"])
    f = _flows(spark, [("a", "10.1.1.1", 4444, "10.0.0.1"),       # private + C2 port -> 50 medium
                       ("b", "185.220.101.5", 80, "10.0.0.1"),    # blocklist -> 75 high
                       ("c", "185.220.101.5", 4444, "10.0.0.1"),  # 75 + 50 capped 100
                       ("d", "8.8.8.8", 23, "10.0.0.1"),          # telnet 15 -> clean
                       ("e", "not-an-ip", 9001, "10.0.0.1"),      # invalid: ports still count 40 low
                       ("f", "10.9.9.1", 80, "10.0.0.1")])        # private even if listed -> 0
    got = {r["id"]: (r["threat_score"], r["threat_level"]) for r in E.enrich_threat(f, bl).collect()}
    assert got == {"a": (50, "medium"), "b": (75, "high"), "c": (100, "high"), "d": (15, "clean"),
                   "e": (40, "low"), "f": (0, "clean")}


def test_desktop_threat(spark):
    bl = E.builtin_blocklist(spark, E.DESKTOP_BUILTIN_BLOCKLIST)
    f = _flows(spark, [("a", "185.220.1.1", 4444, "185.221.0.1"), ("b", "8.8.8.8", 443, "10.0.0.1"),
                       ("c", "8.8.8.8", 23, "10.0.0.1")])
    got = {r["id"]: (r["desk_threat_score"], r["desk_threat_level"])
           for r in E.enrich_threat_bidirectional(f, bl).collect()}
    assert got == {"a": (100, "high"), "b": (None, None), "c": (20, "low")}


def test_cert_status_bounds(spark):
    as_of = dt.datetime(2024, 1, 30, 0, 0)
    rows = [(d, (as_of + dt.timedelta(days=d)).strftime("%Y-%m-%d"), False) for d in (-1, 0, 7, 8, 30, 31)]
    rows += [(99, "", False), (98, "2030-01-01", True)]
    df = spark.createDataFrame(rows, "k int, expiry string, expired boolean")
    got = {r["k"]: (r["days_left"], r["status"])
           for r in C.cert_status(df, F.lit(as_of)).collect()}
    assert got[-1] == (-1, "expired") and got[0] == (0, "critical") and got[7] == (7, "critical")
    assert got[8] == (8, "warning") and got[30] == (30, "warning") and got[31] == (31, "ok")
    assert got[99] == (None, "unknown") and got[98][1] == "expired"
    strict = {r["k"]: r["status"] for r in C.cert_status(df, F.lit(as_of), strict=True).collect()}
    assert strict[99] == "critical"  # reference: blank expiry -> days_left 0


def test_zscore_rules(spark):
    base = spark.createDataFrame(
        [("a", "TCP", 0, 1.0, 0.0, 3), ("b", "TCP", 0, 100.0, 10.0, 3), ("c", "TCP", 0, 100.0, 10.0, 2)],
        "agent_id string, protocol string, hour_of_week int, flow_count_mean double, flow_count_std double, "
        "sample_count long")
    base = base.withColumn("bytes_in_mean", F.lit(0.0)).withColumn("bytes_out_mean", F.lit(0.0))
    # Monday 2024-01-29 00:00 -> hour_of_week 0; counts per 5 minutes
    t = dt.datetime(2024, 1, 29, 0, 1)
    rows = [("a", "TCP", t)] * 2 + [("b", "TCP", t)] * 11 + [("c", "TCP", t)] * 20
    f = conform_flows(spark.createDataFrame(rows, "agent_id string, protocol string, ts timestamp")
                      .withColumn("hostname", F.lit("h")))
    out = {r["agent_id"]: r for r in D.detect_anomalies_history(f, base).collect()}
    # a: observed 24, std floor 5 -> z 4.6 medium spike; b: 132 vs 100, sigma 10 -> 3.2 low
    assert round(out["a"]["z_score"], 6) == 4.6 and out["a"]["severity"] == "medium"
    assert round(out["b"]["z_score"], 6) == 3.2 and out["b"]["anomaly_type"] == "spike"
    assert "c" not in out  # only 2 samples
    assert out["a"]["description"].startswith("Spike: TCP traffic on agent h is 24.0x higher")


def test_silent_agents_drop(spark):
    base = spark.createDataFrame(
        [("a", "TCP", 0, 100.0, 10.0, 3), ("a", "UDP", 0, 10.0, 0.0, 3), ("a", "DNS", 1, 100.0, 10.0, 3),
         ("b", "TCP", 0, 100.0, 10.0, 2), ("gone", "TCP", 0, 60.0, 0.0, 9)],
        "agent_id string, protocol string, hour_of_week int, flow_count_mean double, flow_count_std double, "
        "sample_count long").withColumn("bytes_in_mean", F.lit(0.0)).withColumn("bytes_out_mean", F.lit(0.0))
    monday = dt.datetime(2024, 1, 29)
    rows = [("a", "old", "TCP", monday - dt.timedelta(days=7, minutes=-50)), ("a", "", "TCP", monday - dt.timedelta(days=1)),
            ("a", "new", "ICMP", monday - dt.timedelta(hours=2)), ("b", "hb", "TCP", monday + dt.timedelta(minutes=59))]
    f = conform_flows(spark.createDataFrame(rows, "agent_id string, hostname string, protocol string, ts timestamp"))
    assert D.detect_anomalies(f, base, window_minutes=30).count() == 0
    got = {(r["agent_id"], r["protocol"], r["hostname"], round(r["z_score"], 6), r["anomaly_type"])
           for r in D.detect_anomalies(f, base, window_minutes=30, include_silent=True).collect()}
    # UDP: 10 a hour over a floor of 5 is 2 sigma; b has two samples; DNS belongs to another hour
    assert got == {("a", "TCP", "new", -10.0, "drop"), ("gone", "TCP", "", -10.0, "drop")}
    inventory = spark.createDataFrame([("gone", "host-9"), ("a", "host-1")], "agent_id string, hostname string")
    got = {(r["agent_id"], r["hostname"]) for r in
           D.detect_anomalies(f, base, window_minutes=30, include_silent=True, agents=inventory).collect()}
    assert got == {("a", "host-1"), ("gone", "host-9")}
    # history: windows that start after a's first flow (00:50 a week before), up to the last flow; b and "gone" have none
    week = monday - dt.timedelta(days=7)
    for minutes in (5, 7, 20):
        hist = D.detect_anomalies_history(f, base, window_minutes=minutes, include_silent=True).filter("observed = 0").collect()
        want = set()
        start = dt.datetime.fromtimestamp(week.replace(tzinfo=dt.timezone.utc).timestamp() // (minutes * 60) * minutes * 60,
                                          dt.timezone.utc).replace(tzinfo=None)
        while start <= monday + dt.timedelta(minutes=59):
            hour = start.weekday() * 24 + start.hour
            if start > week + dt.timedelta(minutes=50) and hour in (0, 1):
                want.add((start, "a", "new", "TCP" if hour == 0 else "DNS", "drop"))
            start += dt.timedelta(minutes=minutes)
        got = [(r["window_start"], r["agent_id"], r["hostname"], r["protocol"], r["anomaly_type"]) for r in hist]
        assert set(got) == want and len(got) == len(want)


def test_sunday_hour_of_week(spark):
    from flowlens.functions.timewin import hour_of_week
    df = spark.createDataFrame([(dt.datetime(2024, 1, 28, 23, 30),)], "ts timestamp")
    assert df.select(hour_of_week(F.col("ts"))).first()[0] == 167


def test_alert_threshold_and_cooldown(spark):
    as_of = F.lit(dt.datetime(2024, 1, 30, 12, 0))
    metrics = spark.createDataFrame([(5, "flows_per_minute", 10.0)], "window_minutes int, metric string, value double")
    rules = spark.createDataFrame(
        [("eq", "equal", "flows_per_minute", "gt", 10.0, 5, 15, True),
         ("hot", "in cooldown", "flows_per_minute", "gt", 1.0, 5, 15, True),
         ("cold", "after cooldown", "flows_per_minute", "gt", 1.0, 5, 15, True),
         ("off", "disabled", "flows_per_minute", "gt", 1.0, 5, 15, False)],
        "id string, name string, metric string, condition string, threshold double, window_minutes int, "
        "cooldown_minutes int, enabled boolean")
    events = spark.createDataFrame([("hot", dt.datetime(2024, 1, 30, 11, 50)),
                                    ("cold", dt.datetime(2024, 1, 30, 11, 40))], "rule_id string, fired_at timestamp")
    fired = {r["rule_id"] for r in D.evaluate_alerts(rules, metrics, events, as_of).collect()}
    assert fired == {"cold"}


def test_sdk_model_facts(spark):
    from flowlens.operators.enrich import derived_columns, is_online
    f = conform_flows(spark.createDataFrame([(100, 200, "high"), (1, 2, "medium"), (1, 2, "low"), (1, 2, "")],
                                            "bytes_in long, bytes_out long, threat_level string"))
    got = [(r["total_bytes"], r["is_threat"]) for r in derived_columns(f).collect()]
    assert got == [(300, True), (3, True), (3, False), (3, False)]
    now = dt.datetime(2024, 1, 30, 12, 0)
    seen = spark.createDataFrame([(now - dt.timedelta(seconds=30),), (now - dt.timedelta(hours=2),), (None,)],
                                 "last_seen timestamp")
    assert [r[0] for r in seen.select(is_online(F.col("last_seen"), F.lit(now))).collect()] == [True, False, False]


def _segments(spark, rows):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(c, "c2s", t + dt.timedelta(seconds=i * 40 * 60), i, q, n) for c, i, q, n in rows],
                                 "conn_id long, direction string, ts timestamp, seg_id long, tcp_seq long, length long")


def test_tcp_health_by_hand(spark):
    rows = [(1, 0, 0, 100), (1, 1, 200, 100), (1, 2, 100, 100), (1, 3, 300, 100),             # a gap that is filled
            (2, 0, 4294967000, 296), (2, 1, 0, 100), (2, 2, 100, 100), (2, 3, 4294967000, 296),  # wrap, then a repeat
            (3, 0, 0, 100), (3, 1, 300, 100), (3, 2, 400, 100), (3, 3, 300, 100),             # a gap that stays
            (4, 0, 500, 100), (4, 1, 400, 100), (4, 2, 600, 0), (4, 3, 600, 100),             # before the first; no payload
            (5, 0, 0, 100), (5, 1, 50, 100), (5, 2, 100, 100), (5, 3, 300, 50), (5, 4, 200, 100), (5, 5, 300, 50),  # overlap
            (6, 0, 0, 100), (6, 1, 200, 100), (6, 2, 200, 100), (6, 3, 100, 100), (6, 4, 200, 100)]  # held twice
    got = {r["conn_id"]: (r["segments"], r["retransmissions"], r["out_of_order"])
           for r in SS.tcp_health(_segments(spark, rows)).collect()}
    assert got == {1: (4, 0, 1), 2: (4, 1, 0), 3: (4, 0, 3), 4: (3, 1, 0), 5: (6, 2, 1), 6: (5, 1, 2)}


def test_tcp_health_matches_a_replay_of_random_segments(spark):
    import random
    rng = random.Random(9)
    rows = [(c, i, rng.randrange(9) * 100 + 4294966900 - (1 << 32) * (c % 2 == 0 and 1), 100) for c in range(30) for i in range(rng.randrange(1, 30))]
    rows = [(c, i, q % 4294967296, n) for c, i, q, n in rows]
    want = {}
    for c in range(30):
        nxt, held, again, late, segs = None, {}, 0, 0, [r for r in rows if r[0] == c]
        for _, _, q, n in segs:
            nxt = q if nxt is None else nxt
            d = (q - nxt + (1 << 31)) % (1 << 32) - (1 << 31)
            if d == 0:
                nxt = (nxt + n) % (1 << 32)
                while nxt in held:
                    nxt = (nxt + held.pop(nxt)) % (1 << 32)
            elif d > 0:
                late += 1
                held[q] = n
            else:
                again += 1
        if segs:
            want[c] = (len(segs), again, late)
    got = {r["conn_id"]: (r["segments"], r["retransmissions"], r["out_of_order"])
           for r in SS.tcp_health(_segments(spark, rows)).collect()}
    assert got == want


def _replay_by_hand(rows):
    out = {}
    for c in {r[0] for r in rows}:
        nxt, held, again, late, segs = None, {}, 0, 0, [r for r in rows if r[0] == c]
        for _, _, q, n in segs:
            nxt = q if nxt is None else nxt
            if q == nxt:
                while n:
                    nxt += n
                    n = held.pop(nxt, 0)
            elif q > nxt:
                late += 1
                held[q] = n
            else:
                again += 1
        out[c] = (len(segs), again, late)
    return out


def test_tcp_health_replays_only_the_pieces_with_an_overlap(spark, monkeypatch):
    import random
    rng = random.Random(4)
    rows = []
    for c in range(60):  # short streams of mixed lengths, overlaps, gaps, swaps
        at, segs = 1000, []
        for _ in range(rng.randrange(1, 40)):
            n = rng.choice((50, 100, 100, 100))
            segs.append((at, n))
            if rng.random() < 0.15:
                segs.append((at + rng.choice((0, 0, 50, -50)), rng.choice((50, 100, 150))))
            at += n + (rng.random() < 0.02) * 50
        for i in range(1, len(segs) - 1):
            if rng.random() < 0.15:
                segs[i], segs[i + 1] = segs[i + 1], segs[i]
        rows += [(c, i, q, n) for i, (q, n) in enumerate(segs)]
    long = [(100, i, 100 * i, 100) for i in range(1500)]
    long.insert(700, (100, 0, 69_850, 100))  # one retransmission of another size
    rows += [(c, i, q, n) for i, (c, _, q, n) in enumerate(long)]
    real = SS._replay

    def sizes(keys):
        run = real(keys)

        def spy(key, pdf):
            assert len(pdf) < 200, "a whole half-stream in one group"
            return run(key, pdf)
        return spy

    monkeypatch.setattr(SS, "_replay", sizes)
    got = {r["conn_id"]: (r["segments"], r["retransmissions"], r["out_of_order"])
           for r in SS.tcp_health(_segments(spark, rows)).collect()}
    assert got == _replay_by_hand(rows) and got[100] == (1501, 1, 0)


def test_http_pairs_and_icmp_by_hand(spark):
    t = dt.datetime(2024, 1, 1)
    ev = [(1, 0, "response"), (1, 1, "request"), (1, 2, "request"), (1, 90, "response"), (1, 91, "response"), (1, 92, "request")]
    df = spark.createDataFrame([(c, i, t + dt.timedelta(minutes=i), k) for c, i, k in ev], "conn_id long, seq long, ts timestamp, kind string")
    assert [(r["request_seq"], r["response_seq"], r["latency_ms"]) for r in SS.pair_http(df).collect()] == [(1, 90, 89 * 60_000)]
    ic = [(0, 8, 0), (1, 8, 70), (2, 0, 71), (3, 0, 72), (4, 128, 73), (5, 129, 74)]
    df = spark.createDataFrame([(s, t + dt.timedelta(minutes=m), k, "a" if k in (8, 128) else "g", "g" if k in (8, 128) else "a", 1, 1)
                                for s, k, m in ic],
                               "seq long, ts timestamp, icmp_type int, src_ip string, dst_ip string, echo_id int, echo_seq int")
    assert sorted((r["request_seq"], r["reply_seq"], r["rtt_ms"]) for r in SS.icmp_rtt(df).collect()) == [(1, 2, 60000.0), (4, 5, 60000.0)]


RULE_SCHEMA = "id string, title string, severity string, query string, enabled boolean, version int"


def test_rules_run_queries_only(spark):
    f = _flows(spark, [("a", "8.8.8.8", 23, "10.0.0.1"), ("b", "8.8.4.4", 80, "10.0.0.2")])
    spark.range(1).createOrReplaceTempView("flows")
    now = dt.datetime(2024, 1, 31)
    bad = ["DELETE FROM flows", "WITH t AS (SELECT 1 a) INSERT INTO x SELECT * FROM t", "INSERT INTO flows SELECT 1", "DROP TABLE flows",
           "SELECT 1; SELECT 2", "SELECT nothing FROM flows", "CREATE TABLE x AS SELECT 1", "SET a=b", "not sql",
           "FROM flows INSERT INTO x SELECT 1", ""]
    rules = [(f"r{i}", "t", "low", q, True, 1) for i, q in enumerate(bad)]
    out = D.run_rules(spark, spark.createDataFrame(rules, RULE_SCHEMA), f, now)
    assert out.columns == ["rule_id", "rule_title", "severity", "match_data", "fired_at"] and out.count() == 0
    errors = D.rule_errors(spark, spark.createDataFrame(rules, RULE_SCHEMA), f, now).collect()
    assert sorted(r["rule_id"] for r in errors) == sorted(r[0] for r in rules) and all(r["error"] for r in errors)
    good = [("g1", "t", "low", "SELECT src_ip, '{x}' AS b FROM flows WHERE dst_port = 23 -- telnet", True, 1),
            ("g2", "t", "low", "WITH t AS (SELECT * FROM flows) SELECT count(*) AS n FROM t WHERE ts < :as_of;", True, 1)]
    out = D.run_rules(spark, spark.createDataFrame(rules + good, RULE_SCHEMA), f, now)
    assert sorted(r["match_data"] for r in out.collect()) == ['{"n":2}', '{"src_ip":"10.0.0.1","b":"{x}"}']
    assert spark.table("flows").columns == ["id"]  # the caller's view stands
    spark.catalog.dropTempView("flows")


def test_incident_status_and_references(spark):
    t = dt.datetime(2024, 1, 1, 9, 30)
    log = [("i", "create", "T", "high", "sigma", "r1", "", "", t, 1), ("i", "ack", None, None, None, None, "seen", "", t, 2),
           ("i", "dispatch", None, None, None, None, "", "J-1", t, 3), ("i", "dispatch", None, None, None, None, "", "L-2", t, 4)]
    df = spark.createDataFrame(log, "id string, action string, title string, severity string, source string, source_id string, "
                                    "note string, ref string, acted_at timestamp, version long")
    r = D.incident_state(df).first()
    assert (r["status"], r["source"], r["source_id"], r["external_ref"]) == ("ack", "sigma", "r1", "J-1, L-2")
    assert r["notes"] == "\n[2024-01-01 09:30] seen"


def test_bad_page_sizes_are_errors(spark):
    import pytest
    from flowlens.operators import aggregate as A
    from flowlens.operators import filters as FL
    f = _flows(spark, [("a", "8.8.8.8", 23, "10.0.0.1")] * 3)
    assert FL.query_flows(f, limit=5000)[0].count() == 3
    for call in (lambda: FL.query_flows(f, limit=0), lambda: A.top_talkers(f, k=0), lambda: A.timeseries(f, hours=0),
                 lambda: FL.search_flows(f, limit=-1)):
        with pytest.raises(ValueError):
            call()


def test_csv_report_quotes_and_orders(spark):
    from flowlens.operators import compliance as CP
    f = conform_flows(spark.createDataFrame(
        [("a", 'x,"y"', "8.8.8.8", 80, 900, "HTTP")] + [("b", "10.0.0.1", "9.9.9.9", 80, 5, "HTTP")],
        "id string, src_ip string, dst_ip string, dst_port int, bytes_out long, protocol string")
        .withColumn("ts", F.lit(dt.datetime(2024, 1, 30))))
    now = F.lit(dt.datetime(2024, 1, 31))
    x = CP.Inputs(flows=f, as_of=now, since=CP.report_window(now, "daily"),
                  audit=spark.createDataFrame([], "method string, path string, ts timestamp, token_id string"),
                  members=spark.createDataFrame([], "user_id string, email string, role string, is_active boolean, created_at timestamp, last_seen timestamp, version long"))
    lines = CP.report_csv_lines("hipaa", x)
    got = [r["line"] for r in lines.orderBy("section", "part", "order_key").collect()]
    assert got[:4] == ["164.312(e)(1),src_ip,dst_ip,dst_port,cnt,bytes", ',"x,""y""",8.8.8.8,80,1,900', ",10.0.0.1,9.9.9.9,80,1,5", ""]


def test_flow_info_branches(spark):
    import json
    from flowlens.sources.ingest import flatten_flow, flows_from_json_lines
    tls = lambda **x: {"protocol": "TLS", "tls": x}
    wire = {"hello": tls(record_type="ClientHello", sni="a.example"), "bare": tls(record_type="ClientHello"),
            "server": tls(record_type="ServerHello", chosen_cipher="X"), "cert": tls(record_type="Certificate", cert_cn="c", cert_expired=True),
            "alert": tls(record_type="Alert", alert_level="fatal", alert_description="bad"), "other": tls(record_type="Handshake"),
            "icmp": {"icmp": {"type_str": "Echo Reply", "rtt_ms": 1.25}}, "icmp2": {"icmp": {"type_str": "Echo Request"}},
            "arp": {"arp": {"operation": "who-has", "sender_ip": "1.1.1.1", "target_ip": "2.2.2.2"}},
            "dns": {"dns": {"query_name": "x.org", "query_type": "A"}}, "http": {"http": {"method": "GET", "path": "/"}},
            "grpc": {"http": {"method": "POST", "path": "/pkg.Svc/Do", "headers": [{"name": "Content-Type", "value": "application/grpc+proto"}]}},
            "none": {}, "given": {"info": "as sent", "dns": {"query_name": "x", "query_type": "A"}}}
    lines = spark.createDataFrame([(json.dumps({"id": k} | v),) for k, v in wire.items()], "value string")
    got = {r["id"]: r["info"] for r in flatten_flow(flows_from_json_lines(lines)).collect()}
    assert got == {"hello": "ClientHello → a.example", "bare": "ClientHello", "server": "ServerHello X", "cert": "Certificate c [EXPIRED]",
                   "alert": "Alert fatal bad", "other": "Handshake", "icmp": "Echo Reply (1.3ms)", "icmp2": "Echo Request",
                   "arp": "who-has 1.1.1.1 → 2.2.2.2", "dns": "x.org A", "http": "GET /", "grpc": "gRPC pkg.Svc/Do", "none": "",
                   "given": "as sent"}


def test_stored_flows_prune_months(spark, tmp_path):
    import re
    from flowlens.functions.timewin import since
    from flowlens.operators import aggregate as A
    from flowlens.operators import export as X
    rows = [(f"f{i}", dt.datetime(2024, 1 + i % 6, 1 + i % 28, i % 24)) for i in range(3000)]
    f = conform_flows(spark.createDataFrame(rows, "id string, ts timestamp"))
    path = str(tmp_path / "flows")
    X.write_flows(f, path)
    months = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "flows").glob("yyyymm=*")}
    assert len(months) == 6 and sum(months.values()) > 6  # a month takes more than one task
    t = spark.read.parquet(path)
    plan = since(t, "7d", as_of=dt.datetime(2024, 3, 20))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*yyyymm", plan) and re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(ts", plan)
    assert since(t, "7d", as_of=dt.datetime(2024, 3, 20), upper=True).count() == sum(
        dt.datetime(2024, 3, 13) <= r[1] <= dt.datetime(2024, 3, 20) for r in rows)
    last = max(r[1] for r in rows)
    assert A.timeseries(t, hours=24).agg(F.sum("cnt")).first()[0] == sum(r[1] >= last - dt.timedelta(hours=24) for r in rows)


def test_a_busy_second_of_one_connection_is_many_ranges(spark):
    import random
    rng = random.Random(9)
    t = dt.datetime(2024, 1, 1, 12)
    kinds = [rng.choice(("request", "request", "response")) for _ in range(4000)]
    rows = [(1, i, t + dt.timedelta(microseconds=100 * (i // 3)), k) for i, k in enumerate(kinds)]
    rows += [(c, 0, t, "request") for c in range(2, 40)] + [(c, 1, t, "response") for c in range(2, 40)]
    df = spark.createDataFrame(rows, "conn_id long, seq long, ts timestamp, kind string")
    parts = SS.in_parts(df, ["conn_id"], ["ts", "seq"])
    assert max(r["count"] for r in parts.groupBy("conn_id", "_part").count().collect()) < 1500
    want, open_at = set(), None
    for i, k in enumerate(kinds):
        if k == "request":
            open_at = i if open_at is None else open_at
        elif open_at is not None:
            want.add((1, open_at, i))
            open_at = None
    want |= {(c, 0, 1) for c in range(2, 40)}
    got = SS.pair_http(df).collect()
    assert {(r["conn_id"], r["request_seq"], r["response_seq"]) for r in got} == want and len(got) == len(want)
    sums = {r["seq"]: r["n"] for r in SS.running_sum(parts, ["conn_id"], ["ts", "seq"], F.lit(1), "n").filter("conn_id = 1").collect()}
    assert sums == {i: i + 1 for i in range(4000)}


def test_endpoint_percentiles_and_approximate_forms(spark):
    import random

    import numpy as np
    from flowlens.operators import aggregate as A
    rng = random.Random(6)
    t = dt.datetime(2024, 1, 1)
    lat = {"/hot": [rng.choice((3, 5, 8, rng.randrange(5000))) for _ in range(3000)], "/one": [7], "/two": [4, 9], "/none": [None],
           "/some": [None, 1, 2, None, 10]}
    rows = [("HTTP", "GET", p, 200 if i % 3 else 500, v, t, "h", f"10.0.0.{i % 3}", f"d{i}") for p, vs in lat.items() for i, v in enumerate(vs)]
    f = conform_flows(spark.createDataFrame(rows, "protocol string, http_method string, http_path string, http_status int, "
                                                  "duration_ms long, ts timestamp, hostname string, src_ip string, dst_ip string"))
    exact = {r["http_path"]: r for r in A.endpoint_stats(f).collect()}
    rough = {r["http_path"]: r for r in A.endpoint_stats(f, exact=False).collect()}
    assert exact.keys() == rough.keys()
    for path in exact:
        # the flat table has 0 for a latency that is missing
        vs = sorted(r["duration_ms"] for r in f.filter(F.col("http_path") == path).select("duration_ms").collect() if r["duration_ms"] is not None)
        for name, p in (("p50", 50), ("p95", 95), ("p99", 99)):
            if not vs:
                assert exact[path][name] is None and rough[path][name] is None
                continue
            assert abs(exact[path][name] - np.percentile(vs, p)) < 1e-9
            below = np.searchsorted(vs, rough[path][name]) / len(vs), np.searchsorted(vs, rough[path][name], "right") / len(vs)
            assert below[0] - 1 / len(vs) - 1e-4 <= p / 100 <= below[1] + 1 / len(vs) + 1e-4
        for c in ("total", "success_count", "error_count", "avg_latency"):
            assert exact[path][c] == rough[path][c]
    real = {r["src_ip"]: r["unique_destinations"] for r in A.exfil_talkers(f).collect()}
    near = {r["src_ip"]: r["unique_destinations"] for r in A.exfil_talkers(f, approx=True).collect()}
    assert real.keys() == near.keys() and all(abs(near[s] - n) <= 0.15 * n for s, n in real.items())


def test_lookup_of_nested_networks_shuffles_an_address_once(spark):
    nets = [f"{ipaddress.ip_network(f'203.0.113.77/{n}', strict=False)}" for n in (0, 7, 12, 15, 16, 17, 24, 31, 32)]
    nets += ["203.0.113.64/28", "203.2.0.0/15", "2001:db8::/32", "2001:db8:1::/48"]
    order = {n: (i * 5) % len(nets) for i, n in enumerate(nets)}
    ips = ["203.0.113.77", "203.0.113.76", "203.0.113.70", "203.0.113.1", "203.0.200.1", "203.1.1.1", "203.3.255.255", "203.15.0.1",
           "202.1.1.1", "8.8.8.8", "255.255.255.255", "0.0.0.0", "2001:db8:1::5", "2001:db8:2::5", "2002::1", "none", None]
    table = network_table(spark.createDataFrame(list(order.items()), "net string, o long"), priority=F.col("o"), payload=["net"])
    out = lookup(spark.createDataFrame([(i,) for i in ips], "ip string"), ["ip"], table)

    def best(text):
        try:
            a = ipaddress.ip_address(text)
        except ValueError:
            return None
        held = [n for n in nets if (m := ipaddress.ip_network(n)).version == a.version and a in m]
        return min(held, key=order.get, default=None)

    assert {r["ip"]: r["ip_net"] for r in out.collect()} == {i: i and best(i) for i in ips}
    # not once for each prefix length
    assert "_group" in out._jdf.queryExecution().optimizedPlan().toString()
