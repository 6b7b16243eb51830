"""File-based sources and sinks (written to pytest's tmp_path)."""

import datetime as dt
import gzip
import json
import os

from pyspark.sql import functions as F

from conftest import SMALL
from flowlens.operators import export as X
from flowlens.sources import cloud as CL
from flowlens.sources import ingest as IN
from flowlens.sources import pulls as PU
from flowlens.sources import testdata as td


def test_write_and_read_flows_partitioned(spark, tmp_path):
    f = td.flows(spark, SMALL)
    path = str(tmp_path / "flows")
    X.write_flows(f, path)
    assert any(d.startswith("yyyymm=") for d in os.listdir(path))
    back = X.read_flows(spark, path, dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20))
    exp = f.filter((F.col("ts") >= dt.datetime(2024, 1, 10)) & (F.col("ts") < dt.datetime(2024, 1, 20))).count()
    assert back.count() == exp


def test_export_window_hours(spark, tmp_path):
    f = td.flows(spark, SMALL)
    path = str(tmp_path / "export")
    audit = X.export_window(f, path, dt.datetime(2024, 1, 20), dt.datetime(2024, 1, 21))
    n = sum(r["row_count"] for r in audit.collect())
    assert n == f.filter((F.col("ts") >= dt.datetime(2024, 1, 20)) & (F.col("ts") < dt.datetime(2024, 1, 21))).count()
    assert spark.read.json(path).count() == n


def test_sessions_roundtrip(spark, tmp_path):
    f = td.flows(spark, SMALL)
    path = str(tmp_path / "sessions")
    IN.save_session(f.unionByName(f), path, "s1")
    back = IN.load_session(spark, path, "s1")
    assert back.count() == f.count()
    ts = [r["ts"] for r in back.select("ts").collect()]
    assert ts == sorted(ts)


def test_gz_lines(spark, tmp_path):
    d = tmp_path / "aws"
    d.mkdir()
    lines = ["version account-id interface-id srcaddr dstaddr srcport dstport protocol packets bytes start end action log-status",
             "2 1 eni-1 10.0.0.1 8.8.8.8 1234 53 17 1 101 1704067200 1704067205 ACCEPT OK",
             "2 1 eni-1 10.0.0.1 8.8.8.8 - - 99 1 10 900000000 800000000 REJECT OK",
             "2 1 eni-1 bad 8.8.8.8 1 2 6 1 10 1704067200 1704067205 ACCEPT OK",
             "2 1 eni-1 - - - - - - - 1704067200 1704067205 - NODATA"]
    with gzip.open(d / "a.log.gz", "wt") as fh:
        fh.write("\n".join(lines) + "\n")
    rows = spark.read.text(str(d))
    assert rows.count() == 5
    parsed = CL.parse_aws_vpc(rows, "aws", "vpc", ingest_time=dt.datetime(2024, 2, 1)).orderBy("dst_port").collect()
    assert len(parsed) == 2
    assert (parsed[0]["protocol"], parsed[0]["src_port"], parsed[0]["ts"]) == ("PROTO_99", 0, dt.datetime(2024, 2, 1))
    assert (parsed[1]["bytes_in"], parsed[1]["bytes_out"], parsed[1]["duration_ms"]) == (50, 51, 5000)


def test_stream_ingest_files(spark, tmp_path):
    from flowlens.streaming import jobs as J
    src = tmp_path / "in"
    src.mkdir()
    flows = [{"id": f"f{i}", "agent_id": "" if i % 2 else "a1", "hostname": "h", "timestamp": "2024-01-30T10:00:0%dZ" % i,
              "protocol": "HTTP", "src_ip": "10.0.0.1", "dst_ip": "185.220.101.7", "dst_port": 4444,
              "http": {"method": "GET", "path": "/x", "status": 200}} for i in range(4)]
    (src / "b1.json").write_text("\n".join(json.dumps(x) for x in flows) + "\n")
    stream = IN.read_flow_stream(spark, fmt="json", path=str(src))
    import uuid
    q = J.stream_ingest(stream, str(tmp_path / "flows"), str(tmp_path / "agents"), trigger={"availableNow": True},
                        blocklist=td_blocklist(spark), name=f"ingest_{uuid.uuid4().hex[:8]}")
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "flows"))
    assert out.count() == 4 and J.agent_sightings(spark, str(tmp_path / "agents")).count() == 1
    assert {r["threat_score"] for r in out.collect()} == {100}
    assert {r["info"] for r in out.collect()} == {"GET /x"}


def td_blocklist(spark):
    from flowlens.operators.enrich import builtin_blocklist
    return builtin_blocklist(spark)


def lines(d, name, n, mtime=None):
    d.mkdir(exist_ok=True)
    (d / name).write_text("".join(f"{name}-{i}\n" for i in range(n)))
    if mtime:
        os.utime(d / name, (mtime, mtime))


def take(spark, d, out, parse=lambda df: df):
    r = PU.pull(spark, "s", str(d), str(out), parse).first()
    return r["objects"], r["rows"], r["error"]


def test_each_object_is_pulled_once(spark, tmp_path):
    d, out = tmp_path / "in", tmp_path / "out"
    lines(d, "a.log", 3, 1_700_000_000)
    assert [take(spark, d, out) for _ in range(3)] == [(1, 3, ""), (0, 0, ""), (0, 0, "")]
    # two of the second of the first, one far older, one with the signs of a glob
    lines(d, "b.log", 2, 1_700_000_000)
    lines(d, "c.log", 1, 1_600_000_000)
    lines(d, "d[1]*{x}.log", 4, 1_700_000_000)
    lines(d / "deep", "e.log", 1)
    assert take(spark, d, out) == (4, 8, "")
    assert take(spark, d, out) == (0, 0, "")
    got = PU.pulled_rows(spark, str(out)).groupBy("pull").count().collect()
    assert {r["pull"]: r["count"] for r in got} == {1: 3, 4: 8}
    lines(d, "a.log", 5, 1_700_000_500)  # written anew
    assert take(spark, d, out) == (1, 5, "")
    assert PU.last_pull(spark, str(out)) == 6


def test_a_failed_pull_takes_nothing(spark, tmp_path):
    d, out = tmp_path / "in", tmp_path / "out"
    lines(d, "a.log", 3)

    def broken(_):
        raise ValueError("no access")
    assert take(spark, d, out, broken) == (0, 0, "no access")
    # killed after its rows, before its commit: they are not read, and the next pull replaces them
    spark.range(9).selectExpr("cast(id as string) value").write.parquet(str(out / "rows" / "pull=1"))
    assert take(spark, d, out) == (1, 3, "")
    assert PU.pulled_rows(spark, str(out)).count() == 3
    log = PU.pull_log(spark, str(out)).orderBy("error").collect()
    assert [(r["pull"], r["rows"], r["error"]) for r in log] == [(1, 3, ""), (1, 0, "no access")]
    assert log[0]["newest"] is not None and log[0]["duration_ms"] >= 0


def test_an_uncommitted_pull_is_not_read(spark, tmp_path):
    d, out = tmp_path / "in", tmp_path / "out"
    lines(d, "a.log", 3)
    take(spark, d, out)
    spark.range(9).selectExpr("cast(id as string) value").write.parquet(str(out / "rows" / "pull=2"))
    spark.createDataFrame([("file:/x", 1, dt.datetime(2024, 1, 1))], PU.OBJECTS).write.parquet(str(out / "objects" / "pull=2"))
    assert PU.pulled_rows(spark, str(out)).count() == 3
    assert take(spark, d, out) == (0, 0, "")


def test_pull_from_a_missing_folder_is_logged(spark, tmp_path):
    objects, rows, error = take(spark, tmp_path / "none", tmp_path / "out")
    assert (objects, rows) == (0, 0) and error


def test_spans_read_back_carry_no_document(spark, tmp_path):
    from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampNTZType

    from flowlens.plans.q_io import q_otlp_documents
    start = dt.datetime(2024, 1, 5, 10)
    rows = 2 * [(i, start + dt.timedelta(seconds=i), None if i % 50 == 7 else i % 9, ("view", "click", "error")[i % 3], 1.5,
                 None if i % 40 == 3 else f'{{"k": {i % 90}}}') for i in range(1300)]
    kinds = StructType([StructField("event_id", LongType()), StructField("ts", TimestampNTZType()), StructField("user_id", LongType()),
                        StructField("event_type", StringType())])
    events = spark.createDataFrame(rows, kinds.add("value", "double").add("props", "string"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    out = q_otlp_documents(spark, str(tmp_path))

    # every span of one busy hour comes back, repeats too, from documents of about 1,000
    spans = X.to_otel_spans(td.flows(spark, str(tmp_path)), window="30d")
    assert X.otlp_documents(spans).count() == 3
    key = ("traceId", "spanId", "name", "startTimeUnixNano")
    got = sorted(tuple(r) for r in out.select(*key).collect())
    assert got == sorted(tuple(r) for r in spans.select(*key).collect()) and len(got) > 2000
    assert len(set(got)) * 2 == len(got)
    assert {tuple(r) for r in out.select("service", "sdk", "scope", "version").collect()} == {("flowlens", "flowlens-hub", "flowlens-hub", "0.1.0")}

    # a row of the explode has text columns beside its span: with the span list of its document in it, work grows with the list's square
    plan = out._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Generate":
        plan = plan.children().head()
    kept = plan.requiredChildOutput()
    assert {kept.apply(i).dataType().simpleString() for i in range(kept.size())} == {"string"}
