"""Per-connection protocol jobs re-aimed as table jobs: HTTP request/response
pairing, ICMP echo RTT, TCP health counters, trace-context / gRPC / DNS answers.

Ordered scans per connection use a *parallel prefix*: events are cut into ranges
of (key, order) of about the same number of rows, each key's share of a range
reduces to one partial (sum / last), a window over these partials gives each
range its offset, and the running value inside a range is offset + local running
value.  A connection carrying a third of all packets, be it in one hour or one
second, is thus spread over a third of the ranges, and the result is exact.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.session import ensure_checkpoint_dir


def in_parts(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with ``_part``, the number of their range of (``keys``, ``order``).

    The ranges follow a sample of the rows, so all hold about the same number and
    a busy key is cut wherever its rows are dense.  The table is written to the
    checkpoint folder, which fixes each row's range.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (df.repartitionByRange(n, *[F.col(c) for c in (*keys, *order)])
            .withColumn("_part", F.spark_partition_id()).checkpoint())


def running_sum(parts: DataFrame, keys: list[str], order: list[str], value: Column, out: str,
                before: bool = False) -> DataFrame:
    """``out``: sum(value) over the rows of ``keys`` up to this one, or ``before`` it, in ``parts`` of ``in_parts``."""
    d = parts.withColumn("_v", value)
    per = d.groupBy(*keys, "_part").agg(F.sum("_v").alias("_n"))
    wb = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_off", F.coalesce(F.sum("_n").over(wb), F.lit(0))).drop("_n")
    wi = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1 if before else Window.currentRow)
    d = d.join(per, keys + ["_part"]).withColumn(out, F.col("_off") + F.coalesce(F.sum("_v").over(wi), F.lit(0)))
    return d.drop("_v", "_off")


def pair_http(events: DataFrame, key: str = "conn_id") -> DataFrame:
    """Request/response pairing per connection (ordered by ts, seq): a request
    opens the slot only when none is pending, the next response closes it;
    latency = max(0, response - request) in ms.  Unanswered requests and
    responses without a pending request produce no pair."""
    is_resp = F.col("kind") == "response"
    parts = in_parts(events.select(key, "ts", "seq", "kind"), [key], ["ts", "seq"])
    g = running_sum(parts, [key], ["ts", "seq"], is_resp.cast("int"), "grp", before=True)
    req = g.filter(~is_resp).groupBy(key, "grp").agg(
        F.min_by(F.struct("ts", "seq"), F.struct("ts", "seq")).alias("r"))
    resp = g.filter(is_resp).select(key, "grp", F.col("seq").alias("response_seq"),
                                    F.col("ts").alias("response_ts"))
    p = req.join(resp, [key, "grp"])
    lat = (F.unix_micros("response_ts") - F.unix_micros(F.col("r.ts"))) / 1000
    return p.select(key, F.col("r.seq").alias("request_seq"), "response_seq",
                    F.col("r.ts").alias("request_ts"), "response_ts",
                    F.greatest(F.floor(lat), F.lit(0)).cast("long").alias("latency_ms"))


# fixed values: ICMP echo request/reply types (v4 and v6)
ECHO_REQUEST = [8, 128]
ECHO_REPLY = [0, 129]


def icmp_rtt(icmp: DataFrame) -> DataFrame:
    """Echo reply matched to the latest request with the same (host, id, seq)
    not yet answered; RTT in ms.  Both ICMPv4 and ICMPv6 echo types pair."""
    e = icmp.filter(F.col("icmp_type").isin(ECHO_REQUEST + ECHO_REPLY)).withColumn(
        "is_reply", F.col("icmp_type").isin(ECHO_REPLY)).withColumn(
        "host", F.when(F.col("is_reply"), F.col("dst_ip")).otherwise(F.col("src_ip")))
    keys = ["host", "echo_id", "echo_seq"]
    parts = in_parts(e.select(*keys, "ts", "seq", "is_reply"), keys, ["ts", "seq"])
    g = running_sum(parts, keys, ["ts", "seq"], F.col("is_reply").cast("int"), "grp", before=True)
    req = g.filter(~F.col("is_reply")).groupBy(*keys, "grp").agg(
        F.max_by(F.struct("ts", "seq"), F.struct("ts", "seq")).alias("r"))
    rep = g.filter("is_reply").select(*keys, "grp", F.col("seq").alias("reply_seq"),
                                      F.col("ts").alias("reply_ts"))
    p = req.join(rep, keys + ["grp"])
    return p.select(*keys, F.col("r.seq").alias("request_seq"), "reply_seq",
                    ((F.unix_micros("reply_ts") - F.unix_micros(F.col("r.ts"))) / 1000.0).alias("rtt_ms"))


WRAP = 2 ** 32
#: Sequence numbers of one span of a half-stream's ordered scan.
SEQ_SPAN = 1 << 20


def unwrap_sequence(segments: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``pos``: the 32-bit sequence number carried on past its wrap.

    Each segment moves by the signed 32-bit distance from the one before it; the
    distances are added up by a parallel prefix.
    """
    k = list(keys)
    parts = in_parts(segments, k, order)
    # the segment before: inside its range, else the last one of the range before
    last = parts.groupBy(*k, "_part").agg(F.max_by("tcp_seq", F.struct(*order)).alias("_last"))
    last = last.withColumn("_prev", F.lag("_last").over(Window.partitionBy(*k).orderBy("_part"))).drop("_last")
    inside = F.lag("tcp_seq").over(Window.partitionBy(*k, "_part").orderBy(*order))
    d = parts.join(last, k + ["_part"]).withColumn("_before", F.coalesce(inside, F.col("_prev")))
    step = F.pmod(F.col("tcp_seq") - F.col("_before") + F.lit(WRAP // 2), F.lit(WRAP)) - F.lit(WRAP // 2)
    d = d.withColumn("_step", F.when(F.col("_before").isNull(), F.col("tcp_seq")).otherwise(step)).drop("_before", "_prev")
    return running_sum(d, k, order, F.col("_step"), "pos").drop("_step", "_part")


def tcp_health(segments: DataFrame, keys=("conn_id", "direction")) -> DataFrame:
    """Segments, retransmissions and out-of-order segments of each half-stream.

    Reassembly holds a next expected position, first the position of the first
    segment.  A segment at it moves it past itself and past the held segments
    that follow on; one after it is out of order and held; one before it is a
    retransmission.  Segments without payload don't count.

    As tables: the stream advances through its distinct positions in order, and
    passes one when it and all before it have come.  So a segment is out of
    order if a position before its own is still missing then, else in order if
    it is the first at its position, else a retransmission.  The times are a
    running maximum over positions, taken in spans of the sequence.  Where
    segments overlap there is no such order.  The stream is cut at clean points:
    positions that no segment crosses, with all before them come before anything
    from them on.  Only pieces between two of these that hold an overlap are
    replayed, each from its first position; if one gets stuck, all after it waits.
    """
    k = list(keys)
    order = ["ts", "seg_id"]
    at = F.struct(*order)
    s = unwrap_sequence(segments.filter(F.col("length") > 0).select(*k, *order, "tcp_seq", "length"), k, order)
    # each of these is read several times
    s = s.checkpoint()
    first = s.groupBy(*k).agg(F.min_by("pos", at).alias("origin"))
    pos = (s.groupBy(*k, "pos").agg(F.min(at).alias("came"), F.min(F.col("pos") + F.col("length")).alias("end"),
                                    F.max(F.col("pos") + F.col("length")).alias("far"))
           .join(first, k).filter(F.col("pos") >= F.col("origin"))
           .withColumn("span", F.floor(F.col("pos") / SEQ_SPAN)))
    by_span = pos.groupBy(*k, "span").agg(F.max("far").alias("_far"), F.max("came").alias("_came"), F.min("came").alias("_next"))
    spans = Window.partitionBy(*k).orderBy("span")
    up_to, from_on = spans.rowsBetween(Window.unboundedPreceding, -1), spans.rowsBetween(1, Window.unboundedFollowing)
    by_span = by_span.select(*k, "span", F.max("_far").over(up_to).alias("_far"), F.max("_came").over(up_to).alias("_came"),
                             F.min("_next").over(from_on).alias("_next"))
    own = Window.partitionBy(*k, "span").orderBy("pos")
    inside = own.rowsBetween(Window.unboundedPreceding, -1)
    rest = own.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    pos = (pos.join(by_span, k + ["span"])
           .withColumn("reached", F.greatest("_far", F.max("far").over(inside)))
           .withColumn("before", F.greatest("_came", F.max("came").over(inside)))
           .withColumn("next", F.least("_next", F.min("came").over(rest))))
    gap = F.col("reached") < F.col("pos")
    overlap = (F.col("reached") > F.col("pos")) | (F.col("end") < F.col("far"))
    clean = F.col("reached").isNull() | ((F.col("reached") == F.col("pos")) & (F.col("before") < F.col("next")))
    # the piece of a position is the last clean one up to it
    pos = pos.withColumn("clean", F.when(clean, F.col("pos")))
    cuts = pos.groupBy(*k, "span").agg(F.max("clean").alias("_clean"))
    cuts = cuts.select(*k, "span", F.max("_clean").over(up_to).alias("_clean"))
    pos = pos.join(cuts, k + ["span"]).withColumn(
        "piece", F.coalesce(F.max("clean").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_clean")).checkpoint()
    hole = pos.filter(gap).groupBy(*k).agg(F.min("pos").alias("hole"))
    odd = (pos.filter(overlap).join(hole, k, "left").filter(F.col("hole").isNull() | (F.col("pos") < F.col("hole")))
           .select(*k, "piece").distinct().withColumn("odd", F.lit(True)))
    rows = (s.join(first, k).join(hole, k, "left")
            .join(pos.select(*k, "pos", "came", "before", "piece"), k + ["pos"], "left").join(odd, k + ["piece"], "left"))
    # what lies past a hole waits in any case
    replays = F.col("odd").isNotNull() & (F.col("hole").isNull() | (F.col("pos") < F.col("hole")))
    counts = "segments long, retransmissions long, out_of_order long"
    replayed = (rows.filter(replays).select(*k, "piece", *order, "pos", "length").groupBy(*k, "piece").applyInPandas(
        _replay(k), ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in s.select(*k).schema),
                               "piece long", counts, "stuck long"]))).checkpoint()
    stuck = replayed.groupBy(*k).agg(F.min("stuck").alias("stuck"))
    now = F.struct(*order)
    waits = (F.col("pos") >= F.least("hole", "stuck")) | (F.col("before") > now)
    kind = (F.when(F.col("pos") < F.col("origin"), "retransmit")
            .when(F.coalesce(waits, F.lit(False)), "out_of_order")
            .when(F.col("came") == now, "in_order").otherwise("retransmit"))
    even = rows.filter(~replays).join(stuck, k, "left").withColumn("kind", kind).groupBy(*k).agg(
        F.count(F.lit(1)).alias("segments"), F.count_if(F.col("kind") == "retransmit").alias("retransmissions"),
        F.count_if(F.col("kind") == "out_of_order").alias("out_of_order"))
    late = F.coalesce(F.col("piece") > F.col("least"), F.lit(False))
    pieces = replayed.join(stuck.withColumnRenamed("stuck", "least"), k).select(
        *k, "segments", F.when(late, 0).otherwise(F.col("retransmissions")).alias("retransmissions"),
        F.when(late, F.col("segments")).otherwise(F.col("out_of_order")).alias("out_of_order"))
    return even.unionByName(pieces).groupBy(*k).agg(*[F.sum(c).alias(c) for c in ("segments", "retransmissions", "out_of_order")])


def _replay(keys: list[str]):
    """Counters of one piece of a half-stream, segment by segment, and the position it is stuck at, if any."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "seg_id"])
        held: dict[int, int] = {}
        late = again = 0
        expected = int(key[-1])
        for pos, length in zip(pdf["pos"].tolist(), pdf["length"].tolist(), strict=True):
            if pos > expected:
                late += 1
                held[pos] = length
            elif pos < expected:
                again += 1
            else:
                while length:
                    expected += length
                    length = held.pop(expected, 0)
        stuck = expected if expected < int((pdf["pos"] + pdf["length"]).max()) else None
        return pd.DataFrame({**{c: [v] for c, v in zip([*keys, "piece"], key, strict=True)}, "segments": [len(pdf)],
                             "retransmissions": [again], "out_of_order": [late], "stuck": pd.array([stuck], "Int64")})
    return run


def extract_trace_context(flows: DataFrame, headers: str = "headers") -> DataFrame:
    """trace id / span id / sampled / source from HTTP headers, first match in
    priority traceparent > b3 > x-b3-* > x-trace-id > x-request-id > x-amzn-trace-id
    (Root= segment); header names compared case-insensitively."""
    h = F.col(headers)

    def find(name: str) -> Column:
        return F.get(F.filter(h, lambda x: F.lower(x["name"]) == name), 0)["value"]

    tp = F.split(find("traceparent"), "-")
    b3 = F.split(find("b3"), "-")
    tp_ok = F.size(tp) >= 4
    b3_ok = F.size(b3) >= 2
    amzn = find("x-amzn-trace-id")
    root = F.get(F.filter(F.split(amzn, ";"), lambda s: s.startswith("Root=")), 0)
    amzn_id = F.coalesce(F.substring(root, 6, 1 << 20), amzn)
    trace = (F.when(tp_ok, F.get(tp, 1)).when(b3_ok, F.get(b3, 0)).when(find("x-b3-traceid").isNotNull(), find("x-b3-traceid"))
             .when(find("x-trace-id").isNotNull(), find("x-trace-id"))
             .when(find("x-request-id").isNotNull(), find("x-request-id"))
             .when(amzn.isNotNull(), amzn_id))
    span = (F.when(tp_ok, F.get(tp, 2)).when(b3_ok, F.get(b3, 1))
            .when(find("x-b3-traceid").isNotNull(), find("x-b3-spanid")))
    sampled = (F.when(tp_ok, F.get(tp, 3) == "01").when(b3_ok, F.coalesce(F.get(b3, 2) == "1", F.lit(False)))
               .when(find("x-b3-traceid").isNotNull(), F.coalesce(find("x-b3-sampled") == "1", F.lit(False))))
    source = (F.when(tp_ok, "traceparent").when(b3_ok, "b3").when(find("x-b3-traceid").isNotNull(), "x-b3-traceid")
              .when(find("x-trace-id").isNotNull(), "x-trace-id")
              .when(find("x-request-id").isNotNull(), "x-request-id")
              .when(amzn.isNotNull(), "x-amzn-trace-id"))
    return flows.withColumn("trace_id", trace).withColumn("span_id", span) \
                .withColumn("sampled", sampled).withColumn("trace_source", source)


def grpc_calls(flows: DataFrame, headers: str = "headers") -> DataFrame:
    """HTTP/2 flows with a content-type header starting application/grpc ->
    service / method from the path '/[pkg.]Service/Method'; rollup per
    service, method and grpc-status."""
    h = F.col(headers)
    is_grpc = F.exists(h, lambda x: (F.lower(x["name"]) == "content-type")
                       & x["value"].startswith("application/grpc"))
    status = F.get(F.filter(h, lambda x: F.lower(x["name"]) == "grpc-status"), 0)["value"]
    path = F.regexp_replace(F.col("http_path"), "^/+", "")
    g = flows.filter(is_grpc).select(
        F.substring_index(path, "/", 1).alias("service"),
        F.when(path.contains("/"), F.expr("substr(regexp_replace(http_path, '^/+', ''), "
                                          "instr(regexp_replace(http_path, '^/+', ''), '/') + 1)")).alias("method"),
        F.coalesce(status, F.lit("")).alias("grpc_status"), "duration_ms")
    return g.groupBy("service", "method", "grpc_status").agg(
        F.count(F.lit(1)).alias("calls"), F.avg("duration_ms").alias("avg_latency_ms"))


def dns_answers(flows: DataFrame) -> DataFrame:
    """One row per DNS answer record of response flows."""
    d = flows.filter(F.col("dns").isNotNull() & F.col("dns.is_response"))
    return d.select("id", "ts", F.col("dns.query_name").alias("query_name"),
                    F.posexplode("dns.answers").alias("pos", "answer"))


def dns_rates(flows: DataFrame) -> DataFrame:
    """Per query type: queries, responses and rcode mix (NXDOMAIN / SERVFAIL rates)."""
    from flowlens.functions.labels import dns_rcode_name
    d = flows.filter(F.col("dns").isNotNull())
    rc = dns_rcode_name(F.col("dns.rcode"))
    resp = F.col("dns.is_response")
    return d.groupBy(F.col("dns.query_type").alias("query_type")).agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(resp).alias("responses"),
        F.count_if(resp & (rc == "NXDOMAIN")).alias("nxdomain"),
        F.count_if(resp & (rc == "SERVFAIL")).alias("servfail"),
        (F.count_if(resp & (rc == "NXDOMAIN")) * 100.0 / F.greatest(F.count_if(resp), F.lit(1))).alias("nxdomain_pct"))
