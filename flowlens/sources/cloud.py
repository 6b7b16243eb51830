"""Cloud flow-log parsers: AWS VPC flow logs, GCP VPC flow logs, Azure NSG flow logs.

Input is a DataFrame of raw text lines / JSON documents (``spark.read.text``
reads plain and ``.gz`` files natively, one task per file split); every parse
step is a column expression, so parsing runs in the scan's codegen stage.
Row ids are a content hash (deterministic across task retries, unlike uuid()).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.ip import is_valid_ip
from flowlens.functions.labels import ip_proto_name
from flowlens.schema import conform_flows


def _uint(text: Column, maximum: int | None = None) -> Column:
    """Go ParseUint: digits only else 0; out of range -> the type's maximum."""
    v = text.cast("decimal(20,0)")
    if maximum is not None:
        v = F.least(v, F.lit(maximum))
    return F.coalesce(F.when(text.rlike(r"^[0-9]{1,19}$"), v).cast("bigint"), F.lit(0).cast("bigint"))


def _int(text: Column) -> Column:
    return F.coalesce(F.when(text.rlike(r"^-?[0-9]{1,18}$"), text.cast("bigint")), F.lit(0).cast("bigint"))


#: Seconds at the start of the year 2000, UTC.
_YEAR_2000 = 946_684_800


def _row_id(*parts: Column) -> Column:
    h = F.sha2(F.concat_ws("\u0001", *parts), 256)
    return F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12))


def _now(ingest_time) -> Column:
    if ingest_time is None:
        return F.current_timestamp()
    if isinstance(ingest_time, Column):
        return ingest_time
    return F.lit(ingest_time).cast("timestamp")


def parse_aws_vpc(lines: DataFrame, source_id: str, source_name: str, col: str = "value",
                  ingest_time=None) -> DataFrame:
    """Version-2 records: >= 14 whitespace fields; header / NODATA / SKIPDATA and
    invalid IP pairs skipped; proto number -> name; duration (end-start)*1000
    when positive; start before 2000 -> ingest time; bytes split half in, rest out.
    REJECT records are kept."""
    f = F.split(F.regexp_replace(F.col(col), r"^\s+|\s+$", ""), r"\s+")
    # fields that several columns are made of are taken out once; the row's text stays for its id
    d = lines.select(F.col(col).alias("_line"), f.alias("f")).filter(
        (F.size("f") >= 14) & (F.get("f", 0) != "version") & ~F.get("f", 13).isin("NODATA", "SKIPDATA"))
    d = d.select("_line", *[F.get("f", i).alias(n) for i, n in (
        (3, "src_ip"), (4, "dst_ip"), (5, "src"), (6, "dst"), (7, "proto"), (9, "byts"), (10, "start"), (11, "end"), (12, "action"))])
    d = d.filter(is_valid_ip("src_ip") & is_valid_ip("dst_ip"))
    d = d.withColumns({"start": _int(F.col("start")), "end": _int(F.col("end")), "byts": _uint(F.col("byts"))})
    ts = F.timestamp_seconds("start")
    half = F.floor(F.col("byts") / 2).cast("bigint")
    return d.select(
        _row_id(F.lit(source_id), F.col("_line")).alias("id"), F.lit(source_id).alias("agent_id"),
        F.lit(source_name).alias("hostname"), F.when(F.col("start") < _YEAR_2000, _now(ingest_time)).otherwise(ts).alias("ts"),
        ip_proto_name(_uint(F.col("proto"), 255)).alias("protocol"),
        "src_ip", _uint(F.col("src"), 65535).cast("int").alias("src_port"),
        "dst_ip", _uint(F.col("dst"), 65535).cast("int").alias("dst_port"),
        half.alias("bytes_in"), (F.col("byts") - half).alias("bytes_out"),
        F.when(F.col("end") > F.col("start"), (F.col("end") - F.col("start")) * 1000).otherwise(0).cast("bigint").alias("duration_ms"),
        "action", F.lit("aws-vpc").alias("source"))


GCP_SCHEMA = T.StructType([
    T.StructField("connection", T.StructType([T.StructField(n, T.StringType()) for n in
                                              ["src_ip", "dest_ip", "src_port", "dest_port", "protocol"]])),
    T.StructField("bytes_sent", T.StringType()), T.StructField("start_time", T.StringType()),
    T.StructField("end_time", T.StringType())])
GCP_ENVELOPE = T.StructType([T.StructField("jsonPayload", GCP_SCHEMA)] + GCP_SCHEMA.fields)


def _rfc3339(text: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")),
                      F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")),
                      F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSXXX")))


def _num(text: Column) -> Column:
    """Number given as JSON number or string -> non-negative integer (0 if not)."""
    v = F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), F.floor(text.cast("double")))
    return F.coalesce(v.cast("bigint"), F.lit(0).cast("bigint"))


def parse_gcp_vpc(docs: DataFrame, source_id: str, source_name: str, col: str = "value",
                  ingest_time=None) -> DataFrame:
    """One JSON entry per row, optionally wrapped in ``jsonPayload``; a missing
    connection block or invalid IPs skip the entry; protocol upper-cased
    (default TCP); RFC3339 start/end -> duration ms when end is after start."""
    j = F.from_json(F.col(col), GCP_ENVELOPE)
    d = docs.select(F.col(col).alias("_doc"), F.coalesce(j["jsonPayload"], j.dropFields("jsonPayload")).alias("p"))
    c = F.col("p.connection")
    d = d.filter(c.isNotNull() & is_valid_ip(c["src_ip"]) & is_valid_ip(c["dest_ip"]))
    start = _rfc3339(F.col("p.start_time"))
    end = _rfc3339(F.col("p.end_time"))
    ts = F.coalesce(start, _now(ingest_time))
    dur = F.when(end.isNotNull() & start.isNotNull() & (end > start),
                 F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000)).otherwise(0)
    byts = _num(F.col("p.bytes_sent"))
    proto = F.upper(F.coalesce(c["protocol"], F.lit("")))
    return d.select(
        _row_id(F.lit(source_id), F.col("_doc")).alias("id"), F.lit(source_id).alias("agent_id"),
        F.lit(source_name).alias("hostname"), ts.alias("ts"),
        F.when(proto == "", "TCP").otherwise(proto).alias("protocol"),
        c["src_ip"].alias("src_ip"), F.least(_num(c["src_port"]), F.lit(65535)).cast("int").alias("src_port"),
        c["dest_ip"].alias("dst_ip"), F.least(_num(c["dest_port"]), F.lit(65535)).cast("int").alias("dst_port"),
        F.floor(byts / 2).cast("bigint").alias("bytes_in"), (byts - F.floor(byts / 2)).cast("bigint").alias("bytes_out"),
        dur.cast("bigint").alias("duration_ms"), F.lit("gcp-vpc").alias("source"))


AZURE_SCHEMA = T.StructType([T.StructField("records", T.ArrayType(T.StructType([
    T.StructField("properties", T.StructType([T.StructField("flows", T.ArrayType(T.StructType([
        T.StructField("rule", T.StringType()),
        T.StructField("flows", T.ArrayType(T.StructType([
            T.StructField("mac", T.StringType()),
            T.StructField("flowTuples", T.ArrayType(T.StringType()))])))])))]))])))])


def parse_azure_nsg(docs: DataFrame, source_id: str, source_name: str, col: str = "value",
                    ingest_time=None) -> DataFrame:
    """records -> properties.flows -> flows -> flowTuples; >= 9 CSV fields;
    'U' -> UDP else TCP; bytes only with >= 13 fields (sent = 10, received = 12)."""
    j = F.from_json(F.col(col), AZURE_SCHEMA)
    d = docs.select(F.explode(j["records"]).alias("r")) \
            .select(F.explode("r.properties.flows").alias("g")) \
            .select(F.explode("g.flows").alias("m")) \
            .select(F.explode("m.flowTuples").alias("t"))
    d = d.select("t", F.split("t", ",").alias("p"))
    d = d.filter((F.size("p") >= 9) & is_valid_ip(F.get("p", 1)) & is_valid_ip(F.get("p", 2)))
    ts = F.timestamp_seconds(_int(F.get("p", 0)))
    ts = F.when(F.year(ts) < 2000, _now(ingest_time)).otherwise(ts)
    full = F.size("p") >= 13
    return d.select(
        _row_id(F.lit(source_id), F.col("t")).alias("id"), F.lit(source_id).alias("agent_id"),
        F.lit(source_name).alias("hostname"), ts.alias("ts"),
        F.when(F.upper(F.get("p", 5)) == "U", "UDP").otherwise("TCP").alias("protocol"),
        F.get("p", 1).alias("src_ip"), _uint(F.get("p", 3), 65535).cast("int").alias("src_port"),
        F.get("p", 2).alias("dst_ip"), _uint(F.get("p", 4), 65535).cast("int").alias("dst_port"),
        F.when(full, _uint(F.get("p", 12))).otherwise(0).cast("bigint").alias("bytes_in"),
        F.when(full, _uint(F.get("p", 10))).otherwise(0).cast("bigint").alias("bytes_out"),
        F.lit(0).cast("bigint").alias("duration_ms"), F.lit("azure-nsg").alias("source"))


def read_cloud_files(spark: SparkSession, path: str, kind: str, source_id: str, source_name: str,
                     modified_after: dt.datetime | None = None, ingest_time=None) -> DataFrame:
    """Read plain or .gz log objects (optionally only those modified after the
    last pull) and parse them.  Azure blobs are whole JSON documents."""
    reader = spark.read
    if modified_after is not None:
        reader = reader.option("modifiedAfter", modified_after.strftime("%Y-%m-%dT%H:%M:%S"))
    if kind == "aws":
        return parse_aws_vpc(reader.text(path), source_id, source_name, ingest_time=ingest_time)
    if kind == "gcp":
        return parse_gcp_vpc(reader.text(path), source_id, source_name, ingest_time=ingest_time)
    if kind == "azure":
        return parse_azure_nsg(reader.option("wholetext", True).text(path), source_id, source_name,
                               ingest_time=ingest_time)
    raise ValueError(kind)


def to_flows(parsed: DataFrame) -> DataFrame:
    """Cloud rows onto the flat flow schema (missing columns get defaults)."""
    return conform_flows(parsed)
