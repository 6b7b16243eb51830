"""Port scans at every moment: distinct ports in a sliding window, by an interval sweep.

A sighting of (source, port) keeps the port in the window for its length.  Sightings
are first reduced to one row per (source, port, stretch of the window's length), which
loses nothing, as sightings inside a stretch never let the port fall out.  What is left
joins up into spans; a span is +1 at its start and -1 at its end, and the running sum
of these steps is the exact distinct count at every moment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.timewin import interval
from flowlens.operators.sessions import in_parts, running_sum


def port_spans(flows: DataFrame, minutes: int = 5) -> DataFrame:
    """(src_ip, dst_port, began, until): times at which the port is among those that the
    source probed in the last ``minutes``; ``until`` itself is outside."""
    length = interval(f"{minutes} MINUTES")
    probes = flows.filter(F.col("protocol").isin("TCP", "UDP") & F.col("ts").isNotNull())
    near = probes.groupBy("src_ip", "dst_port", F.window("ts", f"{minutes} minutes").start.alias("stretch")).agg(
        F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    w = Window.partitionBy("src_ip", "dst_port").orderBy("stretch")
    near = near.select("src_ip", "dst_port", "stretch", "lo", "hi", F.lag("hi").over(w).alias("before"), F.lead("lo").over(w).alias("after"))
    starts = F.col("before").isNull() | (F.col("before") + length <= F.col("lo"))
    ends = F.col("after").isNull() | (F.col("hi") + length <= F.col("after"))
    edges = near.filter(starts | ends).select("src_ip", "dst_port", "stretch", F.when(starts, F.col("lo")).alias("began"),
                                              F.when(ends, F.col("hi") + length).alias("until"))
    # a span's end stands in its own row or in that of a later stretch, the next with an end
    onward = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (edges.withColumn("until", F.first("until", ignorenulls=True).over(onward))
            .filter(F.col("began").isNotNull()).select("src_ip", "dst_port", "began", "until"))


def port_counts(flows: DataFrame, minutes: int = 5) -> DataFrame:
    """(src_ip, at, new_ports, port_count): at each moment when a source's set of recently
    probed ports changes, how many are new and how many there are."""
    spans = port_spans(flows, minutes)
    step = spans.select("src_ip", F.explode(F.array(
        F.struct(F.col("began").alias("at"), F.lit(1).alias("plus"), F.lit(0).alias("minus")),
        F.struct(F.col("until").alias("at"), F.lit(0).alias("plus"), F.lit(1).alias("minus")))).alias("s"))
    steps = step.groupBy("src_ip", F.col("s.at").alias("at")).agg(
        F.sum("s.plus").alias("new_ports"), (F.sum("s.plus") - F.sum("s.minus")).alias("step"))
    parts = in_parts(steps, ["src_ip"], ["at"])
    return running_sum(parts, ["src_ip"], ["at"], F.col("step"), "port_count").drop("step", "_part")


def port_scans(flows: DataFrame, minutes: int = 5, min_ports: int = 50) -> DataFrame:
    """(src_ip, at, port_count): each moment at which a source's distinct ports of the last
    ``minutes`` come to exceed ``min_ports``.

    Windows end at every moment, so a scan over the edge of tumbling windows is found.
    A flow without source, port or time is left out.
    """
    counts = port_counts(flows.filter(F.col("src_ip").isNotNull() & F.col("dst_port").isNotNull()), minutes)
    return counts.filter((F.col("port_count") > min_ports) & (F.col("port_count") - F.col("new_ports") <= min_ports)) \
                 .select("src_ip", "at", "port_count")
