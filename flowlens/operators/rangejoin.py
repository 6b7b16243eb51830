"""Network join: attach the network (blocklist / geo) that contains an address.

A network is a masked key and a prefix length, so an address lies in it when the
address, cut to that length, equals it.  Addresses are looked up once each.

IPv4 addresses and networks meet in groups of the first 16 bits, which hold 65,536
addresses and 131,071 networks at most; a shorter network goes to each of its groups.
In the order of a group, the last network of a length before an address is the only
one of that length that can hold it, so one scan finds all candidates and an address
is shuffled once, however many lengths the table has.  IPv6 addresses are cut to
every IPv6 length of the table and joined on (length, masked key).

The winner of each address is joined back to the flows by the address text; a
hot address is one row there, and its flows are split by the skew join.  Nothing
is broadcast but the IPv6 prefix lengths, and what Spark sees under its own size
threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.ip import address_key, is_v4_key, mask_key, with_cidr
from flowlens.session import ensure_checkpoint_dir

#: Leading bits that IPv4 groups share.
GROUP_BITS = 16


def network_table(networks: DataFrame, net: str = "net", priority: Column | None = None,
                  payload: list[str] | None = None) -> DataFrame:
    """(v4, bits, masked, payload struct): one row per distinct network, the entry
    with the lowest ``priority`` (default: the longest prefix first).

    Lines that aren't a network are skipped.  Build it once and store it where the
    list is large; ``lookup`` takes it as it is.
    """
    keep = payload if payload is not None else [c for c in networks.columns]
    n = with_cidr(networks, net, "_net_")
    n = n.select(F.col("_net_bits").alias("bits"), F.col("_net_lo").alias("masked"), *[F.col(c) for c in keep],
                 (priority if priority is not None else -F.col("_net_bits")).cast("bigint").alias("_prio"))
    n = n.filter(F.col("masked").isNotNull()).withColumn("v4", is_v4_key(F.col("masked")) & (F.col("bits") >= 96))
    best = F.struct("_prio", *[F.col(c) for c in keep])
    return n.groupBy("v4", "bits", "masked").agg(F.min(best).alias("entry"))


def _low32(key: str) -> Column:
    return F.conv(F.substring(key, 25, 8), 16, 10).cast("bigint")


def _v4_hits(ips: DataFrame, table: DataFrame, lengths: list[int]) -> DataFrame:
    """(_ip, _entry) of IPv4 addresses (_ip, _key) that a network of ``table`` holds."""
    rest = 32 - GROUP_BITS
    nets = table.select((F.col("bits") - 96).alias("_bits"), _low32("masked").alias("_lo"), "entry")
    nets = nets.select(F.explode(F.sequence(F.shiftright("_lo", rest), F.shiftright("_lo", rest) + F.expr(
        f"shiftleft(1L, greatest({GROUP_BITS} - _bits, 0))") - 1)).alias("_group"), "_bits", "_lo", "entry")
    nets = nets.select("_group", F.greatest("_lo", F.shiftleft("_group", rest)).alias("_at"), F.lit(None).cast("string").alias("_ip"),
                       "_bits", "_lo", "entry")
    rows = ips.select(F.shiftright(_low32("_key"), rest).alias("_group"), _low32("_key").alias("_at"), "_ip",
                      F.lit(None).cast("int").alias("_bits"), F.lit(None).cast("bigint").alias("_lo"),
                      F.lit(None).cast(table.schema["entry"].dataType).alias("entry")).unionByName(nets)
    upto = (Window.partitionBy("_group").orderBy("_at", F.col("_ip").isNotNull())
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.select("_ip", "_at", *[F.last(F.when(F.col("_bits") == n, F.struct("_lo", "entry")), ignorenulls=True).over(upto)
                                       .alias(f"_net{n}") for n in lengths])
    held = [F.when(F.col(f"_net{n}._lo") == F.col("_at") - F.pmod(F.col("_at"), F.lit(1 << (32 - n))), F.col(f"_net{n}.entry"))
            for n in lengths]
    best = F.least(*held) if len(held) > 1 else held[0]
    return rows.filter(F.col("_ip").isNotNull()).select("_ip", best.alias("_entry")).filter(F.col("_entry").isNotNull())


def lookup(df: DataFrame, ip_cols: list[str], table: DataFrame, prefix: str = "") -> DataFrame:
    """Left-join the winning entry of ``table`` for each column of ``ip_cols``.

    Adds ``<prefix><column>_<payload>`` columns.  Rows whose text is no address, or
    that no network holds, keep nulls.  All columns share one pass over the
    distinct addresses.
    """
    payload = [f.name for f in table.schema["entry"].dataType.fields if f.name != "_prio"]
    ensure_checkpoint_dir(df.sparkSession)
    table = table.checkpoint()
    # one row per prefix length and version: 162 at most
    lengths = table.select("v4", "bits").distinct()
    v4_lengths = sorted(r["bits"] - 96 for r in lengths.filter("v4").collect())
    texts = df.select(F.explode(F.array_distinct(F.array(*ip_cols))).alias("_ip")).distinct()
    ips = texts.withColumn("_key", address_key("_ip")).withColumn("v4", is_v4_key(F.col("_key")))
    cut = (ips.filter(~F.col("v4")).join(F.broadcast(lengths.filter(~F.col("v4")).select("bits")))
           .withColumn("masked", mask_key(F.col("_key"), F.col("bits"))))
    hits = cut.join(table.filter(~F.col("v4")).drop("v4"), ["bits", "masked"]).groupBy("_ip").agg(F.min("entry").alias("_entry"))
    if v4_lengths:
        hits = hits.unionByName(_v4_hits(ips.filter("v4"), table.filter("v4"), v4_lengths))
    out = df
    for c in ip_cols:
        side = hits.select(F.col("_ip").alias(f"_ip_{c}"),
                           *[F.col(f"_entry.{p}").alias(f"{prefix}{c}_{p}") for p in payload])
        out = out.join(side, F.col(c) == F.col(f"_ip_{c}"), "left").drop(f"_ip_{c}")
    return out
