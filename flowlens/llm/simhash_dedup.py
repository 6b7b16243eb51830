"""SimHash near-duplicates: fingerprints linked through Golay-code keys.

A 64-bit fingerprint is cut into three segments.  Two fingerprints at two bits or
less agree exactly in one segment and differ by one bit or less in the segment
after it (pigeonhole over the cycle of segments).  A key is therefore an exact
segment plus a Golay codeword index of the next: the index side files a
fingerprint under the nearest codeword, the probe side under the nearest
codewords of the segment and of its one-bit neighbours.  Pairs that meet in a
key are verified by their bit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm import golay
from flowlens.llm.common import cut, small_batches, with_columns

SEED = 42
MAX_DISTANCE = 2
#: (shift, bits) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: A key with more probe rows than this is resolved by one-bit neighbour stars instead of pairs.
PAIR_LIMIT = 128
_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the XXH64 of all word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, _CHUNK):
        hi = min(n, lo + _CHUNK)
        if len(words) < shingle:
            h = [digest(b" ".join(words), SEED)]
        else:
            h = [digest(b" ".join(words[i:i + shingle]), SEED) for i in range(lo, hi)]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    top = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(top, bitorder="little").view("<i8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, shingle) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(fps, pa.int64())],
                                             names=["doc_id", "th", "fp"])
    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, home, fp) rows: home marks the nearest codeword, one a segment."""
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False)
        seg = [((fp.view(np.uint64) >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
        for t in range(3):
            near = golay.near_indices(seg[(t + 1) % 3])
            home = near[:, :1]
            ordered = np.sort(near, axis=1)
            first = np.concatenate([np.ones_like(home, bool), ordered[:, 1:] != ordered[:, :-1]], axis=1)
            row, col = np.nonzero(first)
            index = ordered[row, col]
            key = (t << 34) | (seg[t][row] << 12) | index
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(index == home[row, 0]), pa.array(fp[row])], names=["key", "home", "fp"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(centre, fp): each fingerprint under itself and its 64 one-bit neighbours."""
    flips = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False)
        centre = (fp.view(np.uint64)[:, None] ^ flips[None, :]).view(np.int64).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(centre), pa.array(np.repeat(fp, 65))], names=["centre", "fp"])


def link_fingerprints(fps: DataFrame, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """Links (a, b) between the distinct values of `fp`, a < b, two bits apart at most.

    They join all that is reachable.  A key crowded by more than `pair_limit`
    fingerprints makes no pairs: its members are filed under their one-bit
    neighbours, where any two at distance two or less meet in a group of at most
    65, and each group is linked to its smallest.  So the work stays linear.
    """
    keys = cut(fps.mapInArrow(_keys, "key long, home boolean, fp long"))
    crowd = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > pair_limit).select("key"))
    quiet = keys.join(crowd, "key", "left_anti")
    index = quiet.filter("home").select("key", F.col("fp").alias("a"))
    probe = quiet.select("key", F.col("fp").alias("b"))
    pairs = (index.join(probe, "key").filter("a <> b")
             .filter(F.expr(f"bit_count(a ^ b) <= {MAX_DISTANCE}"))
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    members = keys.join(crowd, "key", "left_semi").select("fp").distinct()
    stars = members.mapInArrow(_stars, "centre long, fp long")
    group = Window.partitionBy("centre")
    stars = (stars.withColumn("a", F.min("fp").over(group)).filter("a <> fp")
             .select("a", F.col("fp").alias("b")))
    return cut(pairs.unionByName(stars).distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of `links` (a, b) reaches.

    Alternating large and small stars: every round hangs the neighbours of a node
    on the smallest of them, until all edges point at a root.  Rounds are cut in
    the checkpoint folder; hot nodes meet only partial minima and split joins.
    """
    edges, before = links.select(F.col("a").alias("lo"), F.col("b").alias("hi")), None
    while True:
        both = edges.union(edges.select("hi", "lo")).toDF("v", "u")
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = (both.filter("u > v").join(least, "v").select(F.col("m").alias("lo"), F.col("u").alias("hi"))
                 .filter("lo <> hi").distinct())
        large = cut(large)
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        edges = (large.join(small, "hi").select(F.col("m"), F.explode(F.array("lo", "hi")).alias("hi"))
                 .select(F.col("m").alias("lo"), "hi").filter("lo <> hi").distinct())
        edges = cut(edges)
        now = tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(lo, hi))")).first())
        if now == before or not now[0]:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = now


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, th, fp, component_id), one row per row of `docs`; th is the XXH64 of the text.

    Null and empty texts have fingerprint zero and link like any other.  Null ids
    are passed over when the smallest id of a component is taken; a component of
    null ids alone gets null.  Repeated rows share their component.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.col(f"`{text_col}`")
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), text.alias("text"))
    slim = cut(slim.mapInArrow(_fingerprints(shingle), "doc_id long, th long, fp long"))
    fps = slim.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(link_fingerprints(fps.select("fp")))
    fps = fps.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    fps = cut(fps.select("fp", "root", "least"))
    named = fps.groupBy("root").agg(F.min("least").alias("component_id"))
    fps = fps.join(named, "root").select("fp", "component_id", "root")
    return slim.join(fps, "fp").select("doc_id", "th", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, **cols: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each document."""
    return classify(docs, **cols).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each component: the smallest id (null last), then text hash.

    Rows that repeat id and text are one row's copies, of which any one stays.
    """
    rows = cut(classify(docs, id_col, text_col))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th")).alias("best")
    kept = rows.groupBy("root").agg(best).select("best.*").withColumnsRenamed({"doc_id": "__sd_id", "th": "__sd_th"})
    times = rows.groupBy(F.col("doc_id").alias("i"), F.col("th").alias("t")).agg(F.count(F.lit(1)).alias("__sd_n"))
    kept = cut(kept.join(times, F.col("__sd_id").eqNullSafe(F.col("i")) & (F.col("__sd_th") == F.col("t")))
               .select("__sd_id", "__sd_th", "__sd_n"))
    mine = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    out = with_columns(docs, __sd_own=mine).join(
        kept, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__sd_id")) & (F.col("__sd_own") == F.col("__sd_th")))
    once = out.filter("__sd_n = 1").select(*[f"`{c}`" for c in docs.columns])
    again = out.filter("__sd_n > 1").dropDuplicates(["__sd_id", "__sd_th"]).select(*[f"`{c}`" for c in docs.columns])
    return once.unionByName(again)
