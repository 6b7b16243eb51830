"""Nearest neighbours by inner product along shifted space-filling curves.

Vectors are lifted to one length (so that the largest inner product is the
smallest angle), projected at random to a few dimensions, shifted, and ordered
along a Hilbert curve; several such curves differ in projection and shift.  Spark
range-partitions every curve and numbers its vectors.  A query looks at the
window of ranks around its own on each curve; the finds of all windows are merged
and ranked by their inner product with the original vectors.

The window and the number of curves are fitted: for a bounded sample of queries
the true neighbours are found by brute force, for each number of curves the window
is made as wide as it takes to hold the wanted share of them, and the number that
has the fewest vectors to score is taken.  Clustered vectors are near each other on
every curve, so that a narrow window will do; vectors without any structure need
windows of a share of the table, and then two curves cost least.

Inner products need one length, so each length of vectors is a table of its own:
a long table has its own curves and window, and the lengths of a few vectors
each are compared whole, one group a length.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import cut, running_total

CURVES, LEAST_CURVES, DIMS, KEY_BITS = 12, 2, 6, 10
#: Placing a vector on a curve costs about as much as scoring this many.
PLACE_COST = 200
#: Rows of a block, the least window, and queries that one task holds at a time.
BLOCK, MIN_WINDOW, QUERY_CHUNK = 4096, 1024, 200_000
SCORED_TOGETHER = 64
SAMPLE_QUERIES, RECALL = 200, 0.96
FOUND = "q long, vid array<long>, rep array<long>, score array<double>"


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Position of integer points (n, dims) along the Hilbert curve of `bits` a dimension."""
    x = points.astype(np.int64).T.copy()
    dims, q = len(x), 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_keys(vectors: np.ndarray, longest: float, curve: int, query: bool, seed: int = 7) -> np.ndarray:
    """Keys of vectors on one curve; as data they are lifted to length `longest`, as queries scaled to it."""
    rng = np.random.default_rng([seed, curve, vectors.shape[1]])
    axes = np.linalg.qr(rng.standard_normal((vectors.shape[1] + 1, DIMS)))[0] if vectors.shape[1] + 1 >= DIMS else (
        rng.standard_normal((vectors.shape[1] + 1, DIMS)))
    unit = vectors / longest
    square = np.minimum((unit * unit).sum(axis=1), 1.0)
    if query:
        unit, rest = unit / np.sqrt(square)[:, None], np.zeros(len(unit))
    else:
        rest = np.sqrt(1.0 - square)
    spread = 2.0 / math.sqrt(vectors.shape[1] + 1)
    at = (unit @ axes[:-1] + rest[:, None] * axes[-1]) / (4 * spread) + 0.5 + (rng.random(DIMS) - 0.5) / 4
    return hilbert_index(np.clip(at * (1 << KEY_BITS), 0, (1 << KEY_BITS) - 1), KEY_BITS)


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _best(score: np.ndarray, rep: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller rep."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.nonzero(score >= least)[0]
    else:
        at = np.arange(len(score))
    return at[np.lexsort((rep[at], -score[at]))][:k]


def distinct_vectors(vectors: DataFrame, queries, k: int) -> tuple[DataFrame, DataFrame]:
    """Distinct usable vectors (vid, embedding, size, ids, rep, is_query), and their (vec_id, embedding) rows.

    ids: the k + 1 smallest ids of the vector, which is all a result can need; they
    are found by a rank limit that runs before the shuffle, so many copies of one
    vector stay cheap.
    """
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(
        "embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = cut(vectors.filter(F.col("vec_id").isNotNull() & usable).select("vec_id", "embedding").distinct())
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    ids = (rows.withColumn("nth", nth).filter(F.col("nth") <= k + 1)
           .groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    asked = rows.filter(queries).select("embedding").distinct().withColumn("asked", F.lit(True))
    out = ids.join(asked, "embedding", "left").select(
        F.monotonically_increasing_id().alias("vid"), "embedding", F.size("embedding").alias("size"), "ids", F.element_at("ids", 1).alias("rep"),
        F.coalesce("asked", F.lit(False)).alias("is_query"))
    return cut(out), rows


def _keyed(longest: float):
    def run(parts):
        for p in parts:
            if not len(p):
                continue
            m = _matrix(p["embedding"])
            for c in range(CURVES):
                yield pd.DataFrame({"curve": c, "key": curve_keys(m, longest, c, False), "vid": p["vid"], "asks": False})
                q = p["is_query"].to_numpy(bool)
                if q.any():
                    yield pd.DataFrame({"curve": c, "key": curve_keys(m[q], longest, c, True), "vid": p["vid"][q],
                                        "asks": True})
    return run


def rank_curves(base: DataFrame, longest: float) -> DataFrame:
    """(curve, vid, asks, rank): data ranks count the vectors of a curve from 0.

    A query row (asks) gets the rank of the vectors before its key.
    """
    keys = base.select("vid", "embedding", "is_query").mapInPandas(
        _keyed(longest), "curve int, key long, vid long, asks boolean")
    own = F.when(F.col("asks"), 0).otherwise(1)
    ranked = running_total(keys, [F.col(c) for c in ("curve", "key", "asks", "vid")], own, "before")
    n = base.count()
    return cut(ranked.select("curve", "vid", "asks",
                             (F.col("before") - own - F.col("curve") * F.lit(n)).alias("rank")))


def brute_force(base: DataFrame, sample: list, k: int) -> DataFrame:
    """(q, vid): the k best vectors of each sample query, out of all."""
    ids = np.array([r["vid"] for r in sample], np.int64)
    q = _matrix([r["embedding"] for r in sample])
    shared = base.sparkSession.sparkContext.broadcast((ids, q))

    def run(parts):
        own, ask = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))] * len(own)
        for p in parts:
            if len(p):
                score = ask @ _matrix(p["embedding"]).T
                rep, vid = p["rep"].to_numpy(np.int64), p["vid"].to_numpy(np.int64)
                for i, (v, r, s) in enumerate(best):
                    v, r, s = np.append(v, vid), np.append(r, rep), np.append(s, score[i])
                    at = _best(s, r, k)
                    best[i] = v[at], r[at], s[at]
        for q, (v, r, s) in zip(own, best, strict=True):
            yield pd.DataFrame({"q": q, "vid": v, "rep": r, "score": s})

    found = base.select("vid", "rep", "embedding").mapInPandas(run, "q long, vid long, rep long, score double")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))
    return found.withColumn("nth", nth).filter(F.col("nth") <= k).select("q", "vid")


def fit_windows(base: DataFrame, ranks: DataFrame, n: int, k: int, sample_queries: int = SAMPLE_QUERIES,
                recall: float = RECALL) -> tuple[int, int]:
    """(curves, window): how many curves to search, and the ranks to either side on each, so that `recall` of
    the sample queries' neighbours stand in some window and the least is placed and scored of the `n` vectors."""
    sample = base.filter("is_query").orderBy(F.xxhash64("vid", F.lit("fit")), "vid").limit(sample_queries).collect()
    if not sample:
        return LEAST_CURVES, MIN_WINDOW
    pairs = brute_force(base, sample, k + 1).filter("q <> vid")
    here = ranks.filter("asks").select(F.col("vid").alias("q"), "curve", F.col("rank").alias("at"))
    there = ranks.filter("not asks").select("vid", "curve", "rank")
    gap = (pairs.join(F.broadcast(here.join(F.broadcast(pairs.select("q").distinct()), "q")), "q")
           .join(there, ["vid", "curve"]).select("q", "vid", "curve", F.abs(F.col("rank") - F.col("at")).alias("gap")))
    found = gap.toPandas()  # at most sample_queries times k times CURVES
    if not len(found):
        return LEAST_CURVES, MIN_WINDOW
    gaps = found.pivot(index=["q", "vid"], columns="curve", values="gap").to_numpy()
    fits, queries = [], base.filter("is_query").count()
    for curves in range(LEAST_CURVES, CURVES + 1):
        near = np.sort(gaps[:, :curves].min(axis=1))
        window = max(MIN_WINDOW, int(near[min(len(near) - 1, math.ceil(recall * len(near)) - 1)]) + 1)
        held = 2 * window - window * window / n if window < n else n  # on average: windows end at the table's ends
        fits.append((curves * (queries * held + PLACE_COST * n), curves, window))
    return min(fits)[1:]


def _search(window: int, k: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["rank", "vid"])
        data, ask = group[~group["asks"]], group[group["asks"]]
        rows = []
        if len(data) and len(ask):
            m, vid, rep = _matrix(data["embedding"]), data["vid"].to_numpy(np.int64), data["rep"].to_numpy(np.int64)
            rank, at = data["rank"].to_numpy(np.int64), ask["rank"].to_numpy(np.int64)
            first, last = np.searchsorted(rank, at - window), np.searchsorted(rank, at + window, "right")
            # neighbouring queries share most of their windows
            for lo in range(0, len(ask), SCORED_TOGETHER):
                part = slice(lo, lo + SCORED_TOGETHER)
                here = first[part][0]
                score = _matrix(ask["embedding"].iloc[part]) @ m[here:last[part][-1]].T
                for s, q, f, e in zip(score, ask["vid"].iloc[part], first[part], last[part], strict=True):
                    best = f + _best(s[f - here:e - here], rep[f:e], k)
                    if len(best):
                        rows.append((int(q), vid[best].tolist(), rep[best].tolist(), s[best - here].tolist()))
        return pd.DataFrame(rows, columns=["q", "vid", "rep", "score"])
    return run


def _merge(k: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        vid, rep, score = (np.concatenate([np.asarray(x) for x in group[c]]) for c in ("vid", "rep", "score"))
        vid, first = np.unique(vid.astype(np.int64), return_index=True)
        rep, score = rep[first].astype(np.int64), score[first]
        at = _best(score, rep, k)
        return pd.DataFrame({"q": int(group["q"].iloc[0]), "vid": vid[at], "score": score[at]})
    return run


def _found_on_curves(base: DataFrame, n: int, longest: float, k: int, window: int | None, recall: float) -> DataFrame:
    """(q, vid, rep, score) arrays of what the windows of each query hold; `base` has n vectors of one length."""
    ranks = rank_curves(base, longest)
    if window is None:
        curves, w = fit_windows(base, ranks, n, k, recall=recall)
        ranks = ranks.filter(F.col("curve") < curves)
    else:
        w = window
    chunks = 1 + (BLOCK + 2 * w) // QUERY_CHUNK
    own = F.col("rank") - F.col("rank") % BLOCK
    first = F.greatest(F.lit(0), F.col("rank") - w)
    last = F.least(F.lit(n - 1), F.col("rank") + w)
    spots = F.when(F.col("asks"), F.sequence((first / BLOCK).cast("long"), (last / BLOCK).cast("long"))).otherwise(
        F.array((own / BLOCK).cast("long")))
    chunk = F.when(F.col("asks"), F.array(F.pmod(F.xxhash64("vid"), F.lit(chunks)))).otherwise(
        F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))
    placed = (ranks.select("curve", "vid", "asks", "rank", F.explode(spots).alias("block"), chunk.alias("chunk"))
              .withColumn("chunk", F.explode("chunk")).join(base.select("vid", "rep", "embedding"), "vid"))
    return placed.groupBy("curve", "block", "chunk").applyInPandas(_search(w, k + 1), FOUND)


def _found_in_groups(base: DataFrame, k: int) -> DataFrame:
    """The same for lengths of MIN_WINDOW vectors at most each, where any window holds all."""
    sides = F.when(F.col("is_query"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    placed = base.select("size", "vid", "rep", "embedding", F.lit(0).cast("long").alias("rank"), F.explode(sides).alias("asks"))
    return placed.groupBy("size").applyInPandas(_search(0, k + 1), FOUND)


def nearest(vectors: DataFrame, queries, k: int = 20, window: int | None = None, id_col: str = "vec_id",
            vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest vectors found for each query.

    `queries` is a condition on vec_id.  Nearness is the largest inner product in
    double precision, ties to the smaller id; a query is compared with the vectors
    of its own length.  Null, empty, zero and non-finite vectors and null ids take
    no part; fewer than k candidates are all returned.  Equal vectors are searched
    once and share their answer; rows that repeat id and vector count once.
    `window` None fits it and the number of curves to `recall`; else all curves are searched.
    """
    spark = vectors.sparkSession
    slim = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("embedding"))
    base, rows = distinct_vectors(slim, queries, k)
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    sizes = base.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("longest"))
    common = sizes.orderBy(F.desc("n"), "size").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # the most common length always goes by curves, others from the size on where a window leaves something out
    sizes = cut(sizes.filter(F.col("size") != common["size"]))
    long = [common, *sizes.filter(F.col("n") > MIN_WINDOW).orderBy("size").collect()]
    parts = [base.filter(F.col("size") == s["size"]) if len(long) > 1 or not sizes.isEmpty() else base for s in long]
    found = [_found_on_curves(p, s["n"], math.sqrt(s["longest"]), k, window, recall) for p, s in zip(parts, long, strict=True)]
    if not sizes.filter(F.col("n") <= MIN_WINDOW).isEmpty():
        found.append(_found_in_groups(base.filter(~F.col("size").isin([s["size"] for s in long])), k))
    found = reduce(DataFrame.unionByName, found)
    best = cut(found.groupBy("q").applyInPandas(_merge(k + 1), "q long, vid long, score double"))
    answers = (best.join(base.select("vid", "ids"), "vid").select("q", "score", F.explode("ids").alias("vec_id"))
               .groupBy("q").agg(F.collect_list(F.struct((-F.col("score")).alias("d"), "vec_id")).alias("found")))
    answers = answers.select("q", F.array_sort("found").alias("found"))
    asked = (rows.filter(queries).select(F.col("vec_id").alias("query_id"), "embedding")
             .join(base.filter("is_query").select("embedding", F.col("vid").alias("q")), "embedding")
             .select("query_id", "q").join(answers, "q"))
    mine = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (asked.select("query_id", F.posexplode(mine).alias("at", "x"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"),
                    (-F.col("x.d")).alias("score")))


def search_embeddings(vectors: DataFrame) -> DataFrame:
    """The 20 nearest of every row whose id is divisible by 20."""
    return nearest(vectors, F.col("vec_id") % 20 == 0)
