"""Mixing sources to target weights by weighted fair queueing (DataFrame only).

Every source is a queue of its documents in a shuffled order, up to `max_epochs`
times over.  A document copy finishes at virtual time (words of its source up to
and including it) / (target of the source).  All copies are range-sorted by
finish time and the mix is cut where the running total would pass the budget.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import WORD_PATTERN, cut, running_total, with_columns

#: One row a source, of its name and a few numbers; more sources than this are joined by a shuffle.
MAX_BROADCAST_SOURCES = 10_000


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: int) -> tuple[DataFrame, float]:
    """Targets of (source, source_size): weights repeat along the sources in code
    point order, null last; together `share` of all words; a target stops at
    `max_epochs` times its source and the excess is shared again by weight.

    Returns the table with weight and target, and the budget.  The loop runs over
    aggregates of the source table, never over its rows.
    """
    ranked = running_total(sizes.withColumn("__mx_null", F.col("source").isNull()),
                           [F.col("__mx_null"), F.col("source")], F.lit(1), "rank").drop("__mx_null")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    src = cut(ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs))
    total = src.agg(F.sum("source_size")).first()[0] or 0
    budget, level, capped = total * share, 0.0, -1
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        n, caps, left = src.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))),
                                F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped or not left:
            break
        capped, level = n, (budget - (caps or 0)) / left
    target = F.when(F.col("cap") <= F.lit(level) * F.col("weight"), F.col("cap").cast("double")).otherwise(
        F.lit(level) * F.col("weight"))
    return src.withColumn("target", target).drop("rank", "cap"), budget


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                seed: str = "mix") -> DataFrame:
    """Each row of `docs` with size, source_size, target and taken (words the mix
    takes from it, repeats counted).

    The shuffled order is the md5 of seed, id and text, so reruns agree; rows that
    agree in id and text tie and are taken together.  Only (source, size, order)
    travels; the decision comes back as one cut per source and epoch.  Null or
    empty text: size 0, taken 0.  Null source: a source of its own, last.  Null
    id: ordered by its text.  Empty table: no rows.  Input columns called size,
    source_size, target or taken are replaced.
    """
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`")
    order = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")),
                              F.md5(F.coalesce(text, F.lit("")))))
    slim = docs.select(source.cast("string").alias("source"), word_count(text).alias("size"), order.alias("ord"))
    queue = cut(slim.groupBy("source", "ord").agg(F.sum("size").alias("size")))
    sizes = queue.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets, budget = source_targets(sizes, weights, share, max_epochs)
    targets = cut(targets)

    # words of the source up to a document: the running total over (source, order) less that of earlier sources
    first = running_total(targets.withColumn("last", F.col("source").isNull()),
                          [F.col("last"), F.col("source")], F.col("source_size"), "through")
    first = first.select(F.col("source").alias("s"), (F.col("through") - F.col("source_size")).alias("before"),
                         "source_size", "target")
    along = running_total(queue.filter("size > 0").withColumn("last", F.col("source").isNull()),
                          [F.col("last"), F.col("source"), F.col("ord")], F.col("size"), "through")
    along = along.join(first, F.col("source").eqNullSafe(F.col("s"))).withColumn("cum", F.col("through") - F.col("before"))
    copies = along.select("last", "source", "ord", "size", "target", "cum", "source_size",
                          F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch"))
    finish = (F.col("cum") + F.col("epoch") * F.col("source_size")) / F.col("target")
    copies = copies.filter("target > 0").select("last", "source", "ord", "epoch", "size", finish.alias("finish"))
    mixed = running_total(copies, [F.col(c) for c in ("finish", "last", "source", "epoch", "ord")], F.col("size"), "mixed")
    cuts = (mixed.filter(F.col("mixed") <= F.lit(budget))
            .groupBy("source").agg(*[F.max(F.when(F.col("epoch") == e, F.col("ord"))).alias(f"cut{e}")
                                     for e in range(max_epochs)]))
    plan = targets.join(cuts.withColumnRenamed("source", "c"), F.col("source").eqNullSafe(F.col("c")), "left")
    plan = cut(plan.select(F.col("source").alias("__mx_source"), F.col("source_size").alias("__mx_source_size"),
                           F.col("target").alias("__mx_target"),
                           *[F.col(f"cut{e}").alias(f"__mx_cut{e}") for e in range(max_epochs)]))
    if plan.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    out = (docs.withColumn("__mx_size", word_count(text)).withColumn("__mx_order", order)
           .join(plan, source.cast("string").eqNullSafe(F.col("__mx_source"))))
    copies = sum((F.when(F.col("__mx_order") <= F.col(f"__mx_cut{e}"), 1).otherwise(0) for e in range(max_epochs)),
                 F.lit(0))
    out = with_columns(out, size=F.col("__mx_size"), source_size=F.col("__mx_source_size"),
                       target=F.col("__mx_target"), taken=(copies * F.col("__mx_size")).cast("long"))
    return out.drop(*[c for c in out.columns if c.startswith("__mx_")])


#: DuckDB text of the same mix with the default parameters.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  md5(concat_ws('|', 'mix', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) AS ord
           FROM documents),
q AS (SELECT source, ord, sum(size) AS size FROM d GROUP BY source, ord),
s AS (SELECT source, sum(size) AS source_size, 2 * sum(size) AS cap,
             ([3.0, 1.0, 2.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
      FROM q GROUP BY source),
b AS (SELECT sum(source_size) * CAST(1.5 AS DOUBLE) AS budget, CAST(sum(weight) AS DOUBLE) AS w FROM s),
r AS (SELECT *, cap / weight AS ratio FROM s),
l AS (SELECT DISTINCT a.ratio, (SELECT budget FROM b) - sum(z.cap) AS left_words,
             (SELECT w FROM b) - CAST(sum(z.weight) AS DOUBLE) AS left_weight
      FROM (SELECT DISTINCT ratio FROM r) a JOIN r z ON z.ratio <= a.ratio GROUP BY a.ratio),
v AS (SELECT budget / w AS level FROM b
      UNION ALL SELECT left_words / left_weight FROM l WHERE left_weight > 0),
level AS (SELECT max(level) AS level FROM v
          WHERE level >= (SELECT budget / w FROM b)),
t AS (SELECT source, source_size, CASE WHEN cap <= level * weight THEN CAST(cap AS DOUBLE)
             ELSE level * CAST(weight AS DOUBLE) END AS target FROM s, level),
c AS (SELECT q.source, q.ord, q.size, t.target, e.epoch,
             (sum(q.size) OVER (PARTITION BY q.source, e.epoch ORDER BY q.ord) + e.epoch * t.source_size) / t.target AS finish
      FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) e(epoch)
      WHERE q.size > 0 AND t.target > 0),
m AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, epoch, ord
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mixed FROM c),
k AS (SELECT source, ord, count(*) AS copies FROM m WHERE mixed <= (SELECT budget FROM b) GROUP BY source, ord)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, CAST(t.source_size AS BIGINT) AS source_size, t.target,
       CAST(d.size * coalesce(k.copies, 0) AS BIGINT) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
LEFT JOIN k ON k.source IS NOT DISTINCT FROM d.source AND k.ord = d.ord
"""
