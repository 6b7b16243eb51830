"""Preference formatting: one prompt, two masked completions.

The turns of a chosen and a rejected conversation are compared from the start;
their longest common prefix is rendered once as the prompt, and the rest of each
becomes a completion whose mask names the characters to train on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the rendered form; text that looks like one is parted by a space.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _clean(col: Column) -> Column:
    return F.replace(F.coalesce(col, F.lit("")), F.lit("<|"), F.lit("< |"))


def _render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"), turn["text"], F.lit(CLOSE + "\n"))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _mask(turns: Column, trained: str) -> Column:
    """Spans start:end (characters of the completion) of the trained turns, their end mark included."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        first = state["at"] + len(OPEN) + F.length(turn["role"]) + 1
        last = first + F.length(turn["text"]) + len(CLOSE)
        span = F.when(turn["role"] == trained, F.array(F.concat_ws(":", first.cast("string"), last.cast("string"))))
        return F.struct((last + 1).alias("at"),
                        F.concat(state["spans"], F.coalesce(span, F.array().cast("array<string>"))).alias("spans"))

    return F.array_join(F.aggregate(turns, start, step, lambda s: s["spans"]), ",")


def format_preferences(turns: DataFrame, pair: Column, is_chosen: Column, trained: str = "assistant") -> DataFrame:
    """One row per pair: pair_id, chosen_id, rejected_id, prompt_turns, prompt, the two
    completions and their masks.

    `pair` and `is_chosen` are expressions over conv_id.  Turns are ordered by
    turn (null last), then role and text; null role or text is empty.  Rows that
    repeat a turn stay turns of their own.  Rows with a null pair are left out.  A
    missing side is a conversation without turns.  Equal conversations give a
    prompt and two empty completions.
    """
    turn = F.struct(F.col("turn").isNull().alias("z"), F.col("turn").alias("turn"), _clean(F.col("role")).alias("role"),
                    _clean(F.col("text")).alias("text"))
    sides = (turns.select(pair.alias("pair_id"), is_chosen.alias("c"), F.col("conv_id").alias("id"), turn.alias("t"))
             .filter("pair_id is not null").groupBy("pair_id")
             .agg(*[f(F.when(F.col("c") == w, F.col(x))).alias(f"{s}_{x}")
                    for s, w in (("chosen", True), ("rejected", False)) for f, x in ((F.min, "id"), (F.collect_list, "t"))]))
    plain = lambda c: F.transform(F.array_sort(c), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    sides = sides.select("pair_id", "chosen_id", "rejected_id", plain("chosen_t").alias("a"), plain("rejected_t").alias("b"))
    both = F.least(F.size("a"), F.size("b"))
    differ = F.filter(F.transform(F.arrays_zip("a", "b"), lambda x, i: F.when(x["a"].eqNullSafe(x["b"]), both).otherwise(i)),
                      lambda i: i < both)
    sides = sides.withColumn("prompt_turns", F.coalesce(F.array_min(differ), both))
    n = F.col("prompt_turns")
    rest = lambda c: F.slice(c, n + 1, F.greatest(F.size(c) - n, F.lit(0)))
    return sides.select("pair_id", "chosen_id", "rejected_id", "prompt_turns", _joined(F.slice("a", F.lit(1), n)).alias("prompt"),
                        _joined(rest("a")).alias("chosen"), _joined(rest("b")).alias("rejected"),
                        _mask(rest("a"), trained).alias("chosen_mask"), _mask(rest("b"), trained).alias("rejected_mask"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """Conversations paired by number: an even one is chosen over the odd one after it."""
    conv = F.col("conv_id").cast("long")
    return format_preferences(turns, F.floor(conv / 2).cast("long"), F.pmod(conv, F.lit(2)) == 0)


ORACLE_SQL = r"""
WITH t AS (SELECT CAST(floor(conv_id / 2.0) AS BIGINT) AS pair_id, ((conv_id % 2) + 2) % 2 = 0 AS c, conv_id AS id, turn,
                  replace(coalesce(role, ''), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY pair_id, c ORDER BY turn NULLS LAST, role, text) AS pos FROM t),
d AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.pos, b.pos) AS pos,
             a.pos IS NOT NULL AND b.pos IS NOT NULL AND a.role = b.role AND a.text = b.text AS same
      FROM (SELECT * FROM n WHERE c) a FULL JOIN (SELECT * FROM n WHERE NOT c) b ON a.pair_id = b.pair_id AND a.pos = b.pos),
p AS (SELECT pair_id, coalesce(min(pos) FILTER (WHERE NOT same), max(pos) + 1) - 1 AS prompt_turns FROM d GROUP BY pair_id),
r AS (SELECT n.*, p.prompt_turns, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown
      FROM n JOIN p USING (pair_id)),
s AS (SELECT *, sum(CASE WHEN pos > prompt_turns THEN length(shown) ELSE 0 END)
                OVER (PARTITION BY pair_id, c ORDER BY pos) AS upto FROM r),
m AS (SELECT *, CASE WHEN role = 'assistant' THEN
             CAST(CAST(upto - length(shown) + 13 + length(role) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(upto - 1 AS BIGINT) AS VARCHAR) END AS span
      FROM s)
SELECT pair_id, min(id) FILTER (WHERE c) AS chosen_id, min(id) FILTER (WHERE NOT c) AS rejected_id,
       CAST(min(prompt_turns) AS INTEGER) AS prompt_turns,
       coalesce(string_agg(shown, '' ORDER BY pos) FILTER (WHERE c AND pos <= prompt_turns), '') AS prompt,
       coalesce(string_agg(shown, '' ORDER BY pos) FILTER (WHERE c AND pos > prompt_turns), '') AS chosen,
       coalesce(string_agg(shown, '' ORDER BY pos) FILTER (WHERE NOT c AND pos > prompt_turns), '') AS rejected,
       coalesce(string_agg(span, ',' ORDER BY pos) FILTER (WHERE c AND pos > prompt_turns), '') AS chosen_mask,
       coalesce(string_agg(span, ',' ORDER BY pos) FILTER (WHERE NOT c AND pos > prompt_turns), '') AS rejected_mask
FROM m GROUP BY pair_id
"""
