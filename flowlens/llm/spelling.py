"""Spelling variants: words one edit apart, found by Gram matrices over blocks of words.

A word becomes its vector of letter counts.  One edit moves that vector by a squared
distance of one (insertion, deletion) or two (replacement), so the products of two
blocks' vectors, |a|^2 + |b|^2 - 2ab, leave few pairs to verify letter by letter.
Blocks are cut by length and, within a length, by the letter counts summed over a few
classes of letters: an edit moves those sums by one, so a block meets itself, its
neighbours of the same length and those of the next length, and no others.  A crowded
cell is cut into blocks of bounded size by hash, and every pair of blocks is a row of
its own, spread over the tasks by its second block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import cut, lower_ascii, small_batches

#: Words of a block.
BLOCK_WORDS = 1024
#: Squared distance of letter counts that one edit leaves at most.
NEAR = 2
#: Letters compared at a time when pairs are verified.
VERIFY_LETTERS = 1 << 22
#: Fixed values of the contract: the letters of a run, and the damage to words.
RUN = r"[A-Za-zÀ-ÿ]"
DAMAGE = 199
MIN_LENGTH, MIN_COUNT = 6, 5
RATIO = 5


def document_words(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """word, n: the words of whole texts and how often they occur.

    Of a run whose crc32 with its document id is a multiple of ``DAMAGE``, one
    letter is missing.  A null text has no words; a null id counts as empty text.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(f"({RUN}{{{min_length},}})"), F.lit(1))).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    damaged = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % DAMAGE == 0, damaged).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.array(words, dtype=f"U{len(words[0])}").view(np.uint32).reshape(len(words), -1)


def cell_of(word: str, classes: int) -> str:
    """Letter counts by class of letter; they add up to the length."""
    sums = np.bincount(np.array([word]).view(np.uint32) % classes, minlength=classes)
    return ",".join(map(str, sums.tolist()))


def _cells(classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [cell_of(w, classes) for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.string())], names=[*b.schema.names, "cell"])
    return run


def neighbours(cell: str) -> list[str]:
    """Cells that a word of this one may reach by one edit; of two cells that reach each other only one lists it."""
    sums = list(map(int, cell.split(",")))

    def moved(*steps: tuple[int, int]) -> str:
        out = sums.copy()
        for i, d in steps:
            out[i] += d
        return ",".join(map(str, out))

    k = len(sums)
    longer = [moved((i, 1)) for i in range(k)]
    replaced = [moved((i, 1), (j, -1)) for i in range(k) for j in range(i + 1, k) if sums[j]]
    return [cell, *longer, *replaced]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pairs = [(c, t) for c in b.column("cell").to_pylist() for t in neighbours(c)]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], names=["cell", "target"])


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a and b, row by row, differ by one edit; b's are as long as a's or one letter longer."""
    n = a.shape[1]
    here = a != b[:, :n]
    if b.shape[1] == n:
        return here.sum(axis=1) == 1
    # all before the first difference stays, all from it on moves by one
    first = np.where(here.any(axis=1), here.argmax(axis=1), n)
    moved = a != b[:, 1:]
    last = np.where(moved.any(axis=1), n - 1 - moved[:, ::-1].argmax(axis=1), -1)
    return last < first


def near_pairs(a: list[str], b: list[str], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of block a and of block b that are one edit apart; each pair once if the blocks are the `same`."""
    x, y = _letters(a), _letters(b)
    letters, at = np.unique(np.concatenate([x.ravel(), y.ravel()]), return_inverse=True)
    m = len(letters)

    def counts(at: np.ndarray, n: int) -> np.ndarray:
        rows = np.repeat(np.arange(n), at.size // n)
        return np.bincount(rows * m + at, minlength=n * m).reshape(n, m).astype(np.float64 if at.size // n > 2000 else np.float32)

    ca, cb = counts(at[:x.size], len(a)), counts(at[x.size:], len(b))
    far = (ca * ca).sum(axis=1)[:, None] + (cb * cb).sum(axis=1)[None, :] - 2 * (ca @ cb.T)
    i, j = np.nonzero(far <= NEAR)
    if same:
        i, j = i[i < j], j[i < j]
    step = max(1, VERIFY_LETTERS // y.shape[1])
    keep = [_one_edit(x[i[lo:lo + step]], y[j[lo:lo + step]]) for lo in range(0, len(i), step)]
    ok = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[ok], j[ok]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, na, b, nb, same in zip(*(batch.column(c) for c in ("words", "ns", "other_words", "other_ns", "same")), strict=True):
            i, j = near_pairs(a.as_py(), b.as_py(), same.as_py())
            if not len(i):
                continue
            words, others = a.values.take(pa.array(i)), b.values.take(pa.array(j))
            n, m = na.values.take(pa.array(i)), nb.values.take(pa.array(j))
            both = lambda x, y: pa.concat_arrays([x, y])
            yield pa.RecordBatch.from_arrays([both(words, others), both(n, m), both(others, words), both(m, n)],
                                             names=["word", "n", "near", "near_n"])


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: all pairs of the distinct `words` (word, n) that are one edit apart, both ways round."""
    spark = words.sparkSession
    small_batches(spark)
    # so many classes that cells hold some hundreds of words
    classes = max(2, round(math.log2(max(words.count(), 2)) / 4))
    placed = words.filter(F.length("word") > 0).mapInArrow(_cells(classes), "word string, n long, cell string")
    placed = cut(placed)
    cells = cut(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_WORDS).cast("int").alias("blocks")))
    blocks = (placed.join(cells, "cell").withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
              .groupBy("cell", "block").agg(F.collect_list(F.struct("word", "n")).alias("w")))
    blocks = cut(blocks.select("cell", "block", F.col("w.word").alias("words"), F.col("w.n").alias("ns")))
    other = cells.select(F.col("cell").alias("target"), F.col("blocks").alias("target_blocks"))
    meets = cells.mapInArrow(_neighbours, "cell string, target string").join(other, "target")
    left = blocks.join(meets, "cell").select(
        "cell", "block", "words", "ns", "target", F.explode(F.sequence(F.lit(0), F.col("target_blocks") - 1)).alias("target_block"))
    left = left.filter((F.col("cell") != F.col("target")) | (F.col("block") <= F.col("target_block")))
    right = blocks.select(F.col("cell").alias("target"), F.col("block").alias("target_block"),
                          F.col("words").alias("other_words"), F.col("ns").alias("other_ns"))
    same = (F.col("cell") == F.col("target")) & (F.col("block") == F.col("target_block"))
    pairs = left.join(right, ["target", "target_block"]).select("words", "ns", "other_words", "other_ns", same.alias("same"))
    return pairs.mapInArrow(_compare, "word string, n long, near string, near_n long")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root for each of the distinct `words` (word, n).

    form is the most frequent near word (ties: the smallest in code-point order), if
    it occurs `ratio` times as often; root is where the forms lead.  A form has
    `ratio` times its word's count, so a long's range bounds the steps to a root.
    Words without near words, and an empty table, give rows without form, or none.
    """
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent as its word")
    words = cut(words)
    found = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    all_words = words.join(found, "word", "left")
    leads = -F.col("best.less") >= F.col("n") * ratio
    out = cut(all_words.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                               F.when(leads, F.col("best.near")).alias("form"), F.when(leads, -F.col("best.less")).alias("form_n")))
    # each round doubles the steps taken; those that have arrived no longer join
    steps = out.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(64 / math.log2(ratio)))):
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if not steps.join(onward, "root", "left_semi").head(1):
            break
        steps = cut(steps.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return out.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_document_words(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of the words of whole texts that occur at least ``MIN_COUNT`` times."""
    words = document_words(docs).filter(F.col("n") >= MIN_COUNT)
    return variants(words).select("word", "n", "n_near", "form", "form_n", "root")
