"""Benchmark decontamination: BM25 index of test items, block-max WAND, overlap check.

Spark counts the postings of the test items; tasks build the index in shards of
bounded size, items of like length together, and write them to the shared folder.
Search tasks open one shard at a time.  Every training document is cut into
overlapping passages, long enough that any item of the shard lies whole in one of
them, and each passage is a query: block-max WAND finds all items whose BM25 score, as a
share of the item's score against itself, reaches the threshold.  What it finds
is verified by the word n-grams of the item's question and answer.  A bound per
passage and item (its rare terms there plus all its frequent ones) spares WAND the
passages that can't hold any.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import cut, read_whole, shared_folder, small_batches, with_columns, write_whole

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach, and of its question's and answer's n-grams.
THRESHOLD, OVERLAP, NGRAM = 0.7, 0.5, 3
BLOCK = 16
#: Postings of one index shard, of which a worker holds one; with no more than KEPT_SHARDS in all it keeps them.
SHARD_POSTINGS = 1_000_000
KEPT_SHARDS = 1
#: Characters of the texts that a shard is opened for, where there are more.
GROUP_CHARS = 1 << 23
MIN_STRIDE = 64
#: Items of up to so many words share shards, and those of up to four times as many, and so on.
SHORT_WORDS = 256
#: An answer holds this share of its item's words at least.
ANSWER_SHARE = 0.25
#: ASCII other than letters and digits parts words.
_PARTS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
MATCH = "array<struct<item:long,score:double,question:double,answer:double,first_word:long>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_PARTS).split()


def question_and_answer(text: str | None) -> tuple[list[bytes], list[bytes]]:
    """The last sentence is the answer, with as many words before it as make up ``ANSWER_SHARE`` of the item."""
    parts = [w for w in map(words_of, _SENTENCE.split(text or "")) if w]
    words = [w for p in parts for w in p]
    last = len(parts[-1]) if len(parts) > 1 else 0
    n = len(words) - max(last, int(len(words) * ANSWER_SHARE))
    return words[:n], words[n:]


def overlap(part: list[bytes], passage: list[bytes], n: int = NGRAM) -> float:
    """Share of the part's distinct word n-grams that stand in the passage; 1 for an empty part."""
    n = min(n, len(part))
    if not n:
        return 1.0
    grams = {tuple(part[i:i + n]) for i in range(len(part) - n + 1)}
    return len(grams & {tuple(passage[i:i + n]) for i in range(len(passage) - n + 1)}) / len(grams)


@dataclass
class Shard:
    """Items of one shard and their posting lists, impacts as shares of the item's own score."""

    items: list[int | None]
    question: list[list[bytes]]
    answer: list[list[bytes]]
    postings: dict[bytes, tuple[list[int], list[float]]]
    stride: int

    def __post_init__(self):
        self.peak, self.block_last, self.block_max = {}, {}, {}
        for t, (docs, impacts) in self.postings.items():
            starts = range(0, len(docs), BLOCK)
            self.block_last[t] = [docs[min(s + BLOCK, len(docs)) - 1] for s in starts]
            self.block_max[t] = [max(impacts[s:s + BLOCK]) for s in starts]
            self.peak[t] = max(self.block_max[t])
        # frequent terms are bounded per item: what all of them together give it
        n = len(self.items)
        often = max(4, n // 20)
        self.rest, self.rare = np.zeros(n), {}
        docs_of, impacts_of = [], []
        for t, (docs, impacts) in self.postings.items():
            if len(docs) > often:
                self.rest[docs] += impacts
            else:
                self.rare[t] = len(self.rare)
                docs_of.append(docs)
                impacts_of.append(impacts)
        self.start = np.cumsum([0, *map(len, docs_of)])
        self.rare_item = np.array([d for x in docs_of for d in x], np.int64)
        self.rare_impact = np.array([x for y in impacts_of for x in y])

    def hopeful(self, words: list[bytes], passages: int, threshold: float) -> np.ndarray:
        """Passages in which some item may reach the threshold: its rare terms there, plus
        all that its frequent terms could add."""
        term = np.fromiter(map(self.rare.get, words, repeat(-1)), np.int64, len(words))
        at = np.nonzero(term >= 0)[0]
        if not len(at):
            return np.arange(passages if self.rest.max(initial=0.0) >= threshold else 0)
        # a word lies in the passage that starts in its stride and in the one before
        term, stride = term[at], at // self.stride
        key = np.unique(np.concatenate([stride, stride - 1]) * len(self.rare) + np.concatenate([term, term]))
        passage, term = key // len(self.rare), key % len(self.rare)
        inside = (passage >= 0) & (passage < passages)
        passage, term = passage[inside], term[inside]
        count = self.start[term + 1] - self.start[term]
        entry = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.start[term], count)
        pair, which = np.unique(np.repeat(passage, count) * len(self.items) + self.rare_item[entry], return_inverse=True)
        score = np.bincount(which, self.rare_impact[entry]) + self.rest[pair % len(self.items)]
        found = np.unique(pair[score >= threshold] // len(self.items))
        return np.arange(passages) if self.rest.max(initial=0.0) >= threshold else found

    def wand(self, terms: list[bytes], threshold: float) -> list[tuple[int, float]]:
        """(item, score) of every item that reaches the threshold: block-max WAND."""
        lists = [[self.postings[t][0], 0, t] for t in terms]
        found = []
        while lists:
            lists.sort(key=lambda x: x[0][x[1]])
            bound, pivot = 0.0, None
            for k, (docs, at, t) in enumerate(lists):
                bound += self.peak[t]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot is None:
                return found
            doc = lists[pivot][0][lists[pivot][1]]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][1]] == doc:
                pivot += 1
            block, until = 0.0, math.inf
            for docs, at, t in lists[:pivot + 1]:
                k = bisect_left(self.block_last[t], doc)
                if k < len(self.block_last[t]):
                    block += self.block_max[t][k]
                    until = min(until, self.block_last[t][k] + 1)
            if pivot + 1 < len(lists):
                until = min(until, lists[pivot + 1][0][lists[pivot + 1][1]])
            if block >= threshold:
                score = 0.0
                for x in lists[:pivot + 1]:
                    docs, impacts = self.postings[x[2]]
                    x[1] = bisect_left(docs, doc, x[1])
                    if x[1] < len(docs) and docs[x[1]] == doc:
                        score += impacts[x[1]]
                        x[1] += 1
                if score >= threshold:
                    found.append((doc, score))
            else:
                target = max(until, doc + 1)
                for x in lists[:pivot + 1]:
                    x[1] = bisect_left(x[0], target, x[1])
            lists = [x for x in lists if x[1] < len(x[0])]
        return found

    def search(self, text: str | None, threshold: float = THRESHOLD, share: float = OVERLAP,
               ngram: int = NGRAM) -> list[dict]:
        """Verified items in a text; the passage with the best score of each item."""
        words = words_of(text)
        if not words or not self.postings:
            return []
        starts = np.arange(0, max(1, len(words) - self.stride), self.stride)
        ends = np.minimum(starts + 2 * self.stride, len(words))
        eps = 1e-9
        hopeful = self.hopeful(words, len(starts), threshold - eps)
        best: dict[int, dict] = {}
        for k in hopeful:
            passage = words[starts[k]:ends[k]]
            terms = list({w for w in passage if w in self.postings})
            for i, score in self.wand(terms, threshold - eps):
                if i in best and best[i]["score"] >= score:
                    continue
                q, a = overlap(self.question[i], passage, ngram), overlap(self.answer[i], passage, ngram)
                if q >= share and a >= share:
                    best[i] = {"item": self.items[i], "score": min(1.0, score), "question": q, "answer": a,
                               "first_word": int(starts[k])}
        return [best[i] for i in sorted(best)]


@dataclass(frozen=True)
class Index:
    """Where the shards are."""

    folder: str
    shards: tuple[str, ...]


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    @F.pandas_udf("array<binary>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(words_of)

    return (benchmark.select(F.col(f"`{id_col}`").cast("long").alias("item"), F.col(f"`{text_col}`").alias("text"))
            .dropDuplicates(["item", "text"]).withColumn("words", split("text")).filter("size(words) > 0"))


def _write_shard(folder: str, n: int, mean: float):
    """Build the posting lists of a shard's items and write them down."""
    def run(key: tuple, t: pa.Table) -> pa.Table:
        part = sorted(t.to_pylist(), key=lambda r: (r["item"] is None, r["item"] or 0, r["text"]))
        lists: dict[bytes, tuple[list[int], list[float]]] = {}
        for i, r in enumerate(part):
            gain = {x["term"]: math.log1p((n - x["df"] + 0.5) / (x["df"] + 0.5)) * x["tf"] * (K1 + 1)
                    / (x["tf"] + K1 * (1 - B + B * r["len"] / mean)) for x in r["terms"]}
            own = sum(gain[x] for x in sorted(gain))
            for x, g in gain.items():
                docs, impacts = lists.setdefault(x, ([], []))
                docs.append(i)
                impacts.append(g / own)
        halves = [question_and_answer(r["text"]) for r in part]
        stride = max(MIN_STRIDE, *(r["len"] for r in part))
        name = f"shard-{key[0].as_py()}-{key[1].as_py()}"
        data = ([r["item"] for r in part], [h[0] for h in halves], [h[1] for h in halves], lists, stride)
        write_whole(folder, name, pickle.dumps(data, protocol=pickle.HIGHEST_PROTOCOL))
        return pa.table({"name": [name]})
    return run


def build_index(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                shard_postings: int = SHARD_POSTINGS) -> Index:
    """Index shards of the benchmark, each of about `shard_postings` postings at most, in the shared folder.

    Document frequencies and lengths are counted in Spark over all items.  Items
    without words are left out; repeated items count once; an item without id is an
    item like any other.  The driver gets the names of the shards.
    """
    spark = benchmark.sparkSession
    items = cut(_items(benchmark, id_col, text_col).withColumn("len", F.size("words")).withColumn(
        "wide", F.greatest(F.ceil(F.log(F.col("len") / SHORT_WORDS) / math.log(4)), F.lit(0)).cast("int")))
    n, total = items.agg(F.count(F.lit(1)), F.sum("len")).first()
    if not n:
        return Index("", ())
    folder = shared_folder(spark, "bm25")
    df = (items.select(F.explode(F.array_distinct("words")).alias("term"))
          .groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    pieces = items.groupBy("wide").agg(F.ceil(F.sum("len") / shard_postings).alias("pieces"))
    rows = items.join(pieces, "wide").withColumn("shard", F.pmod(F.xxhash64("item", "text"), F.col("pieces")).cast("int"))
    key = ["wide", "shard", "item", "text", "len"]
    counted = (rows.select(*key, F.explode("words").alias("term"))
               .groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))
               .join(df, "term").groupBy(*key).agg(F.collect_list(F.struct("term", "tf", "df")).alias("terms")))
    names = cut(counted.groupBy("wide", "shard").applyInArrow(_write_shard(folder, n, total / n), "name string"))
    return Index(folder, tuple(sorted(r["name"] for r in names.collect())))


def _open(index: Index, name: str) -> Shard:
    return Shard(*pickle.loads(read_whole(index.folder, name)))  # our own file


def contamination(text: Column, docs: DataFrame, index: Index, threshold: float = THRESHOLD,
                  share: float = OVERLAP, ngram: int = NGRAM) -> Column:
    """Array of the verified matches of a text in all shards; whole texts are searched, however long."""
    small_batches(docs.sparkSession)
    if not index.shards:
        return F.array().cast(MATCH)

    @F.pandas_udf(MATCH)
    def search(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept = [_open(index, name) for name in index.shards] if len(index.shards) <= KEPT_SHARDS else None

        def searched(group: list[pd.Series]) -> Iterator[pd.Series]:
            texts = [t if isinstance(t, str) else None for part in group for t in part]
            found: list[list[dict]] = [[] for _ in texts]
            for shard in kept or map(_open, repeat(index), index.shards):
                for i, t in enumerate(texts):
                    found[i] += shard.search(t, threshold, share, ngram)
            at = 0
            for part in group:
                yield pd.Series(found[at:at + len(part)], dtype=object)
                at += len(part)

        group, held = [], 0
        for part in parts:
            group.append(part)
            held += sum(len(t) for t in part if isinstance(t, str))
            if kept or held >= GROUP_CHARS:
                yield from searched(group)
                group, held = [], 0
        yield from searched(group)

    return search(text)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               **params) -> DataFrame:
    """doc_id, item_id, bm25, question_overlap, answer_overlap, first_word of each leak.

    A row per document row and item; bm25 is the share of the item's own score.
    Null and empty texts match nothing; whole texts are searched, however long; an
    empty benchmark gives no rows; repeated documents each get their rows; an item
    without id is found under a null item_id.
    """
    index = build_index(benchmark)
    hit = docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                      F.explode(contamination(F.col(f"`{text_col}`"), docs, index, **params)).alias("m"))
    return hit.select("doc_id", F.col("m.item").alias("item_id"), F.col("m.score").alias("bm25"),
                      F.col("m.question").alias("question_overlap"), F.col("m.answer").alias("answer_overlap"),
                      F.col("m.first_word").alias("first_word"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **params) -> DataFrame:
    """The rows of `docs` that hold no benchmark item, of those without id either."""
    index = build_index(benchmark)
    out = with_columns(docs, __dc=contamination(F.col(f"`{text_col}`"), docs, index, **params))
    return out.filter(F.size("__dc") == 0).drop("__dc")
