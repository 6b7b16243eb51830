"""Ranked lexical search by the Best Position Algorithm over impact lists.

Tasks turn their documents into blocks of postings, written down once.  In a block
every query term has an impact list, its documents by falling impact.  A query reads
its lists from the top in rounds that double in depth.  Whatever document turns up is
scored at once by direct access to its own postings, which also marks where it stands
in all other lists of the query.  The best position of a list is the end of its
unbroken run of marked places, mostly past what was read; the impacts there add up to
the most that an unseen document can score.  A query is done with a block when that is
strictly below its k-th score, so ties are never cut.  The k-th score is carried from
block to block of a task, and the best of all tasks are ranked in two steps.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import cut, running_total, small_batches

#: Fixed values of the contract: no letter or digit (ASCII bytes; all others are), results, scales.
_NO_TERM = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
TOP = 20
WEIGHT, IMPACT, SATURATION = 1000, 1_000_000_000, 12
#: Characters of the queries searched in one pass over the documents; what is broadcast is bounded by it.
QUERY_CHARS = 1 << 23
#: Documents and postings of a block.
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 1_500_000
#: Places read from each list in a query's first round.
FIRST_DEPTH = 16
#: Groups that a query's candidates are ranked in before they meet.
SALT = 64

_TABLE = bytes.maketrans(bytes(_NO_TERM) + bytes(range(0x41, 0x5B)), b" " * len(_NO_TERM) + bytes(range(0x61, 0x7B)))


def terms(text: str | None) -> list[bytes]:
    """Terms of a whole text: runs of letters and digits, everything past ASCII included; only A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass
class Queries:
    """Queries of one pass: their ids, and their terms as numbers with how often each occurs."""

    ids: list[int | None]
    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]
    repeats: list[np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]]) -> Queries:
        vocabulary: dict[bytes, int] = {}
        numbers, repeats = [], []
        for _, text in rows:
            c = Counter(terms(text))
            numbers.append(np.array([vocabulary.setdefault(t, len(vocabulary)) for t in c], np.int64))
            repeats.append(np.array(list(c.values()), np.int64))
        return cls([i for i, _ in rows], vocabulary, numbers, repeats)


_BLOCK = "ids array<long>, lengths binary, doc binary, term binary, tf binary, n_docs long, n_terms long"


def _index(shared):
    """Blocks of postings of the query terms; all terms count in lengths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value.vocabulary
        size = len(vocabulary)
        ids: list[int | None] = []
        lengths: list[int] = []
        found: list[np.ndarray] = []
        times: list[np.ndarray] = []
        held = 0

        def block() -> pa.RecordBatch:
            n = np.array(lengths, "<i8")
            doc = np.repeat(np.arange(len(found), dtype="<u4"), [len(f) for f in found])
            term = np.concatenate(found).astype("<u4")
            tf = np.concatenate(times).astype("<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in (n, doc, term, tf)),
                 pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64())],
                names=["ids", "lengths", "doc", "term", "tf", "n_docs", "n_terms"])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = terms(text)
                number = np.fromiter(map(vocabulary.get, words, repeat(size)), np.int64, len(words))
                number, tf = np.unique(number, return_counts=True)
                if len(number) and number[-1] == size:
                    number, tf = number[:-1], tf[:-1]
                ids.append(doc_id)
                lengths.append(len(words))
                found.append(number)
                times.append(tf)
                held += len(number)
                if len(ids) >= BLOCK_DOCS or held >= BLOCK_POSTINGS:
                    yield block()
                    ids, lengths, found, times, held = [], [], [], [], 0
        if ids:
            yield block()
    return run


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for b in batches:
        for raw in b.column("term"):
            n = np.bincount(np.frombuffer(raw.as_py(), "<u4"), minlength=len(total))
            n[:len(total)] += total
            total = n
    seen = np.nonzero(total)[0]
    if len(seen):
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["term", "df"])


class Block:
    """Impact lists of a block and, document by document, where each stands in them."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((doc, -impact, term))
        self.list_doc, self.list_impact = doc[order], impact[order]
        self.list_start = np.searchsorted(term[order], np.arange(n_terms + 1))
        # the postings come in document order; each knows its place in its term's list
        self.doc_start = np.searchsorted(doc, np.arange(n_docs + 1))
        self.term, self.impact, self.place = term, impact, np.empty(len(doc), np.int64)
        self.place[order] = np.arange(len(doc)) - self.list_start[term[order]]
        self.slot = np.full(n_terms, -1, np.int64)

    def postings(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Postings of the documents, and the number in `docs` that each belongs to."""
        lo, n = self.doc_start[docs], self.doc_start[docs + 1] - self.doc_start[docs]
        whose = np.repeat(np.arange(len(docs)), n)
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[whose], whose


def best_positions(block: Block, query: np.ndarray, weight: np.ndarray, k: int, least: int,
                   depth: int = FIRST_DEPTH) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents with their scores among which are the k best of the block that reach
    `least`, and the number of documents that were scored."""
    lo = block.list_start[query]
    size = block.list_start[query + 1] - lo
    held = size > 0
    query, weight, lo, size = query[held], weight[held], lo[held], size[held]
    if not len(query):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    block.slot[query] = np.arange(len(query))
    base = np.cumsum(size) - size
    seen = np.zeros(int(size.sum()), bool)
    best = np.zeros(len(query), np.int64)
    scored = np.zeros(len(block.doc_start) - 1, bool)
    docs, scores = [], []
    top: list[int] = []
    read = 0
    while True:
        # sorted access: the next places of every list
        rows = [block.list_doc[a + read:a + min(read + depth, s)] for a, s in zip(lo, size, strict=True) if s > read]
        new = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.int64)
        new = new[~scored[new]]
        read += depth
        depth *= 2
        if len(new):
            # direct access: all that the query holds of these documents
            scored[new] = True
            at, whose = block.postings(new)
            slot = block.slot[block.term[at]]
            ours = slot >= 0
            at, whose, slot = at[ours], whose[ours], slot[ours]
            seen[base[slot] + block.place[at]] = True
            score = np.zeros(len(new), np.int64)
            np.add.at(score, whose, weight[slot] * block.impact[at])
            docs.append(new)
            scores.append(score)
            top = heapq.nlargest(k, [*top, *score.tolist()])
        # best positions, and what may score there
        most = 0
        for t in range(len(query)):
            places = seen[base[t] + best[t]:base[t] + size[t]]
            gap = int(places.argmin()) if len(places) else 0
            best[t] += gap if len(places) and not places[gap] else len(places)
            if best[t] < size[t]:
                most += int(weight[t]) * int(block.list_impact[lo[t] + max(best[t] - 1, 0)])
        kth = max(least, top[-1]) if len(top) == k else least
        if most < kth or (best >= size).all():
            break
    block.slot[query] = -1
    docs, scores = (np.concatenate(docs), np.concatenate(scores)) if docs else (np.zeros(0, np.int64),) * 2
    return docs, scores, int(scored.sum())


def _after(doc_id: int | None) -> tuple[bool, int]:
    return doc_id is None, doc_id or 0


def _search(shared, numbers, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = shared.value
        n, total, df = numbers.value
        weight = np.array([math.floor(WEIGHT * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        weights = [weight[t] * r for t, r in zip(q.terms, q.repeats, strict=True)]
        best: list[list[tuple[int, tuple[bool, int]]]] = [[] for _ in q.ids]
        for b in batches:
            for row in b.to_pylist():
                ids = row["ids"]
                lengths, doc, term, tf = (np.frombuffer(row[c], t).astype(np.int64) for c, t in
                                          (("lengths", "<i8"), ("doc", "<u4"), ("term", "<u4"), ("tf", "<u4")))
                m = 100 - 25 + (25 * lengths * n) // max(total, 1)
                impact = (IMPACT * tf) // (1000 * tf + SATURATION * m[doc])
                block = Block(doc, term, impact, len(ids), len(df))
                for i, (t, w) in enumerate(zip(q.terms, weights, strict=True)):
                    # a term that nearly every document holds weighs nothing
                    some = w > 0
                    least = best[i][-1][0] if len(best[i]) == k else 1
                    found, score, _ = best_positions(block, t[some], w[some], k, least)
                    may = score >= max(least, 1)
                    if may.any():
                        found, score = found[may], score[may]
                        if len(found) > k:
                            # ties with the k-th stay; ids decide among them
                            kth = np.partition(score, -k)[-k]
                            found, score = found[score >= kth], score[score >= kth]
                        new = [(s, _after(ids[d])) for d, s in zip(found.tolist(), score.tolist(), strict=True)]
                        best[i] = heapq.nsmallest(k, [*best[i], *new], key=lambda x: (-x[0], x[1]))
        part = TaskContext.get().partitionId()
        out = [(i, q.ids[i], None if after[0] else after[1], s) for i, rows in enumerate(best) for s, after in rows]
        if out:
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:]), pa.array([part % SALT] * len(out), pa.int32())],
                names=["query", "item_id", "doc_id", "score", "salt"])
    return run


_RESULT = "item_id long, rank int, doc_id long, score long"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query: within groups of tasks, then among what these leave."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for by in (["query", "salt"], ["query"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
    return found.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, query_chars: int = QUERY_CHARS) -> DataFrame:
    """item_id, rank, doc_id, score: the `k` best documents (doc_id, text) for each query (item_id, text).

    Terms come from whole texts; a null or empty text has none, so as a query it
    finds nothing and as a document it is never found.  Equal rows of `queries` are
    one query; rows that share an id but not a text are queries of their own, each
    ranked from 1.  Repeated documents each take a rank; ties go by ascending id,
    null ids last.  Without documents, or queries, there are no rows.  Other
    columns are not read.

    Queries are taken in blocks of some `query_chars` characters, or one longer
    query; each block is a pass over the documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = queries.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.length("text") > 0).distinct()
    items = running_total(items, [F.xxhash64("item_id", "text"), F.col("item_id"), F.col("text")], F.length("text"), "upto")
    items = cut(items.withColumn("pass", F.floor((F.col("upto") - F.length("text")) / query_chars)).drop("upto"))
    passes = [r[0] for r in items.select("pass").distinct().orderBy("pass").collect()]
    out = spark.createDataFrame([], _RESULT)
    for p in passes:
        rows = items.filter(F.col("pass") == p).select("item_id", "text").collect()
        shared = spark.sparkContext.broadcast(Queries.of([(r[0], r[1]) for r in rows]))
        blocks = cut(docs.mapInArrow(_index(shared), _BLOCK))
        n, total = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        df = np.zeros(len(shared.value.vocabulary), np.int64)
        for term, d in (blocks.select("term").mapInArrow(_document_counts, "term long, df long")
                        .groupBy("term").agg(F.sum("df").alias("df")).collect()):
            df[term] = d
        numbers = spark.sparkContext.broadcast((n, total, df))
        found = _ranked(blocks.mapInArrow(_search(shared, numbers, k), "query int, item_id long, doc_id long, score long, salt int"), k)
        out = found if len(passes) == 1 else out.unionByName(cut(found))
    return out


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t, row_number() OVER () AS doc FROM documents),
s AS (SELECT CAST(count(*) FILTER (len(t) > 0) AS BIGINT) AS N, CAST(sum(len(t)) AS BIGINT) AS L FROM d),
p AS (SELECT doc, doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d),
tf AS (SELECT doc, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT q.item_id, q.term, q.times, CAST(floor(1000 * ln((2 * s.N + 2)::DOUBLE / (2 * df.df + 1))) AS BIGINT) AS w
      FROM q JOIN df USING (term) CROSS JOIN s),
r AS (SELECT w.item_id, tf.doc, tf.doc_id,
        CAST(sum(w.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (100 - 25 + ((25 * tf.n * s.N) // s.L))))) AS BIGINT) AS score
      FROM w JOIN tf USING (term) CROSS JOIN s GROUP BY ALL),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 20"""


def search_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score of the 20 best documents for each benchmark item."""
    return search(docs, benchmark)
