"""Ranked search against scoring every document, the threshold's stopping rule, edge rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from flowlens.llm import lexical as X

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def plain_terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=20):
    held = [(i, plain_terms(t)) for i, t in docs]
    n, total = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    df = Counter(x for _, t in held for x in set(t))
    out = []
    for item, text in set(items):
        q = Counter(plain_terms(text))
        rows = []
        for i, t in held:
            tf = Counter(t)
            m = 100 - 25 + (25 * len(t) * n) // max(total, 1)
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 12 * m))
                        for x, r in q.items() if tf[x])
            if score > 0:
                rows.append((-score, i is None, i or 0))
        for rank, (s, none, i) in enumerate(sorted(rows)[:k], 1):
            out.append((item, rank, None if none else i, -s))
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=repr)


def random_docs(n, seed, words=60):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    share = 1 / np.arange(1, words + 1)
    return [(int(i), " ".join(rng.choice(vocabulary, rng.integers(1, 40), p=share / share.sum()))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_search_equals_scoring_all(spark, seed):
    docs, items = random_docs(400, seed), [(i, t) for i, t in random_docs(12, seed + 10)]
    ours = X.search(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS), k=7)
    assert got(ours) == brute(docs, items, 7)


def test_edge_rows(spark):
    docs = [(1, "Alpha beta"), (2, "alpha BETA"), (2, "alpha BETA"), (None, "alpha beta"), (3, None), (4, ""), (5, "...!"),
            (6, "straße ÄRGER1"), (7, "gamma " * 30_000 + "alpha")]
    items = [(1, "alpha"), (1, "alpha"), (1, "ärger1 Straße"), (None, "beta beta"), (2, None), (3, ""), (4, "nowhere"), (5, "ÄRGER1 gamma")]
    rows = [(*r, 0, "x", "y") for r in docs]
    frame = spark.createDataFrame(rows, DOCS + ", score long, `rank` string, `query` string")
    asked = spark.createDataFrame([(*r, 9) for r in items], ITEMS + ", doc_id long")
    assert got(X.search(frame, asked)) == brute(docs, [i for i in items if i[1]])


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b")], DOCS)
    assert got(X.search(docs, items)) == got(X.search(some, items)) == []
    assert got(X.search(docs, spark.createDataFrame([(1, "a b")], ITEMS))) == []
    assert got(X.search(spark.createDataFrame([(1, None)], DOCS), spark.createDataFrame([(1, "a b")], ITEMS))) == []


def test_queries_in_several_passes(spark):
    docs, items = random_docs(60, 5), random_docs(9, 6)
    ours = X.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), query_chars=50)
    assert got(ours) == brute(docs, items)


def _block(lists, n_docs):
    """A block of given lists: for each term {document: impact}."""
    rows = sorted((d, t, s) for t, held in enumerate(lists) for d, s in held.items())
    doc, term, impact = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    return X.Block(doc, term, impact, n_docs, len(lists))


def test_best_positions_stop_before_the_last_read(spark):
    """Direct accesses to document 0 to 3 mark the head of both lists, so what lies deeper is never scored."""
    n = 4000
    first = {d: 10_000 - d for d in range(n)}
    second = {d: 10_000 - d for d in range(n)}
    docs, scores, seen = X.best_positions(_block([first, second], n), np.array([0, 1]), np.array([1, 1]), 3, 1, depth=2)
    top = sorted(zip(-scores, docs))[:3]
    assert [(-s, d) for s, d in top] == [(20_000 - 2 * d, d) for d in range(3)]
    assert seen < 20


def test_best_positions_keep_ties(spark):
    """All documents score the same: none may be cut, since ids decide."""
    n = 300
    lists = [{d: 7 for d in range(n)}]
    docs, scores, seen = X.best_positions(_block(lists, n), np.array([0]), np.array([1]), 5, 1, depth=2)
    assert seen == n and set(scores) == {7}


@pytest.mark.parametrize("seed", range(6))
def test_best_positions_hold_the_best(seed):
    rng = np.random.default_rng(seed)
    n, lists = 500, []
    for _ in range(6):
        who = rng.choice(n, rng.integers(1, n), replace=False)
        lists.append(dict(zip(who.tolist(), rng.integers(1, 12, len(who)).tolist())))
    weight = rng.integers(1, 5, 6)
    total = Counter()
    for w, held in zip(weight.tolist(), lists):
        for d, s in held.items():
            total[d] += w * s
    docs, scores, _ = X.best_positions(_block(lists, n), np.arange(6), weight, 10, 1)
    ours = sorted((-s, d) for d, s in zip(docs.tolist(), scores.tolist()))[:10]
    assert ours == sorted((-s, d) for d, s in total.items())[:10]
