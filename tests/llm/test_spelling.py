"""Spelling variants against edit distance over all pairs."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from flowlens.llm import spelling as S

DOCS = "doc_id long, text string"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words, ratio=5):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-words[x], x))
            if words[best] >= ratio * words[w]:
                form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, n, len(near[w]), form.get(w), words[form[w]] if w in form else None, root))
    return out


def counted(docs):
    out = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            out[w] += 1
    return out


def rows(df):
    return {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def random_words(n, seed, letters="abcdeé", lengths=(1, 9)):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(*lengths))): rng.choice([1, 2, 5, 30, 200, 1200]) for _ in range(n)}
    return words


def test_variants_equal_all_pairs(spark):
    words = random_words(600, 3)
    assert rows(S.variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == brute(words)


def test_small_blocks_give_the_same(spark, monkeypatch):
    words = random_words(300, 4, letters="ab", lengths=(3, 9))
    monkeypatch.setattr(S, "BLOCK_WORDS", 7)
    assert rows(S.variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == brute(words)


def test_chain_of_forms_ends_at_its_root(spark):
    words = {"abcdef" + "x" * k: 6**k for k in range(9)}
    out = {r["word"]: r["root"] for r in S.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert set(out.values()) == {"abcdef" + "x" * 8}


def test_gram_products_verify_edits():
    words = random_words(400, 9, letters="abc")
    by = defaultdict(list)
    for w in words:
        by[len(w)].append(w)
    for n, a in by.items():
        for b in (a, by.get(n + 1, [])):
            if not b:
                continue
            i, j = S.near_pairs(a, b, a is b)
            got = {frozenset((a[x], b[y])) for x, y in zip(i, j)}
            assert len(got) == len(i)
            assert got == {frozenset((x, y)) for x in a for y in b if one_edit(x, y)}


def test_each_pair_of_cells_meets_once():
    a, b = S.cell_of("abcdef", 3), S.cell_of("abcdeg", 3)
    assert (b in S.neighbours(a)) + (a in S.neighbours(b)) == 1
    longer = S.cell_of("abcdefg", 3)
    assert longer in S.neighbours(a) and a not in S.neighbours(longer)


def test_document_words(spark):
    rng = np.random.default_rng(7)
    base = ["Language", "languag", "langüage", "éclair", "ÉCLAIR", "modèles", "processing", "procesing", "short", "x" * 40]
    docs = [(int(i), " ".join(rng.choice(base, 60)) + ", it's 12end. " + rng.choice(base)) for i in range(200)]
    docs += [(None, "language " * 3), (7, None), (8, ""), (9, "1234 -- "), (10, "Processing " * 40_000), (11, "ab cd"), (11, "ab cd"),
             (12, "y" * 100_000)]
    frame = spark.createDataFrame([(*d, "a", 1) for d in docs], DOCS + ", word string, n long")
    words = {w: n for w, n in counted(docs).items() if len(w) >= 6}
    assert {(r["word"], r["n"]) for r in S.document_words(frame).collect()} == set(words.items())
    out = S.group_document_words(frame)
    assert out.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    assert rows(out) == brute({w: n for w, n in words.items() if n >= 5})


def test_empty_tables(spark):
    assert rows(S.group_document_words(spark.createDataFrame([], DOCS))) == set()
    assert rows(S.group_document_words(spark.createDataFrame([(1, "once")], DOCS))) == set()
    assert rows(S.variants(spark.createDataFrame([], "word string, n long"))) == set()
