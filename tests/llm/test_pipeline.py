"""The pipeline, stage by stage, against plain Python over all rows and pairs."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_graph_operators import DOCS, slow_components, slow_fingerprint
from test_text_operators import slow_spans

import corpus_pipeline
from flowlens.llm import langid

SMALL = "/root/testdata/sf0.001"
MARKS = ("EMAIL", "IP", "CARD", "PHONE")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The small tables with copies, near copies, leaks, personal data and odd rows."""
    rng = random.Random(8)
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    long = [r for r in rows if r[1] and len(r[1].split()) > 120]
    for i, r in enumerate(rng.sample(long, 12)):
        rows.append((10_000 + i, re.sub("[a-z]", lambda m: m.group().upper(), r[1]), *r[2:]))
        words = r[1].split()
        rows.append((10_100 + i, " ".join([*words[:-1], "changed"]), *r[2:]))
    for i, (r, item) in enumerate(zip(rng.sample(long, 10), items, strict=False)):
        rows.append((10_200 + i, f"own words {i} {r[1][::-1]} {item[1]} and {i} more", "en", "web", None))
    for i, r in enumerate(rng.sample(long, 10)):
        rows.append((10_300 + i, f"{r[1]} write to u{i}.x@mail-{i}.example.org or call +1 (864) 555-01{30 + i} from 10.0.0.{i} "
                                 f"with 4111 1111 1111 1111 on day {i} of {r[1][:200][::-1]}", r[2], "forum", 7))
    rows += [(20_000, None, None, "web", None), (20_001, "", "en", "web", 0), (20_002, "12 34", "en", None, 5), (None, "the and of that", None, "web", 1),
             (20_003, long[0][1], "en", "copy", 1), (20_003, long[0][1], "en", "copy", 1), (20_004, "x" * 50_000, "fr", "web", 1)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def plain_language(spark, folder, rows):
    """Rows kept by sums over all segmentations, one word and one piece at a time."""
    model = langid.train(langid.training_part(spark.read.parquet(f"{folder}/documents.parquet")))
    probs = model.dense(0, len(model.langs))
    sums: dict[str, np.ndarray] = {}

    def word(w):
        if w not in sums:
            w_, alpha = "▁" + w, [np.ones(len(model.langs))]
            for end in range(1, len(w) + 2):
                total = np.zeros(len(model.langs))
                for start in range(max(0, end - 8), end):
                    piece = w_[start:end]
                    if piece in model.vocab:
                        total = total + alpha[start] * probs[model.vocab[piece]]
                    elif len(piece) == 1:
                        total = total + alpha[start] * 1e-7
                alpha.append(total)
            sums[w] = np.log(alpha[-1])
        return sums[w]

    kept = []
    for r in rows:
        words = re.findall(r"[^\W\d_]{1,32}", (r[1] or "").lower())
        if words:
            score = model.prior + sum(word(w) for w in words)
            post = np.exp(score - score.max())
            if post.max() / post.sum() >= 0.5:
                kept.append(r)
    return kept


def plain_dedup(rows):
    by = defaultdict(list)
    for r in rows:
        by[slow_fingerprint(r[1])].append(r)
    least = slow_components({f: [r[0] for r in rs] for f, rs in by.items()})
    best = {}
    for f, rs in by.items():
        for r in rs:
            if r[0] == least[f] or (least[f] == math.inf and least[f] not in best):
                best.setdefault(least[f], r)
    return list(best.values())


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.lower())


def plain_decontaminate(rows, items):
    """Rows without an item, every passage scored against every item."""
    bags = [Counter(words_of(t)) for _, t in items]
    df = Counter(w for b in bags for w in b)
    mean = sum(sum(b.values()) for b in bags) / len(bags)
    stride = max(64, *(sum(b.values()) for b in bags))

    def gain(bag):
        n = sum(bag.values())
        return {w: math.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * n / mean))
                for w, c in bag.items()}

    gains = [gain(b) for b in bags]

    def halves(text):
        parts = [p for p in (words_of(s) for s in re.split(r"(?<=[.!?])\s+", text)) if p]
        words = [w for p in parts for w in p]
        n = max(len(parts[-1]) if len(parts) > 1 else 0, len(words) // 4)
        return words[:len(words) - n], words[len(words) - n:]

    def covered(part, passage):
        n = min(3, len(part))
        grams = {tuple(part[i:i + n]) for i in range(len(part) - n + 1)}
        here = {tuple(passage[i:i + n]) for i in range(len(passage) - n + 1)}
        return not n or len(grams & here) / len(grams) >= 0.5

    def leaks(text):
        words = words_of(text or "")
        for lo in range(0, max(1, len(words) - stride), stride):
            passage = words[lo:lo + 2 * stride]
            seen = set(passage)
            for (_, t), g in zip(items, gains, strict=True):
                if sum(x for w, x in g.items() if w in seen) >= 0.7 * sum(g.values()) - 1e-9:
                    q, a = halves(t)
                    if covered(q, passage) and covered(a, passage):
                        return True
        return False

    return [r for r in rows if not leaks(r[1])]


def plain_mask(rows):
    out = []
    for i, text, lang, source, n in rows:
        done, parts, spans = 0, [], sorted(slow_spans(text), key=lambda x: (x[1], -x[2]))
        while spans:
            kind, start, end = spans.pop(0)
            while spans and spans[0][1] < end:
                end = max(end, spans.pop(0)[2])
            parts += [text[done:start], f"[{MARKS[kind]}]"]
            done = end
        new = "".join(parts) + text[done:]
        out.append((i, new, lang, source, n if new == text else len(new)))
    return out


def plain_mix(rows):
    """Fair queueing, one copy at a time."""
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    queues = defaultdict(list)
    for r in rows:
        queues[r[3]].append((md5(f"mix|{'' if r[0] is None else r[0]}|{md5(r[1] or '')}"), size(r), r))
    names = sorted(queues, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(n for _, n, _ in q) for s, q in queues.items()}
    budget, full = 1.5 * sum(total.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        level = (budget - sum(2 * total[s] for s in full)) / sum(weight[s] for s in open_)
        more = {s for s in open_ if 2 * total[s] <= level * weight[s]}
        if not more:
            break
        full |= more
    target = {s: float(2 * total[s]) if s in full else level * weight[s] for s in names}
    copies = []
    for s in names:
        done = 0
        for epoch in (0, 1):
            for key, n, r in sorted(queues[s], key=lambda x: x[0]):
                done += n
                if n:
                    copies.append((done / target[s], s is None, s or "", epoch, key, n, r))
    taken, mixed = Counter(), 0
    for *_, n, r in sorted(copies, key=lambda c: c[:5]):
        mixed += n
        if mixed > budget:
            break
        taken[r] += n
    return [(*r, size(r), total[r[3]], target[r[3]], taken[r]) for r in rows if taken[r]]


def tuples(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_each_stage_and_the_whole_match_plain_python(spark, tables, tmp_path):
    folder, rows, items = tables
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    plain = {"language_id": lambda rs: plain_language(spark, folder, rs), "simhash_dedup": plain_dedup,
             "decontaminate": lambda rs: plain_decontaminate(rs, items), "pii": plain_mask, "mix": plain_mix}
    docs, counts = spark.read.parquet(f"{folder}/documents.parquet"), [len(rows)]
    for name, stage in corpus_pipeline.STAGES:
        want = plain[name](rows)
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "mix":
            columns += ["size", "source_size", "target", "taken"]
        assert docs.columns == columns
        got = tuples(docs, *columns)
        if name == "mix":
            close = {r[0]: r[7] for r in want}
            assert all(math.isclose(r[7], close[r[0]]) for r in got)
            got, want = [r[:7] + r[8:] for r in got], [r[:7] + r[8:] for r in want]
        assert Counter(got) == Counter(want), name
        rows = want
        counts.append(len(rows))
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4] >= counts[5] > 100
    ids = {r[0] for r in rows}
    assert not ids & {20_000, 20_001, 20_002, *range(10_000, 10_012), *range(10_200, 10_210)}
    assert sum("[EMAIL]" in r[1] and "[PHONE]" in r[1] and "[IP]" in r[1] and "[CARD]" in r[1] for r in rows) >= 5
    assert Counter(r[:7] + r[8:] for r in tuples(corpus_pipeline.run(spark, folder), *columns)) == Counter(rows)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "text", "taken", "target"} <= set(out.columns)


def test_columns_of_any_name_go_through(spark, tables, tmp_path):
    folder, *_ = tables
    names = ["pii", "fp", "root", "th", "found", "row", "lm", "ord", "m"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60)
    for n in names:
        docs = docs.withColumn(n, F.lit(f"own {n}"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns[:14] == [*DOCS.replace(" long", "").replace(" string", "").split(", "), *names]
    assert out.count() and out.filter(" or ".join(f"{n} <> 'own {n}'" for n in names)).count() == 0
