"""Personal data: patterns, and a skip-chain conditional random field around them.

Patterns find the base spans.  The field labels the tokens of a document that
may belong to personal data: neighbours share chain potentials, distant repeated
or similar tokens share skip potentials, tokens of base spans are observed, and
loopy message passing carries their labels over.  A token outside the base spans
becomes a span if a skip path joins it to an observed token of the kind and its
marginal is high enough.  How a partial mention looks is learnt from base spans
with the part hidden that the pattern needs; tokens that skip edges join to a
base span aren't taken as counter-examples.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import sampled, small_batches, with_columns

KINDS = ("email", "ip", "card", "phone")
#: Label 0 is none of these; the others are the kinds in order.
N_LABELS = len(KINDS) + 1
MARGINAL, ROUNDS, DAMPING = 0.9, 12, 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
#: Runs are possessive and start where digits start: the same matches, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NON_DIGIT = re.compile(r"[^0-9]+")
_TOKEN = re.compile(r"\S+")
#: Mailbox names of a role (RFC 2142 and the like): as bare words they are no one's address.
_ROLES = frozenset("abuse accounts admin administrator billing careers contact customer customerservice editor editorial "
                   "enquiries everyone feedback hello helpdesk hostmaster inquiries investors legal mailer marketing "
                   "newsletter noreply no-reply notifications office orders postmaster press privacy registration "
                   "reservations sales security service services support webmaster welcome".split())
_EDGE = ".,;:!?()[]{}<>\"'|*#$%&"

Span = tuple[int, int, int]  # kind, start, end


def _emails(text: str) -> list[Span]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        lo = max(done, at - 64)
        local = _LOCAL_END.search(text, lo, at)
        while local and local.start() == lo > done:  # a longer local part: look further back
            lo = max(done, lo - 4 * (at - lo))
            local = _LOCAL_END.search(text, lo, at)
        domain = local and _DOMAIN.match(text, at + 1)
        if domain:
            out.append((0, local.start(), domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    odd = [int(d) for d in digits[-1::-2]]
    even = [2 * int(d) for d in digits[-2::-2]]
    return (sum(odd) + sum(d - 9 if d > 9 else d for d in even)) % 10 == 0


def base_spans(text: str | None) -> list[Span]:
    """Pattern matches, by kind, then start (code points, end exclusive)."""
    if not text:
        return []
    out = _emails(text) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NON_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NON_DIGIT.sub("", m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


@dataclass
class Token:
    start: int
    end: int
    label: int  #: of the base span it touches, else 0
    place: int  #: among all tokens of the text
    features: tuple[int, ...]
    keys: tuple[str, ...]  #: tokens that share one are repeated or similar
    digits: str = ""  #: of a word without letters


def _features(word: str) -> tuple[int, ...]:
    n = sum(c.isdigit() for c in word)
    return (1, "@" in word, n > 0, 0 < n <= 2, n == 3, n == 4, 5 <= n <= 7, 8 <= n <= 15, 16 <= n <= 19, n >= 20,
            word.count(".") == 3, word.count(".") in (1, 2), word.startswith("+"), word.startswith("("),
            "-" in word, any(c.isalpha() for c in word), word.strip(_EDGE).isdigit(), len(word) > 12)


N_FEATURES = len(_features(""))


def _local(address: str) -> str:
    """Local part that stands for the address as a bare word, else empty."""
    local = address.partition("@")[0].lower()
    return local if len(local) >= 5 and local not in _ROLES else ""


def _forms(kind: int, digits: str) -> list[str]:
    """Digits that repeat a number in another form: phones with or without codes, cards however grouped."""
    if KINDS[kind] != "phone":
        return [digits]
    ends = [digits[i:] for i in range(len(digits) - 6)]
    return [*ends, *(f"0{x}" for x in ends), f"00{digits}"]


def _link_numbers(out: list[Token], numbers: dict[str, str]) -> None:
    """Give neighbouring tokens that together write a number again its key; the longest run first."""
    longest = max(map(len, numbers))
    at = 0
    while at < len(out):
        end, digits, found = at, "", None
        while (end < len(out) and not out[end].label and out[end].digits and len(digits) <= longest
               and (end == at or out[end].place == out[end - 1].place + 1)):
            digits += out[end].digits
            end += 1
            if key := numbers.get(digits):
                found = end, key
        if found:
            for t in out[at:found[0]]:
                t.keys += (found[1],)
        at = found[0] if found else at + 1


def tokens_of(text: str, spans: list[Span]) -> list[Token]:
    """Tokens that may belong to personal data: with a digit or @, or alike to part of an address."""
    locals_ = {_local(text[s:e]) for k, s, e in spans if k == 0} - {""}
    numbers: dict[str, str] = {}
    ends: dict[int, str] = {}
    for k, s, e in spans:
        if KINDS[k] in ("card", "phone"):
            digits = _NON_DIGIT.sub("", text[s:e])
            ends[e] = f"n:{k}:{digits}"
            for form in _forms(k, digits):
                numbers.setdefault(form, ends[e])
    out, ordered, at = [], sorted(spans, key=lambda x: (x[1], x[2])), 0
    reach: list[Span] = []
    for place, m in enumerate(_TOKEN.finditer(text)):
        word = m.group()
        bare = word.strip(_EDGE)
        low = bare.lower()
        if not ("@" in word or _DIGIT.search(word) or low in locals_):
            continue
        while at < len(ordered) and ordered[at][1] < m.end():
            reach.append(ordered[at])
            at += 1
        reach = [x for x in reach if x[2] > m.start()]
        label = reach[0][0] + 1 if reach else 0
        digits = _NON_DIGIT.sub("", word)
        # a group of a number says little alone
        group = label and KINDS[label - 1] in ("card", "phone") and len(digits) < 7
        keys = [f"w:{low}"] if len(low) >= 5 and not group else []
        if len(digits) >= 7:
            keys.append(f"d:{digits[-7:]}")
        if "@" in low and (local := low.strip("@").partition("@")[0]) in locals_:
            keys.append(f"w:{local}")
        for k, s, e in reach:
            if k == 0 and (local := _local(text[s:e])):
                keys.append(f"w:{local}")
            if e <= m.end() and e in ends:
                keys.append(ends[e])
        lo = m.start() + word.find(bare)
        plain = "" if any(c.isalpha() or c == "@" for c in word) else digits
        out.append(Token(lo, lo + len(bare), label, place, tuple(map(int, _features(word))),
                         tuple(dict.fromkeys(keys)), plain))
    if numbers:
        _link_numbers(out, numbers)
    return out


def _partial_mentions(kind: int, found: str) -> list[list[str]]:
    """Ways to write a base span again that its pattern doesn't match: lists of words."""
    if kind == 0:
        local = _local(found)
        return [[x] for x in (local, "".join(c for c in local if c.isalpha())) if x]
    digits = _NON_DIGIT.sub("", found)
    groups = [digits[i:i + 4] for i in range(0, len(digits), 4)]
    if KINDS[kind] == "card":
        return [[digits], [".".join(groups)], groups]
    if KINDS[kind] == "phone":
        bare = found.lstrip("+")
        return [x for x in ([digits[-7:]], [f"{digits[-7:-4]}-{digits[-4:]}"], [f"({digits[-10:-7]})", digits[-7:]],
                            [digits[-10:-7], digits[-7:-4], digits[-4:]],
                            [f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}"],
                            [f"({digits[-10:-7]})", f"{digits[-7:-4]}-{digits[-4:]}"], bare.split(), bare.split()[1:]) if x]
    return []


@dataclass
class Graph:
    """Tokens of many documents, with chain and skip edges between their numbers."""

    features: np.ndarray
    observed: np.ndarray
    alone: np.ndarray  #: neighbours on the chain that are plain text: 0, 1 or 2
    chain: np.ndarray
    skip: np.ndarray


def graph_of(documents: list[list[Token]]) -> Graph:
    feats, obs, alone, chain, skip = [], [], [], [], []
    for tokens in documents:
        last: dict[str, int] = {}
        # what writes a number of a base span again is linked to the span itself
        first = len(feats)
        held = {k: first + i for i, t in reversed(list(enumerate(tokens))) if t.label for k in t.keys if k.startswith("n:")}
        for t in tokens:
            n = len(feats)
            feats.append(t.features)
            obs.append(t.label)
            alone.append(2)
            if n and tokens[0] is not t and t.place == before + 1:
                chain.append((n - 1, n))
                alone[n] -= 1
                alone[n - 1] -= 1
            before = t.place
            # occurrences are linked one after another: as many edges as tokens, not as pairs
            own = [k for k in t.keys if k not in held]
            near = {last[k] for k in own if k in last} | {held[k] for k in t.keys if k in held} - {n}
            skip += [(i, n) for i in sorted(near)]
            last.update(dict.fromkeys(own, n))
    edges = lambda x: np.array(x, np.int64).reshape(-1, 2)
    return Graph(np.array(feats, float).reshape(-1, N_FEATURES), np.array(obs, np.int64), np.array(alone, float),
                 edges(chain), edges(skip))


@dataclass
class SkipChainCRF:
    unary: np.ndarray  #: features x labels
    chain: np.ndarray  #: labels x labels, symmetric
    skip: np.ndarray  #: labels x labels, symmetric

    def marginals(self, g: Graph) -> np.ndarray:
        """Loopy sum-product with observed tokens clamped."""
        node = g.features @ self.unary + g.alone[:, None] * self.chain[0][None, :]
        seen = g.observed > 0
        node[seen] = -50.0
        node[seen, g.observed[seen]] = 0.0
        edges = np.concatenate([g.chain, g.skip])
        pots = np.concatenate([np.repeat(self.chain[None], len(g.chain), 0), np.repeat(self.skip[None], len(g.skip), 0)])
        src = np.concatenate([edges[:, 0], edges[:, 1]])
        dst = np.concatenate([edges[:, 1], edges[:, 0]])
        pots = np.concatenate([pots, pots.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges), 2 * len(edges)), np.arange(len(edges))])
        msg = np.zeros((len(src), N_LABELS))
        for _ in range(ROUNDS if len(src) else 0):
            belief = node.copy()
            np.add.at(belief, dst, msg)
            new = _lse(pots + (belief[src] - msg[back])[:, :, None], 1)
            new -= new.max(axis=1, keepdims=True)
            msg = DAMPING * msg + (1 - DAMPING) * new
        belief = node
        np.add.at(belief, dst, msg)
        belief = np.exp(belief - belief.max(axis=1, keepdims=True))
        return belief / belief.sum(axis=1, keepdims=True)

    def added(self, documents: list[list[Token]], marginal: float = MARGINAL) -> list[list[Span]]:
        g = graph_of(documents)
        post = self.marginals(g) if len(g.observed) else np.zeros((0, N_LABELS))
        reach = _reached(g)
        out, n = [], 0
        for tokens in documents:
            spans = []
            for t in tokens:
                k = int(post[n].argmax())
                if not t.label and k and post[n, k] >= marginal and k in reach[n]:
                    spans.append((k - 1, t.start, t.end))
                n += 1
            out.append(spans)
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _reached(g: Graph) -> list[set[int]]:
    """Observed labels that each token's skip paths lead to."""
    root = list(range(len(g.observed)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in g.skip:
        root[find(int(a))] = find(int(b))
    labels: dict[int, set[int]] = defaultdict(set)
    for i, label in enumerate(g.observed):
        if label:
            labels[find(i)].add(int(label))
    return [labels[find(i)] for i in range(len(root))]


def _hidden_rows(texts: list[str], spans: list[list[Span]]) -> list[list[int]]:
    """Rows of partial mentions: the label is known, the form isn't that of a pattern, a skip edge leads to the span."""
    rows = []
    for text, found in zip(texts, spans, strict=True):
        for k, s, e in found:
            for words in _partial_mentions(k, text[s:e]):
                for i, w in enumerate(words):
                    x = [0] * (2 * N_LABELS)
                    near = (i > 0) + (i + 1 < len(words))
                    x[0] = 2 - near
                    x[k + 1] = near
                    x[N_LABELS + k + 1] = 1
                    rows.append([k + 1, *map(int, _features(w)), *x])
    return rows


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Label, features and neighbours' labels of tokens, counted; hidden rows are partial mentions.

    A token outside the base spans that skip edges join to one has no known label:
    it is no row, nor does it count as a neighbour.
    """
    for b in batches:
        texts = [t for t in b.column("text").to_pylist() if t]
        texts = [t for t in texts if "@" in t or _DIGIT.search(t)]
        spans = [base_spans(t) for t in texts]
        g = graph_of([tokens_of(t, s) for t, s in zip(texts, spans, strict=True)])
        if not len(g.observed):
            continue
        known = (g.observed > 0) | np.array([not r for r in _reached(g)])
        x = np.zeros((len(g.observed), 2 * N_LABELS), np.int64)
        x[:, 0] = g.alone
        for at, edges in ((0, g.chain), (N_LABELS, g.skip)):
            for i, j in ((0, 1), (1, 0)):
                e = edges[known[edges[:, j]]]
                np.add.at(x, (e[:, i], at + g.observed[e[:, j]]), 1)
        plain = np.concatenate([g.observed[:, None], g.features.astype(np.int64), x], axis=1)[known]
        hidden = np.array(_hidden_rows(texts, spans), np.int64).reshape(-1, plain.shape[1])
        for rows, is_hidden in ((plain, False), (hidden, True)):
            kinds, n = np.unique(rows, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.tolist(), pa.list_(pa.int64())), pa.array(n, pa.int64()),
                                              pa.array([is_hidden] * len(n), pa.bool_())], names=["row", "n", "hidden"])


def train(docs: DataFrame, sample_docs: int = 3000, steps: int = 300, ridge: float = 1e-3,
          n_docs: int | None = None) -> SkipChainCRF:
    """Fit the potentials by pseudo-likelihood, the base spans being the labels.

    Partial mentions of the base spans weigh as much as all else, each kind as
    much as another: they are rare, but what the field is for.
    `sample_docs` bounds the sample: about that many rows of `docs` (doc_id,
    text) by the hash of id and text; `n_docs` is their number, counted if not
    given.  Equal rows are counted in Spark.
    """
    small_batches(docs.sparkSession)
    rows = F.lit(docs.count() if n_docs is None else n_docs)
    sample = docs.filter(sampled(sample_docs, rows, F.lit("pii"), F.col("doc_id"), F.col("text"))).select("text")
    rows = (sample.mapInArrow(_training_rows, "row array<long>, n long, hidden boolean")
            .groupBy("row", "hidden").agg(F.sum("n").alias("n")).orderBy("row", "hidden").toPandas())
    size = N_FEATURES + 2 * N_LABELS
    if rows.empty:
        return SkipChainCRF(np.zeros((N_FEATURES, N_LABELS)), np.zeros((N_LABELS,) * 2), np.eye(N_LABELS))
    data = np.array(rows["row"].tolist(), float)
    y, x, weight = data[:, 0].astype(int), data[:, 1:], rows["n"].to_numpy(float)
    hidden = rows["hidden"].to_numpy(bool)
    kinds = np.unique(y[hidden])
    for part, share in ((~hidden, 0.5 if len(kinds) else 1.0), *((hidden & (y == k), 0.5 / len(kinds)) for k in kinds)):
        weight[part] *= share / max(1.0, weight[part].sum())
    # potentials between tokens are symmetric: a neighbour's label adds its row
    w, speed = np.zeros((size, N_LABELS)), np.zeros((size, N_LABELS))
    w[N_FEATURES + N_LABELS:] = np.eye(N_LABELS)
    goal = np.eye(N_LABELS)[y]
    for _ in range(steps):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed - 0.5 * (x.T @ ((p - goal) * weight[:, None]) + ridge * w)
        for lo in (N_FEATURES, N_FEATURES + N_LABELS):
            part = speed[lo:lo + N_LABELS]
            part[:] = (part + part.T) / 2
        w = w + speed
    return SkipChainCRF(w[:N_FEATURES], w[N_FEATURES:N_FEATURES + N_LABELS], w[N_FEATURES + N_LABELS:])


def detect(texts: list[str | None], model: SkipChainCRF, marginal: float = MARGINAL) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, spans the field adds) of each text."""
    base = [base_spans(t) for t in texts]
    # without a base span there is no observed label that a path could carry
    held = [i for i, b in enumerate(base) if b]
    more = dict(zip(held, model.added([tokens_of(texts[i], base[i]) for i in held], marginal), strict=True))
    return [(b, sorted(more.get(i, []))) for i, b in enumerate(base)]


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[Span]) -> str:
    """Overlapping spans become one mark, named after the first of them."""
    out, done = [], 0
    merged: list[list[int]] = []
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([k, s, e])
    for k, s, e in merged:
        out += [text[done:s], f"[{KINDS[k].upper()}]"]
        done = e
    return "".join(out) + text[done:]


def _finder(spark, model: SkipChainCRF, marginal: float):
    """A column function: base (string), spans (string), counts by kind, redacted text."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("base string, spans string, n array<long>, redacted string")
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [t if isinstance(t, str) else None for t in part]
            rows = []
            for t, (base, more) in zip(texts, detect(texts, shared.value, marginal), strict=True):
                every = sorted(base + more)
                rows.append((written(base), written(every), [sum(k == i for k, *_ in base) for i in range(len(KINDS))],
                             redact(t, every) if every else t))
            yield pd.DataFrame(rows, columns=["base", "spans", "n", "redacted"])

    return find


def scan(docs: DataFrame, model: SkipChainCRF, text_col: str = "text", marginal: float = MARGINAL) -> DataFrame:
    """`docs` with `pii`: base (string), spans (string), counts by kind, redacted text.

    Null texts: no spans, redacted stays null.  Texts are taken whole, however long.
    A column called pii is replaced; repeated rows get equal results.
    """
    return with_columns(docs, pii=_finder(docs.sparkSession, model, marginal)(F.col(f"`{text_col}`")))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans."""
    found = scan(docs.select("doc_id", "text"), train(docs.select("doc_id", "text")))
    return found.select("doc_id", *[F.element_at("pii.n", i + 1).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                        F.sha2(F.col("pii.base").cast("binary"), 256).alias("base_sha256"),
                        F.col("pii.spans").alias("spans"))


def mask(docs: DataFrame, marginal: float = MARGINAL) -> DataFrame:
    """`docs` with personal data replaced in text; n_chars follows where it is a column.

    All other columns, whatever their names, stay as they are.
    """
    text = F.col("text")
    find = _finder(docs.sparkSession, train(docs.select("doc_id", "text")), marginal)
    # the input's columns go along as one struct, so no name of theirs meets one of ours
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), find(text).alias("found"))
    red = F.col("found.redacted")
    cols = []
    for c in docs.columns:
        old = F.col("row").getField(c)
        if c == "text":
            old = red
        elif c == "n_chars":
            changed = ~red.eqNullSafe(F.col("row").getField("text"))
            old = F.when(changed, F.length(red).cast(docs.schema["n_chars"].dataType)).otherwise(old)
        cols.append(old.alias(c))
    return out.select(*cols)


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
