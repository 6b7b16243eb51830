"""Interpolated modified Kneser-Ney n-gram model (bigrams unless told otherwise), counted in Spark.

Tokens are word hashes; an n-gram is the row of its words' hashes.  Tasks count
the n-grams of their texts and send them, cut by the n-gram's own hash, to shards
of bounded size, so no frequent word makes a hot shard.  A shard adds its counts
up and writes sorted hash arrays to the shared folder; what it knows of the
n-grams one word shorter (occurrences, left contexts, counts of counts of right
neighbours) goes on to their shards, which do the same, down to single words.
Scoring workers memory-map the arrays and look up a batch of texts at a time by
binary search.
"""

from __future__ import annotations

import io
from collections import OrderedDict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import fold, read_whole, shared_folder, small_batches, with_columns, write_whole

#: Word hashes keep 56 bits: seven bytes in the shuffle.
BYTES = 7
BITS = 8 * BYTES
#: Hashes of what no word can be (words hold no white space): the end and the start of a text.
END = xxhash.xxh64_intdigest(b"\n") >> 8
START = xxhash.xxh64_intdigest(b"\n\n") >> 8
#: Tokens counted by a task before it sends them on, and tokens of a shard.
FLUSH_TOKENS, SHARD_TOKENS = 3_000_000, 2_000_000
#: Bytes of arrays that a worker keeps of a model it can't memory-map (one on remote storage).
KEPT_BYTES = 1 << 28
_CACHE = 400_000
_U8 = np.uint64


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word) >> 8
        return h


def token_hashes(text: str | None, cache: _Hashes) -> np.ndarray:
    """Hashes of the words of a text (A-Z lower-cased) and of its end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out = np.empty(len(words) + 1, _U8)
    out[:-1] = np.fromiter(map(cache.__getitem__, words), _U8, len(words))
    out[-1] = END
    return out


def bigram_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = v * _U8(0x9E3779B97F4A7C15) + w
    x = (x ^ (x >> _U8(32))) * _U8(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U8(29))) * _U8(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U8(32))


def gram_hash(words: Sequence[np.ndarray]) -> np.ndarray:
    """Key of n-grams given by the hashes of their first, second, ... words; a single word is its own key."""
    key = words[0]
    for w in words[1:]:
        key = bigram_hash(key, w)
    return key


def _width(k: int) -> int:
    return BITS if k == 1 else 64


def _pack(words: Sequence[np.ndarray]) -> bytes:
    return b"".join(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes() for h in words)


def _unpack(raw: bytes, k: int) -> np.ndarray:
    """The word hashes (k x n-grams) of packed n-grams."""
    out = np.zeros((len(raw) // BYTES, 8), np.uint8)
    out[:, :BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, BYTES)
    return out.view("<u8").reshape(k, -1)


def _slices(keys: np.ndarray, bits: int, width: int) -> Iterator[tuple[int, slice]]:
    """The runs of sorted keys of `width` bits that share their first `bits`."""
    if not len(keys):
        return
    shard = keys >> _U8(width - bits) if bits else np.zeros(len(keys), _U8)
    edges = [0, *(np.nonzero(shard[1:] != shard[:-1])[0] + 1).tolist(), len(keys)]
    for lo, hi in zip(edges, edges[1:]):  # noqa: B905
        yield int(shard[lo]), slice(lo, hi)


def _count_grams(order: int, bits: int):
    def flush(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        words = [np.concatenate(p) for p in parts]
        keys, first, n = np.unique(gram_hash(words), return_index=True, return_counts=True)
        words = [w[first] for w in words]
        rows = [(s, _pack([w[at] for w in words]), n[at].astype("<u4").tobytes()) for s, at in _slices(keys, bits, _width(order))]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32())]
                                          + [pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2)],
                                          names=["shard", "words", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, held = _Hashes(), 0
        parts: list[list[np.ndarray]] = [[] for _ in range(order)]
        for b in batches:
            for t in b.column("text").to_pylist():
                h = np.concatenate([np.full(order - 1, START, _U8), token_hashes(t, cache)])
                for lo in range(0, len(h) - order + 1, FLUSH_TOKENS):
                    n = min(FLUSH_TOKENS, len(h) - order + 1 - lo)
                    for k, part in enumerate(parts):
                        part.append(h[lo + k:lo + k + n])
                    held += n
                    if held >= FLUSH_TOKENS:
                        yield flush(parts)
                        parts, held = [[] for _ in range(order)], 0
        if held:
            yield flush(parts)
    return run


def _write(folder: str, name: str, array: np.ndarray) -> None:
    """Put an array into the shared folder: whole or not at all, the same from any attempt."""
    held = io.BytesIO()
    np.save(held, array)
    write_whole(folder, f"{name}.npy", held.getvalue())


def _merge(words: Sequence[np.ndarray], columns: Sequence[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Sorted keys of the distinct n-grams, their words and the sums of their columns."""
    key, first, inverse = np.unique(gram_hash(words), return_index=True, return_inverse=True)
    return key, [w[first] for w in words], [np.bincount(inverse, c, len(key)).astype(np.int64) for c in columns]


# what is known of an n-gram below the highest order: occurrences, left contexts, right neighbours seen once, twice,
# more often, and their total
_COLS = 6


def _counts_of(n: np.ndarray) -> list[int]:
    """Distinct n-grams, the sum of their counts, and how many were counted once, twice, three and four times."""
    return [int((n > 0).sum()), int(n.sum()), *[int((n == k).sum()) for k in (1, 2, 3, 4)]]


def _pass_on(words: list[np.ndarray], n: np.ndarray, times: np.ndarray, bits: int) -> list[tuple]:
    """Rows for the shards of the n-grams one word shorter: those that end these n-grams, and those that start them."""
    k, one, zero = len(words) - 1, np.ones_like(n), np.zeros_like(n)
    ends = [times, one, zero, zero, zero, zero]
    starts = [zero, zero, (n == 1) * one, (n == 2) * one, (n > 2) * one, n]
    key, words, cols = _merge([np.concatenate([words[i + 1], words[i]]) for i in range(k)],
                              [np.concatenate(c) for c in zip(ends, starts, strict=True)])
    return [(s, _pack([w[at] for w in words]),
             b"".join(c[at].astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in cols), None)
            for s, at in _slices(key, bits, _width(k))]


_ROWS = "shard int, words binary, cols binary, stats array<long>"


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
                     pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
                    names=["shard", "words", "cols", "stats"])


def _add_top(folder: str, order: int, bits: int):
    """Sum a shard of the highest order, write its arrays, pass on what it says of shorter n-grams and counts of counts."""
    def run(key: tuple, t: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        words = list(np.concatenate([_unpack(x, order) for x in t.column("words").to_pylist()], axis=1))
        n = np.concatenate([np.frombuffer(x, "<u4") for x in t.column("n").to_pylist()])
        keys, words, (count,) = _merge(words, [n])
        large = np.nonzero(count >= 255)[0]
        _write(folder, f"gram{order}-{shard}-key", keys)
        _write(folder, f"gram{order}-{shard}-count", np.minimum(count, 255).astype(np.uint8))
        _write(folder, f"gram{order}-{shard}-large", np.stack([large.astype(np.int64), count[large]]))
        return _table([*_pass_on(words, count, count, bits), (shard, b"", b"", _counts_of(count))])
    return run


def _add_lower(folder: str, order: int, k: int, bits: int):
    """Sum a shard of n-grams of k words below the highest order and write its arrays; what it passes on ends with its counts."""
    def run(key: tuple, t: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        words, cols, stats = [], [[] for _ in range(_COLS)], []
        for w, c, s in zip(*(t.column(x).to_pylist() for x in ("words", "cols", "stats")), strict=True):
            if s is not None:
                stats.append(s)
                continue
            words.append(_unpack(w, k))
            planes = np.frombuffer(c, np.uint8).reshape(_COLS, 8, -1)
            for i in range(_COLS):
                cols[i].append(np.ascontiguousarray(planes[i].T).view("<i8").ravel())
        rows, own = [], [0] * 6
        if words:
            keys, parts, sums = _merge(list(np.concatenate(words, axis=1)), [np.concatenate(c) for c in cols])
            _write(folder, f"gram{k}-{shard}-key", keys)
            _write(folder, f"gram{k}-{shard}-cols", np.stack(sums, axis=1))
            own = [int((sums[0] > 0).sum()), *_counts_of(sums[1])[1:]]
            if k > 1:
                ends = np.nonzero(sums[1])[0]  # the rest only start others, as the start of a text does
                rows = _pass_on([w[ends] for w in parts], sums[1][ends], sums[0][ends], bits)
        above = np.sum([[0] * 6 * (order - k), *stats], axis=0).astype(int).tolist()
        return _table([*rows, (shard, b"", b"", [*above, *own])])
    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Discounts of counts 0, 1, 2 and more, from counts of counts; a half where they say nothing."""
    if not n1 or not n2:
        return [0.0, 0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, (3 - 4 * y * n4 / n3) if n3 else 1.5]
    return [0.0, *[min(max(x, 0.0), float(k)) for k, x in enumerate(d[1:], 1)]]


@dataclass
class KneserNey:
    """Where the arrays are, and the numbers of the whole corpus; lists go by order, from single words."""

    folder: str
    bits: int
    shards: list[set[int]]
    tokens: int  #: N
    types: int  #: V
    left_total: int  #: sum of the words' left contexts
    discount: list[list[float]] = field(default_factory=list)
    word_spread: float = 1.0  #: share of the lowest order left to the uniform distribution

    @property
    def order(self) -> int:
        return len(self.shards)

    def reader(self) -> _Reader:
        return _Reader(self)


#: Arrays of models on remote storage that this worker has fetched, least used first.
_fetched: OrderedDict[tuple[str, str], np.ndarray] = OrderedDict()


def _fetch(folder: str, name: str) -> np.ndarray:
    """An array of a model on remote storage; a worker keeps up to KEPT_BYTES of them, over all its tasks."""
    array = _fetched.pop((folder, name), None)
    if array is None:
        array = np.load(io.BytesIO(read_whole(folder, f"{name}.npy")))
        held = array.nbytes + sum(a.nbytes for a in _fetched.values())
        while _fetched and held > KEPT_BYTES:
            held -= _fetched.popitem(last=False)[1].nbytes
    _fetched[folder, name] = array
    return array


class _Reader:
    """Memory-maps the arrays; those on remote storage are fetched a shard at a time."""

    def __init__(self, model: KneserNey):
        self.m, self.maps, self.hashes = model, {}, _Hashes()
        fs, self.path = pafs.FileSystem.from_uri(model.folder)
        self.mounted = isinstance(fs, pafs.LocalFileSystem)

    def _map(self, name: str) -> np.ndarray:
        if not self.mounted:
            return _fetch(self.m.folder, name)
        if name not in self.maps:
            array = np.load(f"{self.path}/{name}.npy", mmap_mode="r")
            self.maps[name] = array if array.size else np.zeros(array.shape, array.dtype)
        return self.maps[name]

    def _find(self, k: int, sorted_keys: np.ndarray):
        for s, at in _slices(sorted_keys, self.m.bits, _width(k)):
            if s in self.m.shards[k - 1]:
                keys = self._map(f"gram{k}-{s}-key")
                pos = np.minimum(np.searchsorted(keys, sorted_keys[at]), len(keys) - 1)
                hit = keys[pos] == sorted_keys[at]
                yield s, at.start + np.nonzero(hit)[0], pos[hit]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of n-grams of the highest order."""
        k = self.m.order
        keys, inverse = np.unique(keys, return_inverse=True)
        out = np.zeros(len(keys), np.int64)
        for s, to, pos in self._find(k, keys):
            count = self._map(f"gram{k}-{s}-count")[pos].astype(np.int64)
            full = count == 255
            if full.any():
                large = self._map(f"gram{k}-{s}-large")
                count[full] = large[1][np.searchsorted(large[0], pos[full])]
            out[to] = count
        return out[inverse]

    def columns(self, k: int, keys: np.ndarray) -> np.ndarray:
        """What is known of n-grams of k words, below the highest order."""
        keys, inverse = np.unique(keys, return_inverse=True)
        out = np.zeros((len(keys), _COLS), np.int64)
        for s, to, pos in self._find(k, keys):
            out[to] = self._map(f"gram{k}-{s}-cols")[pos]
        return out[inverse]

    def score(self, texts: list[str | None]) -> list[tuple[int, int, float, float]]:
        """n_tokens, n_known, base_score and score of each text; in runs of bounded length."""
        out: list[tuple[int, int, float, float]] = []
        group: list[np.ndarray] = []
        held, before = 0, np.full(self.m.order - 1, START, _U8)
        for t in texts:
            h = np.concatenate([before, token_hashes(t, self.hashes)])
            n = len(h) - len(before)
            if n > FLUSH_TOKENS:
                out += self._score(group)
                group, held = [], 0
                parts = [self._score([h[lo:lo + FLUSH_TOKENS + len(before)]])[0] for lo in range(0, n, FLUSH_TOKENS)]
                out.append(tuple(map(sum, zip(*parts, strict=True))))
                continue
            if held + n > FLUSH_TOKENS:
                out += self._score(group)
                group, held = [], 0
            group.append(h)
            held += n
        return out + self._score(group)

    def _score(self, group: list[np.ndarray]) -> list[tuple[int, int, float, float]]:
        """Of runs of tokens, each behind the order - 1 tokens before it."""
        if not group:
            return []
        m, back = self.m, self.m.order - 1
        every = np.concatenate(group)
        lens = [len(g) - back for g in group]
        starts = np.cumsum([0, *lens[:-1]])
        at = np.arange(sum(lens)) + np.repeat(back * np.arange(1, len(group) + 1), lens)
        words = self.columns(1, every)
        own = words[at]
        # the lowest order: continuation counts, interpolated with the uniform distribution
        d, left = np.array(m.discount[0]), own[:, 1]
        p = np.maximum(left - d[np.minimum(left, 3)], 0) / max(m.left_total, 1) + m.word_spread / (m.types + 1)
        for k in range(2, m.order + 1):
            context = gram_hash([every[at - i] for i in range(k - 1, 0, -1)])
            cols = words[at - 1] if k == 2 else self.columns(k - 1, context)
            grams = bigram_hash(context, every[at])
            c = self.counts(grams) if k == m.order else self.columns(k, grams)[:, 1]
            d, total = np.array(m.discount[k - 1]), cols[:, 5]
            spread = cols[:, 2] * d[1] + cols[:, 3] * d[2] + cols[:, 4] * d[3]
            share = np.maximum(c - d[np.minimum(c, 3)], 0) / np.maximum(total, 1)
            p = share + np.where(total > 0, spread / np.maximum(total, 1), 1.0) * p
        known = own[:, 0] > 0
        base = np.log10((own[:, 0] + 1) / (m.tokens + (m.types + 1)))
        add = lambda x: np.add.reduceat(x, starts)
        return list(zip(lens, map(int, add(known.astype(np.int64))), map(float, add(base)),
                        map(float, add(np.log10(p))), strict=True))


def train(docs: DataFrame, text_col: str = "text", order: int = 2) -> KneserNey:
    """Count all of `docs` and write the model to the shared checkpoint folder.

    `order` is the number of words of the longest n-grams, two or more.  The
    number of shards follows the corpus.  The driver gets a few counts from each
    word shard.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_folder(spark, "kneser-ney")
    text = docs.select(F.col(f"`{text_col}`").alias("text"))
    size = text.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(30, max(0, int(np.ceil(np.log2(max(1, size / 6 / SHARD_TOKENS))))))  # a shard's number is 31 bits
    shards = (text.mapInArrow(_count_grams(order, bits), "shard int, words binary, n binary")
              .groupBy("shard").applyInArrow(_add_top(folder, order, bits), _ROWS))
    for k in range(order - 1, 0, -1):
        shards = shards.groupBy("shard").applyInArrow(_add_lower(folder, order, k, bits), _ROWS)
    found = np.sum([[0] * 6 * order, *[r["stats"] for r in shards.select("stats").collect()]], axis=0).astype(int).tolist()
    # from the highest order down to words: n-grams, sum of counts, counts of counts
    stats = [found[6 * i:6 * i + 6] for i in range(order)]
    fs, path = pafs.FileSystem.from_uri(folder)
    names = [f.base_name for f in fs.get_file_info(pafs.FileSelector(path))]
    held = [{int(n.split("-")[1]) for n in names if n.startswith(f"gram{k}-") and n.endswith("-key.npy")}
            for k in range(1, order + 1)]
    types, left, *n = stats[-1]
    d = discounts(*n)
    spread = (d[1] * n[0] + d[2] * n[1] + d[3] * (types - n[0] - n[1])) / left if left else 1.0
    return KneserNey(folder, bits, held, stats[0][1], types, left, [discounts(*x[2:]) for x in reversed(stats)], spread)


def score(docs: DataFrame, model: KneserNey, text_col: str = "text") -> DataFrame:
    """`docs` with `lm`: n_tokens, n_known, base_score, score (log10).

    Whole texts count; null and empty texts are their end alone.  With nothing
    learnt every token gets the uniform share of the unknown.  A column called lm
    is replaced; repeated rows get equal results.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("n_tokens long, n_known long, base_score double, score double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader = shared.value.reader()
        for part in parts:
            rows = reader.score([t if isinstance(t, str) else None for t in part])
            yield pd.DataFrame(rows, columns=["n_tokens", "n_known", "base_score", "score"])

    return with_columns(docs, lm=run(F.col(f"`{text_col}`")))


def score_documents(docs: DataFrame, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; a null id trains."""
    held = F.coalesce(fold(F.col("doc_id"), 7) == 2, F.lit(False))
    slim = docs.select("doc_id", "text", held.alias("held_out"))
    model = train(slim.filter(~F.col("held_out")), order=order)
    return score(slim, model).select("doc_id", "held_out", "lm.n_tokens", "lm.n_known",
                                     F.lit(model.tokens).cast("long").alias("train_tokens"), "lm.base_score", "lm.score")
