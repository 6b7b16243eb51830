"""Language identification with segmentation-marginalised unigrams.

A language is a probability for each piece of a fixed public vocabulary.  The
probability of a word is the sum over all its segmentations into pieces (forward
algorithm); a text is the product over its words.  Piece probabilities are fitted
by expectation maximisation: forward-backward gives the expected pieces of the
training words, and Spark adds them up.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import cut, fold, sampled, small_batches, with_columns

#: Longest piece, and longest run of letters segmented as one word; longer runs are cut into several.
PIECE_CHARS, WORD_CHARS = 8, 32
WORD = re.compile(rf"[^\W\d_]{{1,{WORD_CHARS}}}")
BEGIN = "▁"
#: Probability of a letter that no piece covers, the same in every language.
UNKNOWN = 1e-7
UNDETERMINED = "und"
_CACHE = 300_000
#: Languages whose piece probabilities stand side by side.
LANG_BLOCK = 64


def vocabulary(path: str | None = None) -> dict[str, int]:
    """Lower-cased pieces of a public piece model, numbered from 0."""
    import sentencepiece
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[str, int] = {}
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i).lower()
        body = p.lstrip(BEGIN)
        if not model.is_control(i) and not model.is_byte(i) and len(p) <= PIECE_CHARS and body.isalpha():
            out.setdefault(p, len(out))
    return out


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class PieceTable:
    """Numbers of pieces by the hash of their letters, looked up for whole arrays.

    Two direct-addressed levels: a piece whose slot is taken goes to the second,
    whose seed is chosen so that nothing collides there.
    """

    BITS, BASE = 18, np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, vocab: dict[str, int], none: int):
        keys = np.array([self._hash(np.array([[ord(c) for c in p]]))[0, 0] for p in vocab] or [0], np.uint64)
        ids = np.array(list(vocab.values()) or [none], np.int32)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash")
        left, self.levels, seed = np.arange(len(keys)), [], 0
        while len(self.levels) < 2:
            odd = np.uint64((2 * seed + 1) * 0xD1342543DE82EF95 % 2**64)
            slot = self._slot(keys[left], odd)
            first = np.unique(slot, return_index=True)[1]
            seed += 1
            if self.levels and len(first) < len(left):
                continue
            table_key, table_id = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, none, np.int32)
            table_key[slot[first]], table_id[slot[first]] = keys[left[first]], ids[left[first]]
            self.levels.append((odd, table_key, table_id))
            left = np.delete(left, first)
        self.none = none

    @classmethod
    def _hash(cls, codes: np.ndarray) -> np.ndarray:
        """Hash of whole rows of letters, as (n, 1)."""
        h = np.zeros((len(codes), 1), np.uint64)
        for i in range(codes.shape[1]):
            h = (h + codes[:, i:i + 1].astype(np.uint64) + np.uint64(1)) * cls.BASE
        return h

    def _slot(self, keys: np.ndarray, odd: np.uint64) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(29))) * odd) >> np.uint64(64 - self.BITS)

    def spans(self, words: list[str], n: int) -> np.ndarray:
        """ids[word, end, length]: the piece of that length that ends there; words of n letters."""
        ids = np.full((len(words), n + 1, PIECE_CHARS + 1), self.none, np.int32)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), n).astype(np.uint64)
        h = np.zeros((len(words), n + 1), np.uint64)
        for k in range(1, min(n, PIECE_CHARS) + 1):
            h = (h[:, :n - k + 1] + codes[:, k - 1:] + np.uint64(1)) * self.BASE
            found = ids[:, k:, k]
            for odd, table_key, table_id in self.levels:
                slot = self._slot(h, odd)
                hit = table_key[slot] == h
                found[hit] = table_id[slot[hit]]
        return ids


class Segmenter:
    """Forward (and backward) sums over the segmentations of many words at once."""

    def __init__(self, vocab: dict[str, int], probs: np.ndarray, table: PieceTable | None = None):
        # the last two rows: a letter without a piece, and no piece at all
        self.unknown, self.none = len(vocab), len(vocab) + 1
        self.table = table or PieceTable(vocab, self.none)
        tail = np.zeros((2, probs.shape[1]))
        tail[0] = UNKNOWN
        self.probs = np.concatenate([probs, tail])

    def _ids(self, words: list[str], n: int) -> np.ndarray:
        ids = self.table.spans(words, n)
        one = ids[:, 1:, 1]
        one[one == self.none] = self.unknown
        return ids

    def forward(self, words: list[str]) -> np.ndarray:
        """log probability of each word in each language; words of one length are summed together."""
        out = np.zeros((len(words), self.probs.shape[1]))
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w) + 1, []).append(i)
        for n, at in by.items():
            for lo in range(0, len(at), 4096):
                rows = at[lo:lo + 4096]
                ids = self._ids([BEGIN + words[i] for i in rows], n)
                alpha = self._alpha(ids, n)
                out[rows] = np.log(alpha[n])
        return out

    def _alpha(self, ids: np.ndarray, n: int) -> list[np.ndarray]:
        alpha = [np.ones((len(ids), self.probs.shape[1]))]
        for end in range(1, n + 1):
            alpha.append(sum(alpha[end - k] * self.probs[ids[:, end, k]] for k in range(1, min(end, PIECE_CHARS) + 1)))
        return alpha

    def expected(self, words: list[str], counts: np.ndarray, langs: np.ndarray) -> np.ndarray:
        """Expected pieces (vocabulary x languages) of words counted in one language each."""
        n_langs = self.probs.shape[1]
        total = np.zeros(self.probs.size)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w) + 1, []).append(i)
        for n, at in by.items():
            for lo in range(0, len(at), 4096):
                rows = np.array(at[lo:lo + 4096])
                ids, lang = self._ids([BEGIN + words[i] for i in rows], n), langs[rows]
                p = self.probs[ids, lang[:, None, None]]
                alpha, beta = np.zeros((len(rows), n + 1)), np.zeros((len(rows), n + 1))
                alpha[:, 0], beta[:, n] = 1, 1
                for end in range(1, n + 1):
                    for k in range(1, min(end, PIECE_CHARS) + 1):
                        alpha[:, end] += alpha[:, end - k] * p[:, end, k]
                for end in range(n, 0, -1):
                    for k in range(1, min(end, PIECE_CHARS) + 1):
                        beta[:, end - k] += beta[:, end] * p[:, end, k]
                weight = counts[rows] / alpha[:, n]
                for end in range(1, n + 1):
                    for k in range(1, min(end, PIECE_CHARS) + 1):
                        post = alpha[:, end - k] * p[:, end, k] * beta[:, end] * weight
                        seen = np.nonzero(post)[0]
                        total += np.bincount(ids[seen, end, k] * n_langs + lang[seen], post[seen], total.size)
        return total.reshape(-1, n_langs)[:-2]


@dataclass
class LanguageModel:
    """Piece probabilities of each language: what its training words held, and the same share for every other piece."""

    langs: list[str]
    vocab: dict[str, int]
    pieces: list[np.ndarray]  #: of each language
    probs: list[np.ndarray]  #: of these pieces
    other: np.ndarray  #: of any other piece
    prior: np.ndarray  #: log share of the training documents
    block: int = LANG_BLOCK  #: languages taken at a time

    def dense(self, lo: int, hi: int) -> np.ndarray:
        """Vocabulary x languages lo to hi."""
        out = np.tile(self.other[lo:hi], (len(self.vocab), 1))
        for k in range(lo, hi):
            out[self.pieces[k], k - lo] = self.probs[k]
        return out

    def blocks(self) -> list[tuple[int, int]]:
        return [(lo, min(lo + self.block, len(self.langs))) for lo in range(0, len(self.langs), self.block)]

    def predictor(self):
        """Scores texts; languages are taken in blocks, and with one block words keep their sums."""
        langs, blocks = self.langs, self.blocks()
        table = PieceTable(self.vocab, len(self.vocab) + 1)
        only = _WordSums(Segmenter(self.vocab, self.dense(*blocks[0]), table)) if len(blocks) == 1 else None

        def predict(texts: list[str | None]) -> list[tuple[str, float]]:
            counted = [Counter(words_of(t)) for t in texts]
            words = list(dict.fromkeys(w for c in counted for w in c))
            scores = np.tile(self.prior, (len(counted), 1))
            for lo, hi in blocks:
                sums = only or _WordSums(Segmenter(self.vocab, self.dense(lo, hi), table))
                known = sums.learn(words)
                for i, c in enumerate(counted):
                    rows = np.fromiter(map(sums.place.__getitem__, c), np.int64, len(c))
                    scores[i, lo:hi] += np.fromiter(c.values(), float, len(c)) @ known[rows]
            out = []
            for c, score in zip(counted, scores, strict=True):
                if not langs or not any(ch.isalpha() for w in c for ch in w):
                    out.append((UNDETERMINED, 0.0))
                    continue
                post = np.exp(score - score.max())
                best = int(post.argmax())
                out.append((langs[best], float(post[best] / post.sum())))
            return out

        return predict


class _WordSums:
    """Log probabilities of words, kept until they take too much room."""

    def __init__(self, segmenter: Segmenter):
        self.segmenter, self.place = segmenter, {}
        self.known = np.zeros((0, segmenter.probs.shape[1]))

    def learn(self, words: list[str]) -> np.ndarray:
        fresh = [w for w in words if w not in self.place]
        if len(self.place) + len(fresh) > _CACHE:
            self.place.clear()
            fresh = words
        at, need = len(self.place), len(self.place) + len(fresh)
        if need > len(self.known):
            grown = np.zeros((min(max(need, 2 * len(self.known), 4096), max(need, _CACHE)), self.known.shape[1]))
            grown[:at] = self.known[:at]
            self.known = grown
        self.known[at:need] = self.segmenter.forward(fresh)
        self.place.update(zip(fresh, range(at, need), strict=True))
        return self.known


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen: Counter = Counter()
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            seen.update((lang, w) for w in words_of(text))
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen]), pa.array(list(seen.values()))],
                names=["lang", "word", "n"])


def _expectation(shared):
    """Expected pieces of the counted words, by language; a task takes its languages block by block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageModel = shared.value
        number = {x: i for i, x in enumerate(model.langs)}
        table = PieceTable(model.vocab, len(model.vocab) + 1)
        at, seg, total = -1, None, None

        def sums() -> pa.RecordBatch:
            piece, lang = np.nonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array((lang + at * model.block).astype(np.int32)),
                                               pa.array(total[piece, lang])], names=["piece", "lang", "n"])

        for b in batches:
            words, n = np.array(b.column("word").to_pylist(), object), b.column("n").to_numpy().astype(float)
            lang = np.array([number[x] for x in b.column("lang").to_pylist()])
            for block in np.unique(lang // model.block):
                if block != at:
                    if seg is not None:
                        yield sums()
                    at, lo, hi = int(block), *model.blocks()[block]
                    dense = model.dense(lo, hi)
                    seg, total = Segmenter(model.vocab, dense, table), np.zeros_like(dense)
                mine = lang // model.block == block
                total += seg.expected(words[mine].tolist(), n[mine], lang[mine] - at * model.block)
        if seg is not None:
            yield sums()
    return run


def train(docs: DataFrame, docs_per_lang: int = 600, rounds: int = 3, smoothing: float = 0.02,
          vocab_path: str | None = None, lang_block: int = LANG_BLOCK) -> LanguageModel:
    """Fit piece probabilities on text and lang of `docs` (columns doc_id, text, lang).

    The bounded sample: about `docs_per_lang` documents of each language, those
    whose hash of id and text falls under the language's share; whole texts are
    used.  There may be any number of languages: what reaches the driver, and
    each worker, is one number for each language and piece that its sample holds.
    """
    vocab = vocabulary(vocab_path)
    spark = docs.sparkSession
    small_batches(spark)
    labelled = docs.filter("lang is not null and text is not null")
    per_lang = cut(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")))
    found = per_lang.orderBy("lang").collect()
    langs, size = [r["lang"] for r in found], np.array([r["docs"] for r in found], float)
    # every piece is as likely as another at first
    model = LanguageModel(langs, vocab, [np.zeros(0, np.int32)] * len(langs), [np.zeros(0)] * len(langs),
                          np.full(len(langs), 1 / max(len(vocab), 1)), np.log(size / size.sum()) if langs else size, lang_block)
    if not langs:
        return model
    # a row a language, all of which the model holds as well; a join by language would move the texts
    sample = labelled.join(F.broadcast(per_lang.withColumnRenamed("lang", "of")), F.col("lang") == F.col("of")).filter(
        sampled(docs_per_lang, F.col("docs"), F.lit("langid"), F.col("doc_id"), F.col("text"))).select("lang", "text")
    counts = (sample.mapInArrow(_word_counts, "lang string, word string, n long")
              .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    if len(langs) > lang_block:
        counts = counts.repartitionByRange("lang").sortWithinPartitions("lang")
    counts = cut(counts)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        sums = (counts.mapInArrow(_expectation(shared), "piece int, lang int, n double")
                .groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas().sort_values(["lang", "piece"]))
        lang, piece, n = sums["lang"].to_numpy(), sums["piece"].to_numpy(), sums["n"].to_numpy()
        edges = np.searchsorted(lang, np.arange(len(langs) + 1))
        total = np.add.reduceat(np.append(n, 0.0), edges[:-1]) * (np.diff(edges) > 0) + smoothing * len(vocab)
        parts = [slice(lo, hi) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
        model = LanguageModel(langs, vocab, [piece[p] for p in parts], [(n[p] + smoothing) / t for p, t in zip(parts, total, strict=True)],
                              smoothing / total, model.prior, lang_block)
    return model


def _predicted(docs: DataFrame, model: LanguageModel, text_col: str) -> DataFrame:
    """`docs` with __li, a struct of lang and score."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        run = shared.value.predictor()
        for texts in parts:
            yield pd.DataFrame(run([t if isinstance(t, str) else None for t in texts]), columns=["lang", "score"])

    return with_columns(docs, __li=predict(F.col(f"`{text_col}`")))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred and score, the posterior of the language predicted.

    Whole texts count; digits, punctuation and marks carry no evidence.  Null
    texts and texts without a letter: `und`, score 0; so is all without a trained
    language.  Columns called lang_pred or score are replaced; repeated rows and
    ties (first language by name) get equal results.
    """
    out = _predicted(docs, model, text_col)
    return with_columns(out, lang_pred=F.col("__li.lang"), score=F.col("__li.score")).drop("__li")


def training_part(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang of the documents that are not held out."""
    return docs.filter(fold(F.col("doc_id"), 5) != 0).select("doc_id", "text", "lang")


def predict_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document; a null id isn't held out."""
    model = train(training_part(docs))
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The rows whose language is determined with at least `min_score`."""
    out = _predicted(docs, train(training_part(docs)), "text")
    found = out.filter((F.col("__li.lang") != UNDETERMINED) & (F.col("__li.score") >= min_score))
    return found.drop("__li")
