"""Token ids of documents as binary files of Simple-8b words, written and read by Spark tasks.

Documents are range-sorted by id; a task tokenizes its range and streams the ids
of one document after the other into files of bounded size.  A file is

    magic | words | word offset of each block | first id of each document | document ids | null flags | footer

in little-endian 64-bit numbers (null flags: bytes), the footer being document, id
and word counts and the magic.  Blocks run on across documents, so any document is
decoded from the blocks that hold it.  Files are put in place whole, under names and
with contents that any attempt of a task repeats; a manifest table names them.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.common import running_total, shuffle_partitions, small_batches
from flowlens.llm.simple8b import BLOCK, pack, unpack
from flowlens.session import ensure_checkpoint_dir

#: The format's name, and the numbers of its footer.
MAGIC = b"IDS-S8B1"
FOOTER = 4 * 8
#: Ids after which a task begins another file; ids decoded at a time.
FILE_IDS = 1 << 25
CHUNK_IDS = 1 << 20
#: Characters tokenized at a time; ids of pieces that a worker keeps.
CHUNK_CHARS = 1 << 20
KEPT_IDS = 1 << 23
#: Documents end with this id.
END_ID = 2
MANIFEST = "part int, seq int, file string, n_docs long, n_ids long"


#: A space at which a byte-level tokenizer starts a new piece, whatever stands around it: single, between other characters.
_CUT = re.compile(r" (?=\S)(?<=\S )")


def slices(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """A long text in slices that start at such a space."""
    lo = 0
    while len(text) - lo > size and (m := _CUT.search(text, lo + size)):
        yield text[lo:m.start()]
        lo = m.start()
    yield text[lo:] if lo else text


#: ASCII marks that a byte-level tokenizer keeps apart from letters, and merges with each other;
#: the apostrophe is none, as it may go with letters after it.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: A piece that is a word of plain letters and marks after it.
_WORD = re.compile(rf"([A-Za-zÀ-ÖØ-öø-ÿ]+)([{re.escape(_MARKS)}]*)")
#: Byte-level names of bytes: Latin-1 for its printable characters, code points from 256 on for the others, in order.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_NAMES = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_SPACE = chr(_BYTE_NAMES[0x20])


#: Marks the key of a text's first piece; all others stand after their space, and start with no white space.
_FIRST = "\n"


def _text(key: str) -> str:
    return key[1:] if key[0] == _FIRST else " " + key


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """`a`, or a copy with room for n and more."""
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[:len(a)] = a
    return out


class _Numbers(dict):
    """A number for each piece of text; new ones are noted."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


class Encoder:
    """Ids of texts by a tokenizer file.

    A byte-level tokenizer never merges over the spaces of ``_CUT``, so each piece
    between two of them has the same ids wherever it stands: pieces are encoded
    once and kept, up to ``KEPT_IDS``.  Other tokenizers get whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # what looks like a special token in a text is text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        self.by_piece = (split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
                         and not spec.get("normalizer") and all(t["special"] for t in spec.get("added_tokens") or []))
        self.model = self.tokenizer.model
        self._marks = lru_cache(maxsize=4096)(self._merged)
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        #: ids of piece n: flat[start[n]:start[n + 1]]; both arrays have room to grow
        self.start, self.flat, self.n_flat = np.zeros(1 << 10, np.int64), np.zeros(1 << 12, np.uint32), 0

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, text: str) -> list[int]:
        """Ids of what a byte-level tokenizer merges by itself, from its model."""
        return [t.id for t in self.model.tokenize(text)]

    def _word(self, word: str) -> list[int]:
        """Ids of a space and a word."""
        return self._merged(_SPACE + (word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_NAMES)))

    def _learn(self) -> None:
        """Encode the pieces that are new: a word with its punctuation as these two, others by the tokenizer."""
        new, self.numbers.new = self.numbers.new, []
        ids: list[list[int]] = []
        others: list[int] = []
        for i, key in enumerate(new):
            m = _WORD.fullmatch(key)
            if m:
                word, marks = m.groups()
                ids.append(self._word(word) + self._marks(marks) if marks else self._word(word))
            else:
                others.append(i)
                ids.append([])
        for i, found in zip(others, self._whole([_text(new[i]) for i in others]), strict=True):
            ids[i] = found
        upto = self.n_flat + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        last = int(upto[-1])
        self.start = _room(self.start, len(self.numbers) + 1)
        self.start[len(self.numbers) + 1 - len(new):len(self.numbers) + 1] = upto
        self.flat = _room(self.flat, last)
        self.flat[self.n_flat:last] = np.fromiter(chain.from_iterable(ids), np.uint32, last - self.n_flat)
        self.n_flat = last

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the texts together are of bounded size."""
        if not self.by_piece:
            return [np.array(ids, np.uint64) for ids in self._whole(texts)]
        if self.n_flat > KEPT_IDS:
            self._forget()
        numbers, counts = [], []
        for text in texts:
            pieces = _CUT.split(text)
            pieces[0] = _FIRST + pieces[0]
            numbers.append(np.fromiter(map(self.numbers.__getitem__, pieces), np.int64, len(pieces)))
            counts.append(len(pieces))
        if self.numbers.new:
            self._learn()
        number = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        lens = self.start[number + 1] - self.start[number]
        ends = np.cumsum(lens)
        at = np.arange(int(lens.sum())) + np.repeat(self.start[number] - ends + lens, lens)
        upto = np.concatenate([[0], ends])[np.cumsum([0, *counts])]
        ids = self.flat[at].astype(np.uint64)
        return [ids[lo:hi] for lo, hi in zip(upto[:-1], upto[1:], strict=True)]

    def encode_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, a few texts, or a slice of one, at a time."""
        group: list[str] = []
        held = 0
        for text in texts:
            text = text or ""
            if group and held + len(text) > CHUNK_CHARS:
                yield from self.encode(group)
                group, held = [], 0
            if self.by_piece and len(text) > CHUNK_CHARS:
                yield np.concatenate([self.encode([part])[0] for part in slices(text)])
                continue
            group.append(text)
            held += len(text)
        yield from self.encode(group)


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """A worker's encoder; its pieces serve all its tasks."""
    return Encoder(path)


class IdFileWriter:
    """One file of ids: documents in, words out as blocks fill up."""

    def __init__(self, folder: str, name: str):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.path, self.temp = f"{root}/{name}", f"{root}/.{name}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp)
        self.out.write(MAGIC)
        self.rest: list[np.ndarray] = []
        self.held = self.n_ids = self.n_words = 0
        self.block_words: list[np.ndarray] = []
        self.starts: list[int] = []
        self.ids: list[int | None] = []

    def add(self, doc_id: int | None, values: np.ndarray) -> None:
        self.starts.append(self.n_ids)
        self.ids.append(doc_id)
        self.rest.append(values)
        self.n_ids += len(values)
        self.held += len(values)
        if self.held >= CHUNK_IDS:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        values = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint64)
        words, per_block = pack(values[:n])
        self.out.write(words.astype("<u8").tobytes())
        self.block_words.append(per_block)
        self.n_words += len(words)
        self.rest, self.held = [values[n:]], len(values) - n

    def close(self) -> None:
        """Finish the file and put it in place, unless another attempt has done so."""
        self._flush(self.held)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(self.block_words))]).astype("<i8")
        self.out.write(offsets.tobytes())
        self.out.write(np.array([*self.starts, self.n_ids], "<i8").tobytes())
        self.out.write(np.array([i or 0 for i in self.ids], "<i8").tobytes())
        self.out.write(np.array([i is None for i in self.ids], np.uint8).tobytes())
        self.out.write(np.array([len(self.ids), self.n_ids, self.n_words], "<i8").tobytes() + MAGIC)
        self.out.close()
        try:
            self.fs.move(self.temp, self.path)
        except OSError:
            if self.fs.get_file_info(self.path).type != pafs.FileType.File:
                raise
            self.fs.delete_file(self.temp)


class IdFile:
    """Reads a file of ids: its documents, and the ids of any range."""

    def __init__(self, folder: str, name: str):
        fs, root = pafs.FileSystem.from_uri(folder)
        self.src = fs.open_input_file(f"{root}/{name}")
        size = self.src.size()
        foot = self._read(size - FOOTER, FOOTER)
        if self._read(0, len(MAGIC)) != MAGIC or foot[-len(MAGIC):] != MAGIC:
            raise ValueError(f"{name} is no file of ids")
        self.n_docs, self.n_ids, self.n_words = map(int, np.frombuffer(foot[:-len(MAGIC)], "<i8"))
        blocks = -(-self.n_ids // BLOCK)
        at = len(MAGIC) + 8 * self.n_words
        tail = self._read(at, size - FOOTER - at)
        longs = np.frombuffer(tail, "<i8", blocks + 1 + 2 * self.n_docs + 1)
        self.offsets, self.starts, self.doc_ids = np.split(longs, [blocks + 1, blocks + self.n_docs + 2])
        self.null = np.frombuffer(tail, np.uint8, self.n_docs, 8 * len(longs)).astype(bool)

    def _read(self, at: int, n: int) -> bytes:
        self.src.seek(at)
        return self.src.read(n)

    def values(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi: the blocks that hold them are read and decoded."""
        if lo >= hi:
            return np.zeros(0, np.uint64)
        a, b = lo // BLOCK, -(-hi // BLOCK)
        offsets = self.offsets[a:b + 1]
        words = np.frombuffer(self._read(len(MAGIC) + 8 * int(offsets[0]), 8 * int(offsets[-1] - offsets[0])), "<u8")
        n = min(b * BLOCK, self.n_ids) - a * BLOCK
        return unpack(words, np.diff(offsets), n)[lo - a * BLOCK:hi - a * BLOCK]

    def documents(self) -> Iterator[tuple[int, int]]:
        """Runs of documents [i, j) of some CHUNK_IDS ids, or of one document."""
        i = 0
        while i < self.n_docs:
            j = int(np.searchsorted(self.starts, self.starts[i] + CHUNK_IDS, "right")) - 1
            j = min(max(j, i + 1), self.n_docs)
            yield i, j
            i = j

    def close(self) -> None:
        self.src.close()


def _write_part(folder: str, tokenizer: str, end_id: int, file_ids: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows: list[tuple] = []
        out: IdFileWriter | None = None

        def close() -> None:
            out.close()
            rows.append((part, len(rows), os.path.basename(out.path), len(out.ids), out.n_ids))

        for b in batches:
            texts = b.column("text").to_pylist()
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), _encoder(tokenizer).encode_all(texts), strict=True):
                if out is None:
                    out = IdFileWriter(folder, f"part-{part:06d}-{len(rows):05d}.ids")
                out.add(doc_id, np.append(ids, np.uint64(end_id)))
                if out.n_ids >= file_ids:
                    close()
                    out = None
        if out is not None:
            close()
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True),
                                                (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                names=["part", "seq", "file", "n_docs", "n_ids"])
    return run


def _uri(folder: str) -> str:
    if folder.startswith("file:") and not folder.startswith("file://"):
        return f"file://{folder[5:]}"
    return folder if "://" in folder else f"file://{os.path.abspath(folder)}"


def write_ids(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID,
              file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Tokenize all of `docs` into files of ids in `folder` (a new one in the shared
    checkpoint folder by default) and return it.

    Files follow each other in ascending document id; null ids come first, rows of
    one id go by their text's hash, and equal rows in any order, which changes
    nothing.  A null or empty text is its end id alone.  A long text is tokenized in
    slices cut where a byte-level tokenizer splits it anyhow.  A task holds a batch of texts
    and the tables of one file, so a hot id, or a third of all rows alike, only
    takes a range of its own.  An empty table gives an empty manifest.  Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = _uri(folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}")
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = (rows.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
            .repartitionByRange(shuffle_partitions(spark), "doc_id", "h", "row")
            .sortWithinPartitions("doc_id", "h").select("doc_id", "text"))
    manifest = rows.mapInArrow(_write_part(folder, tokenizer, end_id, file_ids), MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return folder


def _read_files(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist(), strict=True):
                f = IdFile(folder, name)
                for i, j in f.documents():
                    lo = int(f.starts[i])
                    ids = f.values(lo, int(f.starts[j])).astype("<u4")
                    edges = f.starts[i:j + 1] - lo
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(f.doc_ids[i:j], pa.int64(), mask=f.null[i:j]), pa.array(f.starts[i:j] + base, pa.int64()),
                         pa.array(np.diff(edges), pa.int64()),
                         pa.array([ids[s:e].tobytes() for s, e in zip(edges[:-1], edges[1:], strict=True)], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"])
                f.close()
    return run


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian
    unsigned 32-bit) of every document in the files that the folder's manifest names."""
    files = spark.read.parquet(f"{folder}/manifest")
    n = files.count()
    files = running_total(files, [F.col("part"), F.col("seq")], F.col("n_ids"), "upto")
    files = files.select("file", (F.col("upto") - F.col("n_ids")).alias("base"))
    files = files.repartition(max(1, min(n, 4 * shuffle_partitions(spark))))
    return files.mapInArrow(_read_files(folder), "doc_id long, start long, n_tokens long, ids binary")


def encode_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files written for them."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    back = read_ids(docs.sparkSession, write_ids(docs, tokenizer))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
