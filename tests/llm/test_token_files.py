"""Simple-8b round trips, files of ids against the tokenizer itself."""

import os
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowlens.llm import token_files as T
from flowlens.llm.simple8b import BLOCK, pack, unpack

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=400))
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    words, per_block = pack(v)
    assert per_block.sum() == len(words) and len(per_block) == -(-len(v) // BLOCK)
    assert unpack(words, per_block, len(v)).tolist() == values


@pytest.mark.parametrize("top", [0, 1, 50_256, 2**30 - 1, 2**30, 2**59, 2**60 - 1, 2**60, 2**64 - 1])
@pytest.mark.parametrize("n", [1, BLOCK - 1, BLOCK, BLOCK + 1, 10 * BLOCK])
def test_simple8b_widths(n, top):
    v = np.zeros(n, np.uint64)
    v[::3] = top
    words, per_block = pack(v)
    assert (unpack(words, per_block, n) == v).all()


def test_words_hold_as_many_as_fit():
    words, per_block = pack(np.ones(BLOCK, np.uint64))
    assert per_block.tolist() == [3]  # 60, 60 and 8
    assert pack(np.full(BLOCK, 32_767, np.uint64))[1].tolist() == [BLOCK // 4]
    assert pack(np.full(3, 2**60, np.uint64))[1].tolist() == [6]  # two words for an escape


def test_any_block_decodes_alone():
    v = np.random.default_rng(0).integers(0, 2**40, 5 * BLOCK).astype(np.uint64)
    words, per_block = pack(v)
    at = np.concatenate([[0], np.cumsum(per_block)])
    for k in range(5):
        part = unpack(words[at[k]:at[k + 1]], per_block[k:k + 1], BLOCK)
        assert (part == v[k * BLOCK:(k + 1) * BLOCK]).all()


def expected(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    ids = {text: [*t.encode(text or "", add_special_tokens=False).ids, 2] for _, text in docs}
    return ids


def check(spark, docs, out):
    """Rows against the tokenizer: starts follow each other in id order, whatever the order of equal ids."""
    ids = expected(docs)
    rows = sorted(out.collect(), key=lambda r: r["start"])
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows]])[:-1].tolist()
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in rows]
    assert order == sorted(order)
    want = sorted((repr(i), len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for i, t in docs)
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in rows) == want


def test_documents_round_trip(spark):
    docs = [(5, "Hello world"), (1, "naïve café <|endoftext|> 日本"), (1, "naïve café <|endoftext|> 日本"), (None, "null id"), (2, None),
            (3, ""), (1, "same id, other text"), (-4, " \n\t two  spaces  "), (9, "x" * 5000), (7, "word another " * 3000)]
    frame = spark.createDataFrame([(*d, 0, "a", 1) for d in docs], DOCS + ", start long, `h` string, `row` int").repartition(4)
    out = T.encode_documents(frame, PATH)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    check(spark, docs, out)


def test_small_files_and_chunks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(T, "CHUNK_IDS", BLOCK)
    docs = [(i, f"document {i} " * (i % 50)) for i in range(300)]
    folder = T.write_ids(spark.createDataFrame(docs, DOCS), PATH, folder=str(tmp_path / "ids"), file_ids=500)
    files = spark.read.parquet(f"{folder}/manifest").collect()
    assert len(files) > 8 and sum(f["n_docs"] for f in files) == 300
    assert not [f for f in os.listdir(tmp_path / "ids") if f.startswith(".part")]
    back = T.read_ids(spark, folder)
    from pyspark.sql import functions as F
    check(spark, docs, back.withColumn("ids_crc32", F.crc32("ids")))


def test_a_second_attempt_changes_nothing(tmp_path):
    for _ in range(2):
        w = T.IdFileWriter(f"file://{tmp_path}", "a.ids")
        w.add(7, np.arange(1000, dtype=np.uint64))
        w.add(None, np.zeros(0, np.uint64))
        w.close()
    assert [f.base_name for f in pafs.LocalFileSystem().get_file_info(pafs.FileSelector(str(tmp_path)))] == ["a.ids"]
    f = T.IdFile(f"file://{tmp_path}", "a.ids")
    assert (f.n_docs, f.n_ids, f.null.tolist()) == (2, 1000, [False, True])
    assert f.values(300, 411).tolist() == list(range(300, 411))
    assert list(f.documents()) == [(0, 2)]


def test_damaged_file_is_refused(tmp_path):
    (tmp_path / "b.ids").write_bytes(b"0" * 100)
    with pytest.raises(ValueError):
        T.IdFile(f"file://{tmp_path}", "b.ids")


ODD = ("It's a test, isn't it?  Two  spaces\n\nand 12 numbers; naïve  café x\u00a0y \u00a0z 'tis o'clock 'S'ok\t tab  "
       "日本 語, ÀÉß÷×ÿ ... (a)[b] $5.00 #tag @me ~x` end. <|endoftext|> \x1c a\x85b \u2003 c ")


def test_long_texts_in_slices_encode_alike():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    text = ODD * 200
    parts = list(T.slices(text, 100))
    assert len(parts) > 20 and "".join(parts) == text
    whole = t.encode(text, add_special_tokens=False).ids
    assert sum((t.encode(p, add_special_tokens=False).ids for p in parts), []) == whole
    assert T.Encoder(PATH).encode([text])[0].tolist() == whole
    assert list(T.slices("-" * 500, 100)) == ["-" * 500]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from([*" \n\t'.,;sStTlLrevdm", "é", "à", "÷", "日", "\u00a0", "\0", "1", "²", "\u2003"]), max_size=40), max_size=5))
def test_pieces_encode_as_whole_texts(texts):
    t = T._encoder(PATH)
    whole = [t.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    assert [x.tolist() for x in t.encode(texts)] == whole
    assert [x.tolist() for x in t.encode(texts[::-1])] == whole[::-1]


def test_pieces_are_forgotten_and_learnt_again(monkeypatch):
    t = T.Encoder(PATH)
    monkeypatch.setattr(T, "KEPT_IDS", 50)
    for k in range(30):
        texts = [f"{ODD} number {k}", f"word{k} " * k]
        assert [x.tolist() for x in t.encode(texts)] == [t.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


def test_other_tokenizers_get_whole_texts():
    t = T.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not t.by_piece
    assert [x.tolist() for x in t.encode(["Some text, here", ""])] == [t.tokenizer.encode(x, add_special_tokens=False).ids
                                                                        for x in ("Some text, here", "")]


def test_empty_table(spark):
    assert T.encode_documents(spark.createDataFrame([], DOCS), PATH).collect() == []
