import functools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from symloom.llm import bpe, common, token_store


@functools.cache
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


ODD = ["a  b\n c", "  lead", " \ndef x", "x \n\n  y ", "don't I'll 're", "tab\tx  \t y", "日本 語 a", "a  b", "<|endoftext|> hi", "x\x1c y", "''s 's", "100 20a", "... ,,", "a ", "", "\r\n a", "ª º µ", "word," * 3 + " word,"]


def test_encoder_equals_library():
    t, code = whole(), bpe.encoder(bpe.default_path())
    for text in ODD + [" ".join(ODD)]:
        assert list(np.frombuffer(code.ids(text), "<u4")) == t.encode(text, add_special_tokens=False).ids, text


def test_encoder_forgets():
    t, code = whole(), bpe.Encoder(bpe.default_path(), pieces=8)
    texts = ["one two three, four five. six seven one two", " ".join(map(str, range(500))), "日本 1 語 2 " * 30 + " ".join(f"語{i}" for i in range(300)), "x" * 5000]
    for text in texts * 2:
        assert list(np.frombuffer(code.ids(text), "<u4")) == t.encode(text, add_special_tokens=False).ids
        assert all(len(m) <= 8 and len(m.older) <= 8 for m in (code.words, code.parts))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab'stZé \n\t\r.,1ªµ語\x1c\u00a0\u2003-<|>"), max_size=30))
def test_encoder_on_any_text(text):
    assert list(np.frombuffer(bpe.encoder(bpe.default_path()).ids(text), "<u4")) == whole().encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("chunk", [1, 40, 1 << 20])
def test_column_equals_library(monkeypatch, chunk):
    """Odd texts between plain ones, nulls and a slice, in chunks of one text and more."""
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    texts = [None, *ODD, *(f"the plain, words. {o}" for o in ODD), "", None, "été, ** the!! (end) straße. x,, y", "end ", "end\n", " ", " lead", "語。 語 a"]
    code = bpe.Encoder(bpe.default_path(), pieces=8)
    for kind in (pa.string(), pa.large_string()):
        got = [list(np.frombuffer(b, "<u4")) for b in code.many(pa.array(["cut off", *texts], kind).slice(1))]
        assert got == [whole().encode(x or "", add_special_tokens=False).ids for x in texts]
    assert list(code.many(pa.array([], pa.string()))) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from("ab'stZé \n\t\r.,1ªµ語\x1c\u00a0\u2003-<|>"), max_size=30), max_size=6))
def test_column_of_any_texts(texts):
    got = [list(np.frombuffer(b, "<u4")) for b in bpe.encoder(bpe.default_path()).many(pa.array(texts, pa.string()))]
    assert got == [whole().encode(x or "", add_special_tokens=False).ids for x in texts]


def test_store_looks_up_a_word_once_a_chunk(monkeypatch):
    """2000 texts of the same words: the encoder of a store asks its memory for each word once, not 2000 times."""
    from pyspark import TaskContext

    asked = []

    class Counted(bpe.Memory):
        def get(self, piece, *rest):
            asked.append(piece)
            return super().get(piece, *rest)

        def __getitem__(self, piece):
            asked.append(piece)
            return super().__getitem__(piece)

    code = bpe.Encoder(bpe.default_path())
    code.words = Counted(code._word, 1000)
    monkeypatch.setattr(bpe, "encoder", lambda path: code)
    monkeypatch.setattr(TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})()))
    text = "first the same words, each time. the same 12 words"
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array([text] * 2000)], ["doc_id", "text"])
    (out,) = list(token_store._segments("", 2, 1 << 18)(iter([batch])))
    seg = token_store.Segment(out.column("payload")[0].as_py())
    assert list(seg.document(1999)) == whole().encode(text, add_special_tokens=False).ids + [2]
    assert len(asked) < 50


@pytest.mark.parametrize("ids", [[], [0], [7] * 2000, list(range(0, 50257, 7)), [2**32 - 1, 0, 5], [1] * 511 + [70000] * 3])
def test_segment_round_trip(ids):
    a = np.array(ids, "u4")
    cut = len(ids) // 3
    seg = token_store.Segment(token_store.encode_segment([5, None], [cut, len(ids) - cut], a))
    assert list(seg.document(0)) == ids[:cut] and list(seg.document(1)) == ids[cut:]
    assert list(seg.null) == [False, True]
    for i in {0, 1, cut, len(ids) // 2, len(ids) - 1, 511, 512, 513} & set(range(len(ids))):
        assert seg[i] == ids[i]


def test_store(spark, tmp_path):
    rows = [(3, "b c d", "x"), (1, None, "y"), (None, "z", "z"), (2, "", "w"), (9, "long " * 5000, "w"), (3, "b c d", "x"), (-4, "é", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    path = str(tmp_path / "store")
    token_store.write_store(docs, path, bpe.default_path(), segment_tokens=10)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.digest(spark, path).collect()))
    t, at, want, flat = whole(), 0, [], []
    for d, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):  # the two rows of id 3 are equal
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((at, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
        flat += ids
    assert got == want
    ask = [0, 3, len(flat) - 1, len(flat), 1000]
    assert dict(map(tuple, token_store.read_tokens(spark, path, ask).collect())) == {p: flat[p] for p in ask if p < len(flat)}


@pytest.mark.parametrize("width", [1, 3, 7, 8, 9, 13, 16, 17, 31, 32])
def test_packed_chunks(width):
    values = np.random.default_rng(width).integers(0, 1 << width, 203, dtype="u8").astype("u4")
    raw = memoryview(token_store._pack(values, width))
    assert len(raw) == (203 * width + 7) // 8
    assert int.from_bytes(raw, "little") == sum(int(v) << (i * width) for i, v in enumerate(values))
    for a, b in ((0, 203), (5, 5), (9, 10), (7, 100), (202, 203)):
        assert (token_store._unpack(raw, a, b, width) == values[a:b]).all()


def test_one_id_in_many_parts(spark, tmp_path):
    """Two thirds of the rows have one id, half of these equal texts: no range holds them all, and positions stay gapless."""
    rows = [(7, "same text" if k % 2 else f"text {k}") for k in range(400)] + [(k, "z") for k in range(8, 208)]
    path = str(tmp_path / "store")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    token_store.write_store(docs, path, bpe.default_path(), segment_tokens=50)
    assert max(r["count"] for r in spark.read.parquet(f"{path}/segments").groupBy("part").count().collect()) > 1
    assert spark.read.parquet(f"{path}/segments").groupBy("part").agg({"n_docs": "sum"}).agg({"sum(n_docs)": "max"}).first()[0] < 300
    got = sorted((r.start, r.n_tokens, r.doc_id) for r in token_store.digest(spark, path).collect())
    assert len(got) == 600 and [r[2] for r in got] == sorted(r[0] for r in rows)
    assert all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:]))


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    token_store.write_store(docs, str(tmp_path / "s"), bpe.default_path())
    assert token_store.digest(spark, str(tmp_path / "s")).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.op1_token_store(spark, sf).collect()}
    t, at = whole(), 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [2]
        assert got[r.doc_id] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert common.scratch(spark, "x").endswith("/x")
