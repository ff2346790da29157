import random
import zlib
from collections import defaultdict

import numpy as np

from symloom.llm import bpe, packing


def check(rows, texts, size):
    """Every id in one piece, gapless sequences, little padding."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        ids, at = t.encode(texts[d] or "", add_special_tokens=False).ids + [0], 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return sum(r.length for r in rows) / (size * len(by_seq))


def test_patterns_hold_everything():
    rng = random.Random(3)
    for top, n in ((5, 40), (40, 1000), (128, 20000), (127, 7), (128, 3_000_00)):
        hist = defaultdict(int)
        for _ in range(n):
            hist[rng.randint(1, top)] += 1
        used = packing.patterns(hist, 128)
        held = defaultdict(int)
        for p, times in used:
            assert sum(k * a for k, a in p.items()) <= 128
            for k, a in p.items():
                held[k] += a * times
        assert held == hist
        bound = -(-sum(k * n for k, n in hist.items()) // 128)
        assert sum(t for _, t in used) <= bound * 1.01 + 2


def test_patterns_where_greedy_fails():
    used = packing.patterns({600: 10, 424: 10, 300: 7, 341: 21}, 1024)
    assert sum(t for _, t in used) == 10 + 7 + 3


def test_knapsack():
    value, counts = packing._knapsack(np.array([3, 5, 7]), np.array([3.0, 5.5, 7.0]), 11)
    assert value == 11.5 and list(counts) == [2, 1, 0]


def test_edges(spark):
    texts = {1: "", 2: None, 3: "word " * 3000, 4: "a b c", 5: "a b c", -1: "é\n\n x"}
    docs = spark.createDataFrame([(d, t, 5) for d, t in texts.items()], "doc_id long, text string, length int")
    check(packing.pack(docs, bpe.default_path()).collect(), texts, 1024)
    assert packing.pack(docs.limit(0), bpe.default_path()).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check(packing.op7_packing(spark, sf).collect(), texts, 1024) > 0.95
