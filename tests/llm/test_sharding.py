import random
import zlib
from collections import defaultdict

from symloom.llm import sharding as S


def check(rows, out, shards, near=0.02):
    """The law of sizes, gapless slots, equal texts together; returns sizes by shard."""
    want = sorted(((d is not None, d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted(((r.doc_id is not None, r.doc_id), r.size, r.text_crc32) for r in out) == want
    slots, size, where = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in out:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
        where[r.size, r.text_crc32].add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return size, where


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 3) for d, t in rows], "doc_id long, text string, shard int")


def test_groups_and_law(spark):
    rng = random.Random(6)
    rows = [(i, "x" * rng.randint(0, 9000)) for i in range(1500)]
    rows += [(5000 + i, "hot " * 40) for i in range(900)] + [(7000 + i, "pair%d" % (i // 2)) for i in range(60)]
    size, where = check(rows, S.assign(frame(spark, rows), 8).collect(), 8)
    mean = sum(size.values()) / 8
    assert len(size) == 8 and max(size.values()) <= mean * 1.005 and min(size.values()) >= mean * 0.98
    assert all(len(v) == 1 for v in where.values())


def test_group_larger_than_a_shard(spark):
    rows = [(i, "same text") for i in range(1000)] + [(2000 + i, "t%d" % i) for i in range(300)]
    size, _ = check(rows, S.assign(frame(spark, rows), 8).collect(), 8)
    mean = sum(size.values()) / 8
    assert max(size.values()) <= mean * 1.02


def test_edges(spark):
    rows = [(None, None), (1, None), (1, ""), (2, "é"), (2, "é"), (3, "long" * 50000)]
    _, where = check(rows, S.assign(frame(spark, rows)).collect(), 40)
    assert S.assign(frame(spark, rows).limit(0)).count() == 0


def test_best_fit_takes_the_tightest():
    assert S.best_fit([(7, 1), (5, 1), (4, 1), (3, 1), (1, 1)], 2, 10) == [[(0, 1)], [(1, 1)], [(1, 1)], [(0, 1)], [(1, 1)]]
    assert S.best_fit([(6, 3)], 2, 10) is None
    one = [(s, 1) for s in sorted((random.Random(2).randint(1, 50) for _ in range(200)), reverse=True)]
    assert max(b for put in S.least_capacity(one, 5) for b, _ in put) == 4


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, S.op4_sharding(spark, sf).collect(), 40)
