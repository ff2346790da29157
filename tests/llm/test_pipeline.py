import random

import corpus_pipeline as P
from symloom.llm import minhash_dedup, mixing, secrets


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols = docs.columns
    good = P.keep_quality(spark, docs, sf).cache()
    assert good.columns == cols
    once = P.drop_near_duplicates(spark, good, sf).cache()
    kept = {r.doc_id for r in minhash_dedup.near_duplicates(good).where("kept").collect()}
    assert once.columns == cols and {r.doc_id for r in once.collect()} == kept
    clean = P.redact_secrets(spark, once, sf).cache()
    assert clean.columns == cols and clean.count() == once.count()
    assert secrets.scan(clean).where("n_hex > 0 or n_access > 0").count() == 0
    mixed = P.mix_sources(spark, clean, sf)
    assert mixed.columns == cols and {r.doc_id for r in mixed.collect()} == {r.doc_id for r in mixing.weigh(clean).where("drawn").collect()}


def test_run_and_edges(spark):
    out = P.run(spark, "/root/testdata/sf0.001")
    assert out.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 1024").count() == 0
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "secrets", "mixture", "packing"]


def test_near_copies_at_eight_tenths(spark):
    rng, rows = random.Random(5), []
    for k in range(60):  # the last words of a copy are its own: (96 - c) / (96 + c) of the shingles are shared
        base, c = [f"w{rng.randrange(10**6)}" for _ in range(100)], 8 + k % 5
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[:-c] + [f"x{rng.randrange(10**6)}" for _ in range(c)]))]
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    want = {d for d in sets if not any(100 * len(sets[d] & sets[e]) >= 80 * len(sets[d] | sets[e]) for e in range(d))}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in P.drop_near_duplicates(spark, docs, "").collect()} == want
    assert len(want) == 84
