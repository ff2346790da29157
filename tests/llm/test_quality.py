import zlib

import numpy as np

from symloom.llm import quality as Q


def test_query_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in Q.op6_quality(spark, sf).collect()}
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for d, r in out.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    test = [(labels[d], out[d].predicted) for d in labels if d in out and out[d].held_out]
    assert np.mean([a == b for a, b in test]) >= 0.95
    assert np.mean([b for a, b in test if a == 1]) >= 0.97


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (None, "a b", 3.0), (2, "x " * 30000, 4.0), (3, "!!", 5.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    out = Q.scored(docs, labels).collect()
    assert len(out) == 5 and {r.score for r in out} == {0.5}
    assert Q.keep_good(docs, labels).count() == 5
    assert Q.scored(docs.limit(0), labels).count() == 0
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, "fine words here and there" if i % 2 else "BAD!! BAD!! BAD!!", 0.0) for i in range(40)], "doc_id long, text string, score double")
    assert {r.doc_id for r in Q.keep_good(docs, labels).collect()} == set(range(1, 40, 2))
    assert Q.keep_good(docs, labels).schema == docs.schema


def test_features_of_odd_texts():
    for t in (None, "", " ", "\n", "a", "é" * 10000, "| " * 50):
        x = Q.features(t)
        assert len(x) == len(Q.NAMES) and np.isfinite(x).all()


def test_learns_from_all_rows_and_pairs(spark):
    """24,000 labelled rows: bins are quantiles of all of them, and the strengths are least in loss over all pairs."""
    rng = np.random.default_rng(8)
    y = (np.arange(24_000) % 6 > 0).astype(int)
    x = (rng.normal(0, 1, (len(y), len(Q.NAMES))) + 0.2 * y[:, None]).astype("f4")
    ids = [i for i in range(40_000) if zlib.crc32(str(i).encode()) % 5][: len(y)]
    measured = spark.createDataFrame([(d, r.tolist()) for d, r in zip(ids, x)], "doc_id long, x array<float>").selectExpr("struct(doc_id) as _row", "x")
    ranker = Q.fit(measured, spark.createDataFrame([(d, int(v)) for d, v in zip(ids, y)], "doc_id long, quality int"))
    for j, e in enumerate(ranker.edges):
        want = np.concatenate([np.quantile(x[y == v, j], np.linspace(0, 1, 13)[1:-1], method="inverted_cdf") for v in (0, 1)])
        assert np.allclose(e, np.sort(want), rtol=1e-4, atol=1e-6)
    s, bins = ranker.raw(x), ranker._bins(x)
    pull = 1 / (1 + np.exp(s[y == 1][:, None] - s[y == 0][None, :]))
    force = np.zeros(len(y))
    force[y == 1], force[y == 0] = -pull.mean(axis=1) / (y == 1).sum(), pull.mean(axis=0) / (y == 0).sum()
    grad = np.bincount(bins.ravel(), np.repeat(force, bins.shape[1]), len(ranker.w)) + 1e-3 * ranker.w
    assert np.abs(grad).max() < 3e-4
    assert np.sum(ranker.score(x) < 0.3) == (y == 0).sum()


def test_no_text_meets_the_labels(spark, monkeypatch):
    """Texts are measured where they stand: what is joined or shuffled holds ids and features only."""
    plans, write = {}, Q.common.written
    monkeypatch.setattr(Q.common, "written", lambda df, name="t": plans.__setitem__(name, df._jdf.queryExecution().optimizedPlan().toString()) or write(df, name))
    docs = spark.createDataFrame([(i, "fine words here and there" if i % 2 else "BAD!! BAD!! BAD!!") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert {r.doc_id for r in Q.keep_good(docs, labels).collect()} == set(range(1, 40, 2))
    assert "Join" not in plans["features"] and "Join" in plans["taught"]
