from collections import defaultdict

import numpy as np
import pytest

from symloom.llm import mixing as M


def cells():
    rows = []
    for s, a in (("=a", 900), ("=b", 90), ("null", 30)):
        for l, b in (("=en", 10), ("=fr", 3)):
            for t in range(3):
                rows.append((s, l, t, a * b * (t + 1)))
    return rows


def marginal(rows, p, d):
    out = defaultdict(float)
    for r, q in zip(rows, p):
        out[r[d]] += r[3] * q
    return dict(out)


def test_targets():
    got = M.targets({"a": 800.0, "b": 100.0, "c": 100.0}, 0.0, 0.5)
    assert got == {"b": 100.0, "c": 100.0, "a": 300.0}
    assert sum(M.targets({"a": 7.0, "b": 1.0, "z": 0.0}, 0.5, 0.8).values()) == pytest.approx(6.4)


def test_marginals_hold():
    rows = cells()
    p = M.rake(rows, keep=0.6)
    assert all(0 <= q <= 1 for q in p)
    for d, name in enumerate(M.DIMS):
        full = marginal(rows, [1] * len(rows), d)
        want = M.targets(full, M.ALPHA[name], 0.6)
        assert marginal(rows, p, d) == pytest.approx(want, rel=1e-3)


def test_tables_agree_with_driver(spark):
    rows = cells()
    df = spark.createDataFrame(rows, "source string, lang string, topic int, tokens long")
    got = {(r.source, r.lang, r.topic): r.p for r in M.rake_tables(df, keep=0.6, rounds=4).collect()}
    want = M.rake(rows, keep=0.6, rounds=4)
    assert got == pytest.approx({r[:3]: p for r, p in zip(rows, want)}, rel=1e-6)


def test_draws(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = M.op2_mixing(spark, sf).collect()
    assert len(out) == docs.count()
    drawn, total = sum(r.tokens for r in out if r.drawn), sum(r.tokens for r in out)
    assert abs(drawn / total - M.KEEP) < 0.06
    kept = {r.doc_id for r in M.sample(docs).collect()}
    assert kept == {r.doc_id for r in out if r.drawn}
    size = {r.doc_id: -(-len((r.text or "").encode()) // 4) for r in docs.collect()}
    assert all(r.tokens == size[r.doc_id] for r in out)
    p = defaultdict(set)
    for r in out:
        p[r.source, r.lang, r.topic].add(r.probability)
    assert all(len(v) == 1 for v in p.values())


def test_given_marginals_are_met(spark):
    """Weights of the caller, on the driver and by tables alike; what the corpus can't give is an error."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    own = {r.source: r.n for r in docs.selectExpr("source", "ceil(octet_length(coalesce(text, '')) / 4) as t").groupBy("source").agg({"t": "sum"}).toDF("source", "n").collect()}
    names = sorted(own)
    weights = {"source": {v: own[v] * (1.1 if k else 0.9) for k, v in enumerate(names)}}
    out = M.weigh(docs, keep=0.4, alpha=dict.fromkeys(M.DIMS, 1.0), weights=weights).collect()
    have = defaultdict(float)
    for r in out:
        have[r.source] += r.tokens * r.probability
    whole, parts = sum(have.values()), sum(weights["source"].values())
    assert {k: v / whole for k, v in have.items()} == pytest.approx({k: w / parts for k, w in weights["source"].items()}, rel=1e-3)
    assert whole == pytest.approx(0.4 * sum(own.values()), rel=1e-3)
    df = spark.createDataFrame(cells(), "source string, lang string, topic int, tokens long")
    given = {"source": {"a": 5.0, "b": 2.0, None: 1.0}}
    by = {(r.source, r.lang, r.topic): r.p for r in M.rake_tables(df, keep=0.1, weights=given, rounds=2).collect()}
    assert by == pytest.approx({r[:3]: p for r, p in zip(cells(), M.rake(cells(), keep=0.1, weights=given, rounds=2))}, rel=1e-6)
    with pytest.raises(ValueError):
        M.weigh(docs, weights={"source": {names[0]: 1.0}})
    with pytest.warns(UserWarning):
        M.rake(cells(), rounds=1)


def test_rows_without_an_id_draw_by_content(spark):
    rows = [(None, f"text {k}", "en", "s") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert 0.75 < M.sample(docs, keep=0.8).count() / 3000 < 0.85
    out = M.weigh(docs, keep=0.8)
    assert out.where("drawn").count() == M.sample(docs, keep=0.8).count()


def test_edges(spark):
    rows = [(1, None, None, None, 1), (2, "", "en", None, 2), (2, "a b", None, "s", 3), (None, "a", "en", "s", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic long")
    out = M.weigh(df)
    assert out.count() == 4 and out.where("probability between 0 and 1").count() == 4
    assert M.sample(df).schema == df.schema and M.weigh(df.limit(0)).count() == 0


def test_topics_are_fitted_on_all_rows(spark):
    """6,000 texts of three vocabularies and a long one: the mean is of all of them, and no centroid is that of a part."""
    rows = [(k, " ".join(f"{'abc'[k % 3]}{(k * 7 + i * i) % 40}" for i in range(12)), "en", "s") for k in range(6000)] + [(6000, "long " * 1000, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for df in (docs, docs.repartition(3)):  # the same wherever rows stand
        table = M.counted(df, ["doc_id"])
        mean, c = M.fit_topics(table, rounds=60)
        u = M.unit_vectors(np.stack([M.word_counts(t.encode()) for _, t, _, _ in rows])) / M.ONE
        assert np.allclose(mean, u.mean(axis=0), atol=1e-9)
        v = (u - mean) / np.linalg.norm(u - mean, axis=1)[:, None]
        own = np.argmax(v @ c.T, axis=1)
        for k in set(own.tolist()):
            total = v[own == k].sum(axis=0)
            assert np.allclose(c[k], total / np.linalg.norm(total), atol=1e-4)
        assert [r._topic for r in M.assigned(table, (mean, c)).orderBy("_row.doc_id").collect()] == own.tolist()
