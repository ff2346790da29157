import numpy as np
import pyarrow as pa

from symloom.llm import ann

NAN, INF = float("nan"), float("inf")


def brute(table, asked, k=10):
    out = {}
    for i, x in asked:
        near = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), j) for j, y in table if j != i and len(y) == len(x))
        out[i] = near[:k]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return out


def test_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [NAN, 1.0]), (7, [INF, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (100, [3.0, 1.0]), (200, [0.0, 0.0]), (300, [5.0, 5.0, 5.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, row int")
    good = [r for r in rows if r[0] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    assert got(ann.search(df, df.where("vec_id % 100 = 0"))) == brute(good, [r for r in good if r[0] % 100 == 0])
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_recall(spark):
    sf = "/root/testdata/sf0.01"
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    asked = [r for r in table if r[0] % 100 == 0]
    want, have = brute(table, asked), got(ann.op10_nearest(spark, sf))
    hit = sum(len({j for _, j in want[i]} & {j for _, j in have[i]}) for i in want)
    assert hit >= 0.95 * sum(map(len, want.values()))
    exact = {(i, j): s for i, near in brute(table, asked, 500).items() for s, j in near}
    assert all(abs(exact[i, j] - s) < 1e-12 for i, near in have.items() for s, j in near)


def test_equal_ids_and_copies(spark):
    """One id in nearly all rows, and more copies of a vector than are ranked again: nothing is lost, whatever the sample."""
    rows = [(100, [1.0, 0.0, float(i)]) for i in range(1, 51)] + [(200, [0.0, 1.0, 0.5])] + [(i, [0.0, 1.0, 1.0]) for i in range(1001, 1060)] + [(7, [0.0, 1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    near = sorted((float(np.sqrt(((np.array([0.0, 1.0, 0.5]) - np.array(y)) ** 2).sum())), j) for j, y in rows if j != 200)
    for sample in (10, 5, 2, 1):
        have = got(ann.search(df, df.where("vec_id = 200"), depth=20, sample=sample))
        assert have[200] == near[:10]


def test_recall_on_many_vectors(spark):
    """50,000 vectors in groups, recall of 10 at the production depth by brute force; and no more rows a query than spans allow."""
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(500, 32))[rng.integers(500, size=50_000)] + 0.4 * rng.normal(size=(50_000, 32))).astype("f4")
    table = spark.createDataFrame(pa.table({"vec_id": np.arange(50_000), "embedding": pa.array(list(x))})).repartition(8)
    have = got(ann.search(table, table.where("vec_id % 500 = 0")))
    hit = 0
    for i in range(0, 50_000, 500):
        d = np.sqrt(((x.astype(float) - x[i].astype(float)) ** 2).sum(axis=1))
        d[i] = np.inf
        hit += len({j for _, j in have[i]} & set(np.argsort(d)[:10].tolist()))
    assert hit >= 0.95 * 1000


def test_what_the_codes_cannot_tell(spark):
    """Close groups larger than what is ranked again, a far origin, norms apart by orders, ties, and an id of many vectors: all as by brute force."""
    rng = np.random.default_rng(6)
    n = 4000
    grid = rng.integers(0, 3, size=(n, 5)).astype(float)
    sets = [
        rng.normal(size=(4, 12))[rng.integers(4, size=n)] + 0.001 * rng.normal(size=(n, 12)),
        100 + rng.normal(size=(n, 12)),
        rng.normal(size=(n, 12)) * np.exp(2 * rng.normal(size=(n, 1))),
        np.where(grid.any(axis=1)[:, None], grid, 1.0),
    ]
    for x, kind in zip(sets, ("f4", "f8", "f4", "f8")):
        x = x.astype(kind)
        ids = np.where(np.arange(n) % 400 == 7, 250, np.arange(n))
        df = spark.createDataFrame(pa.table({"vec_id": ids, "embedding": pa.array(list(x))})).repartition(4)
        have = got(ann.search(df, df.where("vec_id % 250 = 0"), sample=500))
        want = {}
        for i in np.flatnonzero(ids % 250 == 0):
            total = np.zeros(n)
            for c in x.T.astype(float):
                total += (c[i] - c) ** 2
            rows = {(d, j, tuple(v)) for d, j, v in zip(np.sqrt(total).tolist(), ids.tolist(), x.tolist()) if j != ids[i]}
            want.setdefault(int(ids[i]), []).extend((d, j) for d, j, _ in sorted(rows)[:10])
        assert {i: sorted(near) for i, near in have.items()} == {i: sorted(near) for i, near in want.items()}


def test_anisotropic_codes_lose_less_along_the_vector():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 16))

    def along(eta):
        quant = ann.fit(x, eta=eta)
        r = x - np.stack([quant.books[m, c] for m, c in enumerate(quant.codes(x, eta).T)], axis=1).reshape(len(x), -1)[:, :16]
        return (((r * x).sum(1) / np.linalg.norm(x, axis=1)) ** 2).mean()

    assert along(4.0) < 0.8 * along(1.0)


def test_packed_codes():
    code = np.random.default_rng(1).integers(0, 16, (9, 7)).astype("u1")
    assert (ann.unpack_codes(ann.pack_codes(code), 7) == code).all()
