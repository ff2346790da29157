import numpy as np
import pandas as pd
import pytest

from symloom.llm import vector_dedup as V

NAN, INF = float("nan"), float("inf")


def brute(rows, least=0.98):
    """(n_links, component_id, kept) by vec_id."""
    ok = [(i, np.array(x, float), l) for i, x, l in rows if i is not None and l is not None and x and None not in x and np.isfinite(x).all() and np.any(x)]
    links = {i: set() for i, _, _ in rows}
    for a, (i, x, l) in enumerate(ok):
        for j, y, m in ok[a + 1 :]:
            if i != j and l == m and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= least:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        low = min(seen, key=lambda v: (v is None, v))
        out[i] = (len(links[i]), low, i == low)
    return out


def got(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, item int")


def test_cases(spark):
    x = [1.0, 2.0, 3.0]
    rows = [(5, x, 1), (3, [2.0, 4.0, 6.0], 1), (4, x, 1), (9, x, 2), (8, x, None), (1, None, 1), (2, [], 1), (6, [0.0] * 3, 1), (7, [NAN, 1.0, 1.0], 1), (10, [INF, 1.0, 1.0], 1), (11, [1.0, None, 1.0], 1), (12, [1.0, 2.0], 1), (13, [3.0, 2.0, -1.0], 1)]
    assert got(V.near_duplicates(frame(spark, rows))) == brute(rows)
    assert got(V.near_duplicates(frame(spark, [(None, x, 1)]))) == {None: (0, None, True)}
    assert V.near_duplicates(frame(spark, []).limit(0)).count() == 0


def test_equal_ids_join_their_vectors(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [0.0, 1.0], 1)]
    out = V.near_duplicates(frame(spark, rows)).collect()
    assert {(r.vec_id, r.component_id) for r in out} == {(1, 1), (2, 1), (3, 1)} and len(out) == 4


def test_lengths_have_cells_of_their_own(spark):
    """Vectors of other lengths change neither the cells of the first nor its links."""
    rng, rows = np.random.default_rng(9), []
    for i in range(240):
        dim = 6 if i % 8 else 9
        base = np.random.default_rng(i // 16).normal(size=dim)
        rows.append((i, [float(v) for v in np.float32(base + rng.normal(size=dim) * 0.1)], 1))
    want = brute(rows)
    for elem in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{elem}>, label int")
        assert got(V.near_duplicates(df, cells=5, block=16)) == want
    x = np.stack([r[1] for r in rows if len(r[1]) == 6])
    of = {d: V.vectors.spherical_kmeans(V._unit(np.stack([r[1] for r in rows if len(r[1]) == d])), 5) for d in (6, 9)}
    pdf = pd.DataFrame({"label": "1", "embedding": [np.array(r[1]) for r in rows], "item": range(240), "n": 1})
    out = pd.concat(V._cells(of, float(np.sqrt(2 - 2 * 0.98)))(iter([pdf])))
    assert out[out.dim == 6].cell.nunique() > 1 and out[out.dim == 9].cell.nunique() > 1 and len(x) == 210


@pytest.mark.parametrize("block", [4, 512])
def test_clusters_over_cells(spark, block):
    rng = np.random.default_rng(5)
    rows, i = [], 0
    for size in (1, 2, 3, 40, 1, 25):
        base = rng.normal(size=8)
        for _ in range(size):
            rows.append((i * 7 % 997, [float(v) for v in np.float32(base + rng.normal(size=8) * 0.12)], int(rng.integers(2))))
            i += 1
    for _ in range(60):
        rows.append((i * 7 % 997, [float(v) for v in np.float32(rng.normal(size=8))], 1))
        i += 1
    assert got(V.near_duplicates(frame(spark, rows), cells=6, block=block)) == brute(rows)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got(V.op3_vector_dedup(spark, sf)) == brute(rows)
