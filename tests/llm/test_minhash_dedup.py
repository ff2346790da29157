import random
import re

import numpy as np
import pandas as pd

from symloom.llm import minhash_dedup as M

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(A_Z))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [(d, shingle_set(t)) for d, t in rows]
    near = {d: {d} for d, _ in rows}
    for k, (d, s) in enumerate(sets):
        for e, t in sets[k + 1 :]:
            if s and t and 100 * min(len(s), len(t)) >= 85 * max(len(s), len(t)) and 100 * len(s & t) >= 85 * len(s | t):
                near[d].add(e)
                near[e].add(d)
    out = []
    for d, s in sets:
        seen, todo = {d}, [d]
        while todo:
            for e in near[todo.pop()] - seen:
                seen.add(e)
                todo.append(e)
        out.append((d, len(s), min(seen), d == min(seen)))
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n)]


def corpus():
    rng = random.Random(4)
    rows = [(50, ""), (51, None), (52, " \n\t"), (53, "One two"), (54, "one\ttwo "), (55, "one two three four five"), (56, "ONE two three four FIVE"), (57, "É é x y z"), (58, "é é x y z"), (59, "a\x1cb c d e f g")]
    i = 100
    for size, change in ((120, 0.01), (400, 0.02), (60, 0.03), (900, 0.014)):
        base = words(rng, size)
        for _ in range(25):
            w = [rng.choice(words(rng, 1)) if rng.random() < change else v for v in base]
            rows.append((i * 37 % 1009, " ".join(w)))
            i += 1
    chain = words(rng, 400)
    for k in range(12):  # each links with the next only
        rows.append((i * 37 % 1009, " ".join(chain[k * 9 : k * 9 + 200])))
        i += 1
    rows += [(i * 37 % 1009 + j * 1009, rows[15][1].upper()) for j in range(3)]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, rep long, label long")
    want = brute(rows)
    assert got(M.near_duplicates(df)) == want
    assert got(M.near_duplicates(df, block=4)) == want


def test_equal_ids_and_nulls(spark):
    a, b = "a b c d e f", "g h i j k l"
    rows = [(1, a), (2, a), (2, b), (3, b), (None, a), (4, None)]
    out = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in out.collect()) == [(0, 0, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (4, 4, True)]
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def linked_groups(rows):
    """Components over rows whose equal ids are one node."""
    sets = [(d, shingle_set(t)) for d, t in rows]
    low = {d: d for d, _ in rows}
    changed = True
    while changed:
        changed = False
        for d, s in sets:
            for e, t in sets:
                if (d == e or s and t and 100 * len(s & t) >= 85 * len(s | t)) and low[d] != low[e]:
                    low[d] = low[e] = min(low[d], low[e])
                    changed = True
    return low


def test_equal_ids_with_near_texts(spark):
    """An id with two texts, and ids near to either: a link of any text holds. Forty cases in one table."""
    rng, rows = random.Random(8), []
    for k in range(40):
        a, b = words(rng, 80), words(rng, 80)
        near = lambda w: [*w[:-1], words(rng, 1)[0]]
        ids = [100 * k + i for i in rng.sample(range(50), 4)]
        rows += [(ids[0], " ".join(a)), (ids[0], " ".join(b)), (ids[1], " ".join(near(a))), (ids[2], " ".join(near(b))), (ids[3], " ".join(near(near(b))))]
    rng.shuffle(rows)
    want = linked_groups(rows)
    out = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(out) == len(rows) and {r.doc_id: r.component_id for r in out} == want
    assert len(set(want.values())) == 40


def test_keep_one(spark):
    a = "a b c d e f g h"
    rows = [(3, a, "x"), (5, a, "x"), (3, a, "x"), (3, "other words stand here now", "y"), (7, None, "z"), (7, "", "z"), (None, a, "w"), (None, a, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep string")
    out = M.keep_one(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 0, 3, 7]
    assert M.keep_one(df.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(M.op5_minhash_dedup(spark, sf)) == brute(rows)


def test_sets_go_where_partners_are():
    """Of two blocks, only classes that may link with one of another label are dealt with their sets."""
    def sig(*v):
        return np.array(v, "<u4").tobytes()

    rows = [(0, 1, 1, sig(1, 2, 3, 4), 50), (0, 2, 2, sig(9, 9, 9, 9), 50), (0, 3, 7, sig(5, 6, 7, 8), 50), (1, 4, 4, sig(1, 2, 3, 0), 50), (1, 5, 7, sig(5, 6, 7, 8), 50), (1, 6, 6, sig(1, 2, 3, 4), 90)]
    pdf = pd.DataFrame([(0, 0, 1, *r) for r in rows], columns=["cluster", "i", "j", "side", "cls", "label", "sig", "n"])
    assert M._partners(85, 100, 3)((0, 0, 1), pdf).cls.tolist() == [1, 4]
    one = pdf.assign(i=0, j=0, side=0)
    assert M._partners(85, 100, 3)((0, 0, 0), one).cls.tolist() == [1, 4]
