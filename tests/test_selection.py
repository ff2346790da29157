"""Selection under a budget and running sums against plain loops."""

import random

from symloom.operators.ranking import greedy
from symloom.operators.tables import running


def loop(rows, budget):
    left, out = budget, []
    for r in sorted(rows, key=lambda r: (-r[1], r[2], r[3], r[4], r[0])):
        if r[1] > 0 and r[5] is not None and r[5] <= left and (left > 0 or not out):
            left -= r[5]
            out.append(r[0])
    return out


def test_greedy_in_steps(spark):
    draw = random.Random(7)
    for budget in (0, 1, 40, 10_000):
        rows = [(i, float(draw.randrange(-1, 6)), f"p{draw.randrange(4)}", draw.randrange(5), i, draw.choice([None, 0, 1, 5, 30, 90])) for i in range(120)]
        df = spark.createDataFrame(rows, "id long, score double, file_path string, byte_start long, seq int, c long")
        want = loop(rows, budget)
        for step in (7, 1000):
            got = greedy(df, budget, df.c, step)
            assert [r.id for r in got.orderBy("take").select("id").collect()] == want
    assert greedy(df.limit(0), 5, df.c).count() == 0


def test_running_sums(spark):
    draw = random.Random(3)
    rows = [(f"k{i:03}", draw.randrange(9)) for i in range(200)]
    df = spark.createDataFrame(draw.sample(rows, 200), "k string, n long")
    got = {r.k: r.before for r in running(df, "k", "n").collect()}
    assert got == {k: sum(n for _, n in rows[:i]) for i, (k, _) in enumerate(rows)}
    assert running(df.limit(0), "k", "n").count() == 0
