"""Components against union-find, with hubs and without."""

import random

from symloom.llm import common


def brute(pairs):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(top)}


def test_components(spark):
    draw = random.Random(11)
    star = [(500, i) for i in range(501, 900)] + [(i, 2000) for i in range(1000, 1300)]  # hubs that are smallest and largest
    chain = [(i, i + 1) for i in range(3000, 3040)]
    loose = [(draw.randrange(5000, 8000), draw.randrange(5000, 8000)) for _ in range(1500)]
    pairs = star + chain + loose + [(899, 1100), (4000, 4000)]
    draw.shuffle(pairs)
    got = {r.id: r.component for r in common.components(spark.createDataFrame(pairs + pairs[:50], "a long, b long")).collect()}
    want = brute([(a, b) for a, b in pairs if a != b])
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
